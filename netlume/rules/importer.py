"""Translation of rules in the common IDS syntax (action proto src port -> dst port (options)) to this library's text.

translate(line) gives the rule lines, or a reason why the rule cannot be said here.  A rule for both directions gives
two lines.  What a rule says about speed only (fast_pattern, prefilter) or about people (reference, classtype) is left.
"""

from __future__ import annotations

import re

from .parser import RuleError, parse_new, split_options

# Names of sticky buffers there and here, and options that have no effect on what matches.
BUFFERS = {
    "http.uri": "http.uri", "http_uri": "http.uri", "http.method": "http.method", "http.host": "http.host", "http.user_agent": "http.user_agent", "http.cookie": "http.cookie", "http.header": "http.header", "http.header_names": "http.header_names", "http.request_body": "http.request_body",
    "http.request_line": "http.request_line", "http.stat_code": "http.stat_code", "http.stat_msg": "http.stat_msg", "http.server": "http.server", "http.location": "http.location", "http.response_body": "http.response_body", "file.data": "file.data", "file_data": "file.data", "dns.query": "dns.query", "dns_query": "dns.query",
    "tls.sni": "tls.sni", "tls_sni": "tls.sni", "ja3.hash": "tls.ja3", "ja3s.hash": "tls.ja3s", "tls.version": "tls.version", "ssh.proto": "ssh.version", "ssh.software": "ssh.version", "snmp.community": "snmp.community", "krb5_cname": "krb5.principal", "krb5_sname": "krb5.service", "pkt_data": "payload",
    "http.accept": "http.accept", "http.accept_enc": "http.accept_enc", "http.accept_lang": "http.accept_lang", "http.connection": "http.connection", "http.content_len": "http.content_len", "http.content_type": "http.content_type", "http.protocol": "http.protocol", "http.referer": "http.referer", "http.start": "http.start",
    "http.response_line": "http.response_line", "filemagic": "file.magic", "filemd5": "file.md5", "filesha256": "file.sha256", "tls.cert_subject": "tls.cert_subject", "tls.cert_issuer": "tls.cert_issuer", "tls.cert_serial": "tls.cert_serial", "tls.certs": "tls.certs", "smb.share": "smb.share", "smb.named_pipe": "smb.share",
}
MODIFIERS = {"http_uri": "http.uri", "http_method": "http.method", "http_host": "http.host", "http_user_agent": "http.user_agent", "http_cookie": "http.cookie", "http_header": "http.header", "http_client_body": "http.request_body", "http_stat_code": "http.stat_code"}
IGNORED = frozenset("rev reference metadata classtype priority gid fast_pattern prefilter rawbytes target app-layer-protocol requires".split())
TRANSFORMS = {"url_decode": "percent_decode", "to_sha1": "sha1", "to_md5": "md5", "to_sha256": "sha256", "strip_whitespace": "strip_whitespace", "compress_whitespace": "compress_whitespace", "header_lowercase": "header_lowercase"}
PROTOCOLS = {"tcp": "tcp", "udp": "udp", "icmp": "icmp", "http": "tcp", "tls": "tcp", "ssh": "tcp", "ftp": "tcp", "smtp": "tcp", "smb": "tcp", "dns": None, "ip": None, "tcp-pkt": "tcp", "tcp-stream": "tcp", "http1": "tcp", "krb5": None, "snmp": "udp", "tftp": "udp"}
SEVERITIES = {"1": "high", "2": "medium", "3": "low", "4": "low"}
# Grades of rule metadata, and classes of rules, by severity; the rest is medium.
GRADES = {"major": "high", "critical": "high", "minor": "medium", "informational": "low", "audit": "low"}
MAJOR = frozenset(
    "trojan-activity attempted-admin attempted-user successful-admin successful-user shellcode-detect web-application-attack command-and-control targeted-activity exploit-kit domain-c2 credential-theft malware-cnc".split()
)
#: Protocols that mark their flows, and those whose server port stands for them as datagrams have no flow.
MARKED = {"http": "app.http", "http1": "app.http", "tls": "app.tls", "ssh": "app.ssh", "ftp": "app.ftp", "smtp": "app.smtp", "smb": "app.smb", "rdp": "app.rdp"}
PORTED = {"dns": "53", "tftp": "69", "snmp": "161,162", "krb5": "88"}
SHAPE = re.compile(r"^\s*(alert|drop|reject|pass)\s+(\S+)\s+(\[.*?\]|\S+)\s+(\[.*?\]|\S+)\s+(->|<>)\s+(\[.*?\]|\S+)\s+(\[.*?\]|\S+)\s*\((.*)\)\s*$")


class Unsupported(ValueError):
    """Why a rule cannot be said."""


def address(text: str, home: list[str]) -> str | None:
    """Our form of an address list; None for any."""
    negated, body = text.startswith("!"), text.lstrip("!")
    if body in ("any", "0.0.0.0/0"):
        if negated:
            raise Unsupported("matches no address")
        return None
    if body in ("$EXTERNAL_NET", "$HOME_NET") or body.endswith("_SERVERS"):
        if not home:
            return None
        outside = (body == "$EXTERNAL_NET") != negated
        return ("!" if outside else "") + ",".join(home)
    parts = [x.strip() for x in body.strip("[]").split(",")]
    if any(p.startswith(("$", "[")) for p in parts):
        raise Unsupported(f"variable in {text}")
    if any(p.startswith("!") for p in parts):
        raise Unsupported("a list with both kinds of entries")
    return ("!" if negated else "") + ",".join(parts)


def port(text: str) -> str | None:
    negated, body = text.startswith("!"), text.lstrip("!")
    if body == "any":
        return None
    known = {"$HTTP_PORTS": "80,8080,8000", "$SSH_PORTS": "22", "$FTP_PORTS": "21"}
    body = known.get(body, body)
    if body.startswith("$") or "!" in body:
        raise Unsupported(f"ports {text}")
    out = []
    for x in body.strip("[]").split(","):
        low, colon, high = x.strip().partition(":")
        out.append(f"{low or 0}-{high or 65535}" if colon else low)
    return ("!" if negated else "") + ",".join(out)


def pcre(value: str) -> tuple[str, bool, bool, str | None]:
    """(pattern, negated, relative, buffer) of /pattern/flags."""
    negated = value.startswith("!")
    body = value.lstrip("!").strip().strip('"')
    m = re.fullmatch(r"/(.*)/([A-Za-z]*)", body, re.DOTALL)
    if not m:
        raise Unsupported("a pattern without slashes")
    text, flags = m[1].replace("\\/", "/"), m[2]
    inline = "".join(c for c in "imsx" if c in flags)
    if "A" in flags:
        text = f"^(?:{text})"
    where = {"U": "http.uri", "I": "http.uri", "H": "http.header", "D": "http.header", "C": "http.cookie", "P": "http.request_body", "M": "http.method", "S": "http.stat_code", "V": "http.user_agent", "W": "http.host"}
    buffer = next((where[c] for c in flags if c in where), None)
    if any(c not in "imsxAERUIHDCPMSVWOGBQ" for c in flags):
        raise Unsupported(f"pattern flags {flags}")
    return (f"(?{inline})" if inline else "") + text, negated, "R" in flags, buffer


def severity(options: list[tuple[str, str]]) -> str:
    """By the grade in the metadata, a priority, or the class."""
    grades = [g for name, value in options if name == "metadata" for g in re.findall(r"signature_severity\s+(\w+)", value.lower())]
    if grades and grades[0] in GRADES:
        return GRADES[grades[0]]
    given = dict(options)
    if given.get("priority") in SEVERITIES:
        return SEVERITIES[given["priority"]]
    return "high" if given.get("classtype", "").strip().lower() in MAJOR else "medium"


def scoped(protocol: str, direction: str, body: list[str], ends: tuple[str | None, str | None]) -> list[dict[str, str]]:
    """What a rule of an application protocol needs beside its terms: a mark of its flow, or its port on an end that names none.

    A structured buffer already tells the protocol; raw payload alone would match flows of any.
    """
    if any(x.startswith("buffer:") and x != "buffer:payload" for x in body):
        return [{}]
    if protocol in MARKED:
        return [{"flowbits": f"isset,{MARKED[protocol]}"}]
    if protocol not in PORTED or (protocol != "dns" and any(ends)):
        return [{}]
    ports = PORTED[protocol]
    named = {p for e in ends if e for p in re.split(r"[,\-!]", e)}
    if named & set(ports.split(",")):
        return [{}]
    if direction == "any":
        if any(ends):
            raise Unsupported("an application protocol on other ports")
        return [{"dst_port": ports}, {"src_port": ports}]
    if ends[1]:
        raise Unsupported("an application protocol on another port")
    return [{"dst_port": ports}]


def _body(options: list[tuple[str, str]]) -> list[str]:
    """Our options for the parts of the rule."""
    parts: list[tuple[str, list[str]]] = []
    tail: list[str] = []
    sticky = "payload"

    def into(buffer: str) -> list[str]:
        if not parts or parts[-1][0] != buffer:
            parts.append((buffer, []))
        return parts[-1][1]

    for name, value in options:
        if name in IGNORED or name in ("msg", "sid", "flow"):
            continue
        if name in MODIFIERS and not value and parts and parts[-1][1] and sticky == "payload":
            last = [parts[-1][1].pop()]
            while not last[0].startswith(("content:", "pcre:")) and parts[-1][1]:
                last.insert(0, parts[-1][1].pop())
            if not parts[-1][1]:
                parts.pop()
            into(MODIFIERS[name]).extend(last)
        elif name in BUFFERS and not value:
            sticky = BUFFERS[name]
        elif name in TRANSFORMS and not value:
            into(sticky).append(f"transform:{TRANSFORMS[name]}")
        elif name in ("content", "uricontent"):
            into("http.uri" if name == "uricontent" else sticky).append(f"content:{value}")
        elif name in ("nocase", "relative"):
            parts[-1][1].append(name)
        elif name in ("offset", "depth", "distance", "within"):
            parts[-1][1].append(f"{name}:{value}")
        elif name == "startswith":
            n = len(parse_new(f'rule sid:1; {parts[-1][1][-1]};').parts[0].terms[-1].value)
            parts[-1][1].extend(["offset:0", f"depth:{n}"])
        elif name == "endswith":
            parts[-1][1].append("isdataat:!0,relative")
        elif name == "pcre":
            text, negated, relative, buffer = pcre(value)
            quoted = text.replace('"', '\\"')
            into(buffer or sticky).append(f'pcre:{"!" if negated else ""}"{quoted}"')
            if relative:
                parts[-1][1].append("relative")
        elif name in ("byte_test", "byte_jump", "byte_extract", "byte_math", "isdataat", "bsize", "base64_decode"):
            into(sticky).append(f"{name}:{value}" if value else f"{name}:")
        elif name == "urilen":
            into("http.uri").append(f"bsize:{value.split(',')[0]}")
        elif name == "base64_data":
            continue
        elif name in ("dsize", "itype", "icode", "window", "ip_proto", "flags", "stream_size", "flowbits", "threshold", "detection_filter", "xbits", "noalert"):
            if name == "flowbits" and "," in value and "|" in value:
                raise Unsupported("alternatives of flow bits")
            tail.append(f"{name}:{value}" if value else name)
        else:
            raise Unsupported(f"option {name}")
    return [x for buffer, terms in parts for x in (f"buffer:{buffer}", *terms)] + tail


def translate(line: str, home: list[str] | None = None) -> tuple[list[str], str | None]:
    """(rule lines, None), or ([], reason)."""
    line = line.strip()
    if not line or line.startswith("#"):
        return [], "a comment"
    try:
        m = SHAPE.match(line)
        if not m:
            raise Unsupported("not a rule")
        action, protocol, src, sport, arrow, dst, dport, text = m.groups()
        if action == "pass":
            raise Unsupported("an exception, not an alert")
        if protocol not in PROTOCOLS:
            raise Unsupported(f"protocol {protocol}")
        options = split_options(text)
        given = dict(options)
        if "sid" not in given:
            raise Unsupported("no sid")
        flow = [x.strip() for x in given.get("flow", "").split(",")]
        direction = "to_server" if {"to_server", "from_client"} & set(flow) else "to_client" if {"to_client", "from_server"} & set(flow) else "any"
        body, made = _body(options), []
        for a, ap, b, bp in [(src, sport, dst, dport), *([(dst, dport, src, sport)] if arrow == "<>" else [])]:
            head = [f"sid:{given['sid']}", f"name:{given.get('msg', 'sid')}", f"severity:{severity(options)}"]
            head += [f"proto:{PROTOCOLS[protocol]}"] if PROTOCOLS[protocol] else []
            # here source and destination are the connection's client and server
            client, server = ((b, bp), (a, ap)) if direction == "to_client" else ((a, ap), (b, bp))
            for key, value in (("src_ip", address(client[0], home or [])), ("src_port", port(client[1])), ("dst_ip", address(server[0], home or [])), ("dst_port", port(server[1]))):
                head += [f"{key}:{value}"] if value else []
            head += [f"direction:{direction}"] if direction != "any" else []
            for more in scoped(protocol, direction, body, (port(client[1]), port(server[1]))):
                rule = "rule " + " ".join(f"{x};" for x in [*head, *body, *(f"{k}:{v}" for k, v in more.items())])
                parse_new(rule)
                made.append(rule)
        return made, None
    except (Unsupported, RuleError, ValueError, IndexError, KeyError) as e:
        return [], str(e)


def translate_all(text: str, home: list[str] | None = None) -> tuple[list[str], list[tuple[int, str]]]:
    """All rule lines of a file, and (line, reason) of those left out."""
    rules, left = [], []
    for n, line in enumerate(text.splitlines(), 1):
        if line.strip() and not line.lstrip().startswith("#"):
            made, why = translate(line, home)
            rules += made
            left += [(n, why)] if why else []
    return rules, left
