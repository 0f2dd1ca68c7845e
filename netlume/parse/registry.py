"""Parsers as columns, and as producers of rule buffers.  Users add their own with register()."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from . import auth, binary, quic, text

#: Name: (parser of bytes, type of its result).
PARSERS: dict[str, tuple[Callable, str]] = {
    "http_request": (text.http_request, "method string, uri string, protocol string, request_line string, host string, user_agent string, cookie string, content_type string, referer string, accept string, accept_encoding string, accept_language string, connection string, start string, header string, header_names string, content_length bigint, chunked boolean, body binary"),
    "http_response": (text.http_response, "stat_code string, stat_msg string, protocol string, set_cookie string, content_type string, server string, location string, status_line string, connection string, start string, header string, header_names string, content_length bigint, chunked boolean, body binary"),
    "dns_question": (binary.dns_question, "string"), "client_hello": (binary.client_hello, "sni string, ja3_text string, ja3 string"), "server_hello": (binary.server_hello, "version string, ja3s string"),
    "certificate": (binary.certificate, "serial string, issuer string, subject string"), "ssh_version": (text.ssh_version, "string"), "ftp_command": (text.ftp_command, "string"), "smtp_command": (text.smtp_command, "command string, sender string, recipient string"),
    "smb2": (binary.smb2, "command string, filename string, status bigint"), "ntlm": (binary.ntlm, "message string, user string, domain string, workstation string"), "kerberos": (binary.kerberos, "message string, realm string, client string, service string, error bigint"),
    "ldap": (binary.ldap, "operation string, dn string, cleartext boolean, result bigint"), "dcerpc": (binary.dcerpc, "packet string, interface string, opnum int"), "modbus": (binary.modbus, "function string, address bigint"), "rdp_cookie": (binary.rdp_cookie, "string"),
    "smb1": (binary.smb1, "command string, path string"), "quic_initial": (quic.quic_initial, "version bigint, dcid string, scid string, sni string, ja3 string"), "app_marks": (auth.marks, "array<string>"),
    "tftp": (binary.tftp, "opcode string, filename string"), "snmp_community": (binary.snmp_community, "string"), "dnp3_function": (binary.dnp3_function, "string"), "file_identity": (text.file_identity, "size bigint, md5 string, sha256 string, type string, description string"),
}

#: Parsers that take many messages at once, beside the same parser of one: lists of bytes or None, and of results.
BATCHES: dict[str, Callable[[list], list]] = {"quic_initial": quic.quic_initials}

# Names of rule buffers, the parsers whose fields fill them (None: the whole result), and the side that they are of.
BUFFERS: dict[str, tuple[list[tuple[str, str | None]], str]] = {
    "http.method": ([("http_request", "method")], "to_server"), "http.uri": ([("http_request", "uri")], "to_server"), "http.host": ([("http_request", "host")], "to_server"), "http.user_agent": ([("http_request", "user_agent")], "to_server"),
    "http.cookie": ([("http_request", "cookie"), ("http_response", "set_cookie")], "any"), "http.header": ([("http_request", "header"), ("http_response", "header")], "any"), "http.header_names": ([("http_request", "header_names"), ("http_response", "header_names")], "any"),
    "http.request_body": ([("http_request", "body")], "to_server"), "http.request_line": ([("http_request", "request_line")], "to_server"), "http.response_line": ([("http_response", "status_line")], "to_client"), "http.start": ([("http_request", "start"), ("http_response", "start")], "any"),
    "http.protocol": ([("http_request", "protocol"), ("http_response", "protocol")], "any"), "http.accept": ([("http_request", "accept"), ("http_response", "accept")], "any"), "http.accept_enc": ([("http_request", "accept_encoding"), ("http_response", "accept_encoding")], "any"),
    "http.accept_lang": ([("http_request", "accept_language"), ("http_response", "accept_language")], "any"), "http.referer": ([("http_request", "referer"), ("http_response", "referer")], "any"), "http.connection": ([("http_request", "connection"), ("http_response", "connection")], "any"),
    "http.content_len": ([("http_request", "content_length"), ("http_response", "content_length")], "any"), "http.content_type": ([("http_request", "content_type"), ("http_response", "content_type")], "any"), "http.stat_code": ([("http_response", "stat_code")], "to_client"),
    "http.stat_msg": ([("http_response", "stat_msg")], "to_client"), "http.server": ([("http_response", "server")], "to_client"), "http.location": ([("http_response", "location")], "to_client"), "http.response_body": ([("http_response", "body")], "to_client"),
    "file.data": ([("http_request", "body"), ("http_response", "body")], "any"), "file.md5": ([("body_identity", "md5")], "any"), "file.sha256": ([("body_identity", "sha256")], "any"), "file.type": ([("body_identity", "type")], "any"), "file.magic": ([("body_identity", "description")], "any"),
    "dns.query": ([("dns_question", None)], "any"), "tls.sni": ([("client_hello", "sni"), ("quic_initial", "sni")], "to_server"), "tls.ja3": ([("client_hello", "ja3"), ("quic_initial", "ja3")], "to_server"), "tls.version": ([("server_hello", "version")], "to_client"), "tls.ja3s": ([("server_hello", "ja3s")], "to_client"),
    "tls.cert_subject": ([("certificates", "subject")], "to_client"), "tls.cert_issuer": ([("certificates", "issuer")], "to_client"), "tls.cert_serial": ([("certificates", "serial")], "to_client"), "tls.certs": ([("certificates", "der")], "to_client"), "ssh.version": ([("ssh_version", None)], "any"),
    "ftp.command": ([("ftp_lines", None)], "any"), "smtp.command": ([("smtp_lines", "command")], "any"), "smtp.sender": ([("smtp_lines", "sender")], "any"), "smtp.recipient": ([("smtp_lines", "recipient")], "any"), "smb.command": ([("smb2", "command"), ("smb1", "command")], "any"),
    "smb.filename": ([("smb2", "filename")], "any"), "smb.share": ([("smb1", "path")], "any"), "ntlm.user": ([("ntlm", "user")], "any"), "ntlm.domain": ([("ntlm", "domain")], "any"), "ntlm.workstation": ([("ntlm", "workstation")], "any"), "krb5.realm": ([("kerberos", "realm")], "any"),
    "krb5.principal": ([("kerberos", "client")], "any"), "krb5.service": ([("kerberos", "service")], "any"), "ldap.dn": ([("ldap", "dn")], "any"), "ldap.operation": ([("ldap", "operation")], "any"), "dcerpc.interface": ([("dcerpc", "interface")], "any"), "modbus.function": ([("modbus", "function")], "any"),
    "modbus.address": ([("modbus", "address")], "any"), "rdp.cookie": ([("rdp_cookie", None)], "any"), "tftp.opcode": ([("tftp", "opcode")], "any"), "tftp.filename": ([("tftp", "filename")], "any"), "snmp.community": ([("snmp_community", None)], "any"), "dnp3.function": ([("dnp3_function", None)], "any"),
}


def _body_identity(data: bytes) -> dict | None:
    found = text.http_response(data) or text.http_request(data)
    return text.file_identity(found["body"]) if found and found["body"] else None


#: Parsers that give several results, or need another one's; only for buffers.
MANY: dict[str, Callable] = {
    "ftp_lines": lambda data: [c for x in text.lines(data) if (c := text.ftp_command(x))], "smtp_lines": lambda data: [c for x in text.lines(data) if (c := text.smtp_command(x))],
    "certificates": lambda data: [c | {"der": der} for der in binary.certificate_chain(data) if (c := binary.certificate(der))], "body_identity": _body_identity,
}

#: Server ports of parsers whose marks are too weak for any other port.
GATES = {"dns_question": (53,), "kerberos": (88,), "ldap": (389, 3268), "dcerpc": (135, 445), "modbus": (502,), "dnp3_function": (20_000,), "tftp": (69,), "snmp_community": (161, 162)}


def register(name: str, parser: Callable, kind: str) -> None:
    PARSERS[name] = (parser, kind)
    BATCHES.pop(name, None)


def parsed(name: str, data: Column) -> Column:
    """A parser's result as a column; null where it recognises nothing."""
    parser, kind = PARSERS[name]
    if many := BATCHES.get(name):
        arrow = to_arrow_type(DataType.fromDDL(kind))
        return F.arrow_udf(lambda b: pa.array(many(b.to_pylist()), arrow), kind, ArrowUDFType.SCALAR)(data)
    one = F.udf(lambda b: parser(bytes(b)) if b is not None else None, kind, useArrow=True)
    return one(data)


def message_lines(streams: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and line of each complete line of a stream, as bytes; an unfinished last line is left out."""
    split = F.udf(lambda b: text.lines(bytes(b)) if b is not None else [], "array<binary>", useArrow=True)
    return streams.select(*keys, F.posexplode(split("stream")).alias("n", "line"))


def buffers_of(data: bytes, names: list[str], direction: str | None, ports: tuple[int | None, int | None] | None) -> list[tuple[str, bytes]]:
    """(buffer, bytes) of a stream; each parser runs once at most, and only if a named buffer of this side needs it."""
    made: dict[str, list] = {}
    out = []
    for name in names:
        sources, side = BUFFERS[name]
        if side != "any" and direction is not None and side != direction:
            continue
        for parser, field in sources:
            if parser not in made:
                if ports is not None and parser in GATES and not set(ports) & set(GATES[parser]):
                    found = None
                else:
                    found = MANY[parser](data) if parser in MANY else PARSERS[parser][0](data)
                made[parser] = found if isinstance(found, list) else [] if found is None else [found]
            for x in made[parser]:
                value = x if field is None else x[field]
                if value is not None:
                    out.append((name, value if isinstance(value, bytes) else str(value).encode()))
    return out


def rule_buffers(streams: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(keys, buffer, direction, data) of the buffers that rules name, from streams (keys, direction, stream).

    Where streams have src_port and dst_port, parsers with weak marks run only on streams with one of their ports.
    """
    wanted = [n for n in names if n in BUFFERS]
    if not wanted:
        raise ValueError("no known buffer is named")
    gated = {"src_port", "dst_port"} <= set(streams.columns)

    def made(data, direction, *ports):
        return [{"buffer": b, "data": d} for b, d in buffers_of(bytes(data), wanted, direction, ports or None)] if data is not None else []

    one = F.udf(made, "array<struct<buffer:string,data:binary>>")
    found = F.explode(one(F.col("stream").cast("binary"), F.col("direction"), *([F.col("src_port"), F.col("dst_port")] if gated else [])))
    return streams.select(*keys, "direction", found.alias("_b")).select(*keys, "_b.buffer", "direction", "_b.data")
