"""Login attempts and refusals, and marks of a flow's protocol, from the bytes of one segment or stream."""

from __future__ import annotations

from . import binary, text

# Statuses and codes that mean a refused login, ports of line protocols, and ports that gate parsers.
SMB_REFUSED = (0xC000006D, 0xC000006A, 0xC0000234, 0xC0000072)
KERBEROS_REFUSED, LDAP_REFUSED = (6, 18, 24), 49
REFUSING_LINES = {21: (b"530", "FTP"), 25: (b"535", "SMTP"), 587: (b"535", "SMTP")}
KERBEROS_PORT, LDAP_PORTS = 88, (389, 3268)


def attempt(data: bytes, server_port: int) -> str | None:
    """The service that a login is tried on, at most one; where a segment speaks several, the most telling."""
    found = None
    if binary.rdp_cookie(data):
        found = "RDP"
    for line in text.lines(data):
        command = text.ftp_command(line)
        if command and command.split(" ", 1)[0].upper() in ("USER", "PASS"):
            found = "FTP"
        said = text.smtp_command(line)
        if said and str(said["command"]).upper().startswith("AUTH"):
            found = "SMTP"
    if (m := binary.ntlm(data)) and m["message"] == "AUTHENTICATE":
        found = "NTLM"
    if server_port == KERBEROS_PORT and (k := binary.kerberos(data)) and k["message"] in ("AS-REQ", "TGS-REQ"):
        found = "Kerberos"
    if server_port in LDAP_PORTS and (m := binary.ldap(data)) and m["cleartext"]:
        found = "LDAP"
    return found


def refusals(data: bytes, server_port: int) -> list[str]:
    """Services that a server's bytes refuse a login on, one entry for each refusal."""
    out = []
    if (answer := text.http_response(data)) and answer["stat_code"] == "401":
        out.append("HTTP")
    if server_port in REFUSING_LINES:
        start, service = REFUSING_LINES[server_port]
        out += [service for line in text.lines(data) if line.startswith(start)]
    if (m := binary.smb2(data)) and m["command"] == "SESSION_SETUP" and m["status"] in SMB_REFUSED:
        out.append("SMB")
    if server_port == KERBEROS_PORT and (k := binary.kerberos(data)) and k["error"] in KERBEROS_REFUSED:
        out.append("Kerberos")
    if server_port in LDAP_PORTS and (m := binary.ldap(data)) and m["result"] == LDAP_REFUSED:
        out.append("LDAP")
    return out


def marks(data: bytes) -> list[str]:
    """Flow bits that name the protocols spoken, in the order of their parsers."""
    out = []
    if text.http_request(data) or text.http_response(data):
        out.append("app.http")
    if binary.client_hello(data) or binary.server_hello(data):
        out.append("app.tls")
    if binary.rdp_cookie(data) is not None:
        out.append("app.rdp")
    if text.ssh_version(data):
        out.append("app.ssh")
    lines = text.lines(data)
    if any(text.ftp_command(x) for x in lines):
        out.append("app.ftp")
    if any(text.smtp_command(x) for x in lines):
        out.append("app.smtp")
    if binary.smb2(data) or binary.smb1(data):
        out.append("app.smb")
    return out
