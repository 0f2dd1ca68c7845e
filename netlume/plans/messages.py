"""Protocol messages built from a name and a number, so that parsers can be queried over tables without packets."""

from __future__ import annotations

import struct

from netlume.parse import quic


def tlv(tag: int, body: bytes) -> bytes:
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


def record(kind: int, body: bytes) -> bytes:
    message = bytes([kind]) + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + len(message).to_bytes(2, "big") + message


def extension(kind: int, body: bytes) -> bytes:
    return struct.pack(">HH", kind, len(body)) + body


def dns_question(name: str, k: int) -> bytes:
    labels = b"".join(bytes([len(x)]) + x.encode() for x in name.split("."))
    return struct.pack(">6H", k & 0xFFFF, 0x0100, 1, 0, 0, 0) + labels + b"\0\0\1\0\1"


def client_hello(name: str, k: int) -> bytes:
    """Two ciphers, one of them by k, and a made-up one that fingerprints leave out."""
    host = name.encode()
    sni = extension(0, struct.pack(">HBH", len(host) + 3, 0, len(host)) + host)
    exts = extension(0x1A1A, b"") + sni + extension(10, struct.pack(">HHH", 4, 29, 23 + k % 3)) + extension(11, b"\x01\x00")
    return record(1, b"\x03\x03" + bytes(32) + b"\x00" + struct.pack(">HHHH", 6, 0x0A0A, 4865, 49195 + k % 5) + b"\x01\x00" + struct.pack(">H", len(exts)) + exts)


def server_hello(name: str, k: int) -> bytes:
    chosen = extension(43, b"\x03\x04") if k % 2 else b""
    tail = struct.pack(">H", len(chosen)) + chosen if chosen else b""
    return record(2, b"\x03\x03" + bytes(32) + b"\0" + struct.pack(">HB", 4865 + k % 3, 0) + tail)


def certificate(name: str, k: int) -> bytes:
    """DER of a certificate with serial number k, issuer Root and the name as its subject."""
    names = lambda parts: tlv(0x30, b"".join(tlv(0x31, tlv(0x30, tlv(6, bytes([0x55, 4, oid])) + tlv(0x0C, v.encode()))) for oid, v in parts))
    serial = (k + 256).to_bytes(4, "big").lstrip(b"\0")
    body = tlv(0xA0, tlv(2, b"\2")) + tlv(2, serial) + tlv(0x30, b"") + names([(3, "Root"), (10, "Org")]) + tlv(0x30, b"") + names([(3, name)]) + tlv(0x30, b"")
    return tlv(0x30, tlv(0x30, body) + tlv(0x30, b"") + tlv(3, b"\0"))


def quic_initials(names: list[str], numbers: list[int]) -> list[bytes]:
    packets = []
    for name, k in zip(names, numbers, strict=True):
        hello = client_hello(name, k)[5:]
        packets.append((k.to_bytes(8, "big"), [(0, hello[:40]), (40, hello[40:])], 0x6B3343CF if k % 2 else 1, b"\x07", k))
    return quic.sealed_initials(packets, least=200)


def quic_initial(name: str, k: int) -> bytes:
    return quic_initials([name], [k])[0]


#: Messages that are built many at a time.
BATCHES = {quic_initial: quic_initials}


def smb2(name: str, k: int) -> bytes:
    """CREATE of a file, or the refusal of a SESSION_SETUP by a server."""
    if k % 3 == 0:
        return b"\0\0\0\x40" + b"\xfeSMB" + struct.pack("<HHI", 64, 0, 0xC000006D) + struct.pack("<HHI", 1, 1, 1) + bytes(44)
    file = name.encode("utf-16-le")
    head = b"\xfeSMB" + struct.pack("<HHI", 64, 0, 0) + struct.pack("<HHI", 5, 1, 0) + bytes(44)
    return head[:64] + bytes(44) + struct.pack("<HH", 120, len(file)) + bytes(8) + file


def smb1(name: str, k: int) -> bytes:
    """TREE_CONNECT of a share, in wide characters for odd numbers, or an OPEN."""
    code, wide = (0x75, bool(k % 2)) if k % 3 else (0x2D, False)
    text = (f"\\\\host\\{name}$" if code == 0x75 else name) + "\0"
    data = text.encode("utf-16-le" if wide else "ascii") + (b"?????\0" if code == 0x75 and not wide else b"")
    return b"\xffSMB" + bytes([code]) + bytes(5) + (b"\x00\x80" if wide else b"\0\0") + bytes(20) + b"\0" + len(data).to_bytes(2, "little") + data


def ntlm(name: str, k: int) -> bytes:
    parts, at, out = [], 64, b"NTLMSSP\0" + struct.pack("<I", 3) + bytes(16)
    for s in ("DOM", name, f"PC{k}"):
        raw = s.encode("utf-16-le")
        out += struct.pack("<HHI", len(raw), len(raw), at)
        parts.append(raw)
        at += len(raw)
    return b"junk" * (k % 3) + out + bytes(8) + struct.pack("<I", 1) + b"".join(parts)


def _principal(parts: list[str]) -> bytes:
    return tlv(0x30, tlv(0xA0, tlv(2, b"\1")) + tlv(0xA1, tlv(0x30, b"".join(tlv(0x1B, x.encode()) for x in parts))))


def kerberos(name: str, k: int) -> bytes:
    """A request for a ticket, or every third time an error with a code."""
    if k % 3 == 0:
        code = (6, 18, 24, 7)[k // 3 % 4]
        return tlv(0x7E, tlv(0x30, tlv(0xA0, tlv(2, b"\5")) + tlv(0xA1, tlv(2, b"\x1e")) + tlv(0xA6, tlv(2, bytes([code]))) + tlv(0xA9, tlv(0x1B, b"REALM")) + tlv(0xAA, _principal(["krbtgt"]))))
    body = tlv(0x30, tlv(0xA1, _principal([name])) + tlv(0xA2, tlv(0x1B, b"REALM")) + tlv(0xA3, _principal(["krbtgt", "REALM"])))
    return tlv(0x6A, tlv(0x30, tlv(0xA1, tlv(2, b"\5")) + tlv(0xA2, tlv(2, b"\x0a")) + tlv(0xA4, body)))


def ldap(name: str, k: int) -> bytes:
    """A bind with a password, or the server's answer to one."""
    if k % 3 == 0:
        return tlv(0x30, tlv(2, b"\1") + tlv(0x61, tlv(0x0A, bytes([49 if k % 2 else 0])) + tlv(4, b"") + tlv(4, b"")))
    return tlv(0x30, tlv(2, b"\1") + tlv(0x60, tlv(2, b"\3") + tlv(4, f"cn={name}".encode()) + tlv(0x80, b"pw")))


def dcerpc(name: str, k: int) -> bytes:
    head = lambda kind: bytes([5, 0, kind, 3, 0x10, 0, 0, 0]) + bytes(8)
    if k % 2:
        return head(0) + bytes(6) + struct.pack("<H", k % 100) + bytes(8)
    return head(11) + bytes(16) + struct.pack("<IHH", k, 0x1234, 0xABCD) + bytes(range(8)) + bytes(20)


def modbus(name: str, k: int) -> bytes:
    code = (3, 5, 6, 16, 99)[k % 5]
    return struct.pack(">HHHBB", k & 0xFFFF, 0, 6, 1, code) + struct.pack(">HH", k & 0xFFFF, 1)


def rdp(name: str, k: int) -> bytes:
    said = f"Cookie: mstshash={name}\r\n".encode() if k % 3 else b""
    body = said + b"\1\0\x08\0\0\0\0\0"
    return b"\3\0" + (11 + len(body)).to_bytes(2, "big") + bytes([6 + len(body), 0xE0, 0, 0, 0, 0, 0]) + body


def tftp(name: str, k: int) -> bytes:
    return struct.pack(">H", 1 + k % 2) + name.encode() + b"\0octet\0"


def snmp(name: str, k: int) -> bytes:
    return tlv(0x30, tlv(2, bytes([k % 3])) + tlv(4, name.encode()) + tlv(0xA0, b""))


def dnp3(name: str, k: int) -> bytes:
    user = b"\xc0\xc0" + bytes([(1, 5, 13, 200)[k % 4]]) + bytes(k % 40)
    blocks = b"".join(user[n : n + 16] + b"\xee\xee" for n in range(0, len(user), 16))
    return b"\x05\x64" + bytes([5 + len(user), 0xC4, 1, 0, 2, 0]) + b"\xdd\xdd" + blocks


def http_request(name: str, k: int) -> bytes:
    body = name.encode() * (k % 3)
    framed = b"".join(b"%x;x=y\r\n%s\r\n" % (len(body[n : n + 7]), body[n : n + 7]) for n in range(0, len(body), 7)) + b"0\r\n\r\n"
    return f"POST /{name}?q={k} HTTP/1.1\r\nHost: {name}.example.org:8080\r\nUser-Agent: agent/{k}\r\nhost: other\r\nAccept:  */* \r\nReferer: r{k}\r\nTransfer-Encoding: chunked\r\n\r\n".encode() + framed


def http_response(name: str, k: int) -> bytes:
    code = (200, 401, 404)[k % 3]
    return f"HTTP/1.1 {code} Said {k}\r\nServer: s/{k}\r\nSet-Cookie: a={k}\r\nLocation: /{name}\r\nset-cookie: b\r\nContent-Length: {len(name)}\r\n\r\n{name}".encode()


def lines(name: str, k: int) -> bytes:
    """A session of a line protocol by k: FTP, SMTP, SSH."""
    if k % 3 == 0:
        return f"user {name}\r\nPASS x\nRETR {k}\r\nunfinished".encode()
    if k % 3 == 1:
        return f"EHLO {name}\r\nAUTH LOGIN\r\nMAIL FROM:<{name}@a.org> SIZE=1\r\nRCPT TO:<k{k}@b.org>\r\n".encode()
    return f"SSH-2.0-{name}\r\nrest".encode()


# frames ----------------------------------------------------------------------------------------------------------------


def ipv4(src: str, dst: str, proto: int, body: bytes, part: int = 0, ident: int = 1) -> bytes:
    packed = bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), ident, part, 64, proto, 0) + packed + body


def ipv6(last: int, proto: int, body: bytes) -> bytes:
    return struct.pack(">IHBB", 6 << 28, len(body), proto, 64) + b"\x20\x01\x0d\xb8" + bytes(10) + struct.pack(">H", last & 0xFFFF) + b"\xff\x02" + bytes(13) + b"\x01" + body


def tcp(sport: int, dport: int, flags: int, payload: bytes = b"", seq: int = 7) -> bytes:
    return struct.pack(">HHIIBBHHH", sport, dport, seq & 0xFFFFFFFF, 0, 0x50, flags, 1024, 0, 0) + payload


def udp(sport: int, dport: int, payload: bytes) -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def ether(kind: int, body: bytes, tags: tuple[int, ...] = ()) -> bytes:
    return bytes(12) + b"".join(struct.pack(">HH", 0x8100, t) for t in tags) + struct.pack(">H", kind) + body


def address(k: int) -> str:
    return f"10.{k // 65536 % 256}.{k // 256 % 256}.{k % 256}"


def frame(name: str, k: int) -> tuple[int, bytes]:
    """(link type, bytes), a kind of frame for each remainder of k by 12."""
    data, kind = name.encode(), k % 12
    plain = ipv4(address(k), "192.0.2.1", 6, tcp(1024 + k % 60000, 80, 2 if k % 2 else 18, data, k))
    datagram = ipv4(address(k), "192.0.2.1", 17, udp(5000, 53, data))
    inner = ether(0x0800, plain)
    return [
        (1, ether(0x0800, plain)), (1, ether(0x0800, datagram, tags=(k % 4000 + 1, 7))), (101, plain), (0, struct.pack("<I", 2) + plain), (113, bytes(14) + b"\x08\x00" + plain), (276, b"\x08\x00" + bytes(18) + datagram),
        (1, ether(0x86DD, ipv6(k, 58, b"\x87\x01" + bytes(6) + data))), (101, ipv4("198.51.100.1", "198.51.100.2", 4, plain)), (101, ipv4("198.51.100.1", "198.51.100.2", 47, struct.pack(">HH", 0, 0x6558) + inner)),
        (101, ipv4("198.51.100.1", "198.51.100.2", 17, udp(9, 4789, b"\x08" + bytes(7) + inner))), (1, ether(0x0806, data)), (147, plain),
    ][kind]


def fragments(name: str, k: int) -> list[bytes]:
    """A datagram in two pieces, the last one first for odd numbers; every fifth has lost its first piece."""
    body = udp(5000, 9999, name.encode() * 3)
    cut = 16
    a, b = ipv4(address(k), "192.0.2.9", 17, body[:cut], part=0x2000, ident=k % 7), ipv4(address(k), "192.0.2.9", 17, body[cut:], part=cut // 8, ident=k % 7)
    return [b] if k % 5 == 0 else [b, a] if k % 2 else [a, b]
