"""Parsers over constructed bytes, whole, cut short and damaged; captures; feeds; sinks."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from netlume.parse import binary, text
from netlume.parse.registry import PARSERS, parsed, rule_buffers
from netlume.sinks import render
from netlume.sources import capture, feeds


def tlv(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


def hello(kind, body):
    message = bytes([kind]) + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + len(message).to_bytes(2, "big") + message


def client_hello():
    name = b"a.example.org"
    ext = lambda k, b: struct.pack(">HH", k, len(b)) + b
    exts = ext(0x0A0A, b"") + ext(0, struct.pack(">HBH", len(name) + 3, 0, len(name)) + name) + ext(10, struct.pack(">HHH", 4, 29, 23)) + ext(11, b"\x01\x00")
    return hello(1, b"\x03\x03" + bytes(32) + b"\x00" + struct.pack(">HHHH", 6, 0x1A1A, 4865, 49195) + b"\x01\x00" + struct.pack(">H", len(exts)) + exts)


def certificate():
    name = lambda cn: tlv(0x30, tlv(0x31, tlv(0x30, tlv(6, bytes([0x55, 4, 3])) + tlv(0x0C, cn))))
    body = tlv(0xA0, tlv(2, b"\2")) + tlv(2, b"\x01\xab") + tlv(0x30, b"") + name(b"Root") + tlv(0x30, b"") + name(b"leaf.example") + tlv(0x30, b"")
    return tlv(0x30, tlv(0x30, body) + tlv(0x30, b"") + tlv(3, b"\0"))


def kerberos_request():
    principal = lambda s: tlv(0x30, tlv(0xA0, tlv(2, b"\1")) + tlv(0xA1, tlv(0x30, b"".join(tlv(0x1B, x) for x in s))))
    body = tlv(0x30, tlv(0xA1, principal([b"ann"])) + tlv(0xA2, tlv(0x1B, b"REALM")) + tlv(0xA3, principal([b"krbtgt", b"REALM"])))
    return tlv(0x6A, tlv(0x30, tlv(0xA1, tlv(2, b"\5")) + tlv(0xA2, tlv(2, b"\x0a")) + tlv(0xA4, body)))


def ntlm_message():
    parts, at, out = [], 64, b"NTLMSSP\0" + struct.pack("<I", 3) + bytes(16)
    for s in ("DOM", "ann", "PC"):
        raw = s.encode("utf-16-le")
        out += struct.pack("<HHI", len(raw), len(raw), at)
        parts.append(raw)
        at += len(raw)
    return out + bytes(8) + struct.pack("<I", 1) + b"".join(parts)


def smb2_create():
    name = "a\\b.exe".encode("utf-16-le")
    head = b"\xfeSMB" + struct.pack("<HHI", 64, 0, 0) + struct.pack("<HH", 5, 1) + struct.pack("<I", 0) + bytes(44)
    return head[:64] + bytes(44) + struct.pack("<HH", 120, len(name)) + bytes(8) + name


SAMPLES = {
    binary.dns_question: (b"\0\1\1\0\0\1\0\0\0\0\0\0\3www\7example\3org\0\0\1\0\1", "www.example.org"), binary.client_hello: (client_hello(), None), binary.certificate: (certificate(), {"serial": "01:AB", "issuer": "CN=Root", "subject": "CN=leaf.example"}),
    binary.kerberos: (kerberos_request(), {"message": "AS-REQ", "realm": "REALM", "client": "ann", "service": "krbtgt/REALM", "error": None}), binary.ntlm: (ntlm_message(), {"message": "AUTHENTICATE", "domain": "DOM", "user": "ann", "workstation": "PC"}),
    binary.smb2: (smb2_create(), {"command": "CREATE", "filename": "a\\b.exe", "status": None}), binary.ldap: (tlv(0x30, tlv(2, b"\1") + tlv(0x60, tlv(2, b"\3") + tlv(4, b"cn=x") + tlv(0x80, b"pw"))), {"operation": "bindRequest", "dn": "cn=x", "cleartext": True, "result": None}),
    binary.modbus: (b"\0\1\0\0\0\6\1\6\0\x10\0\1", {"function": "WRITE_SINGLE_REGISTER", "address": 16}), binary.tftp: (b"\0\2boot.bin\0octet\0", {"opcode": "WRQ", "filename": "boot.bin"}), binary.snmp_community: (tlv(0x30, tlv(2, b"\1") + tlv(4, b"public") + tlv(0xA0, b"")), "public"),
    binary.rdp_cookie: (b"\3\0\0\x2a\x25\xe0\0\0\0\0\0Cookie: mstshash=administr\r\n\1\0\x08\0", None), binary.dnp3_function: (b"\x05\x64\x08\xc4\1\0\2\0\0\0" + b"\xc0\xc0\x05" + b"\0\0", "DIRECT_OPERATE"),
}


@pytest.mark.parametrize("parser", SAMPLES, ids=lambda p: p.__name__)
def test_binary_parsers(parser):
    data, want = SAMPLES[parser]
    assert parser(data) == want if want is not None else parser(data) is not None
    for n in range(len(data)):
        parser(data[:n])  # never fails
    rng = random.Random(3)
    for _ in range(300):
        broken = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        parser(bytes(broken))


def test_client_hello_fields():
    got = binary.client_hello(client_hello())
    assert got["sni"] == "a.example.org" and got["ja3_text"] == "771,4865-49195,0-10-11,29-23,0"
    server = hello(2, b"\x03\x03" + bytes(32) + b"\0" + struct.pack(">HB", 4865, 0) + struct.pack(">HHHH", 6, 43, 2, 0x304))
    assert binary.server_hello(server)["version"] == "TLS 1.3" and binary.server_hello(server[:-1]) is None
    der = certificate()
    chain = (len(der) + 3).to_bytes(3, "big") + len(der).to_bytes(3, "big") + der
    assert binary.certificate_chain(hello(11, chain)) == [der]


def test_text_parsers():
    request = b"POST /a?b HTTP/1.1\r\nHost: x.org:80\r\nHost: y\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    got = text.http_request(request)
    assert (got["method"], got["uri"], got["host"], got["body"], got["header_names"]) == ("POST", "/a?b", "x.org", b"abc", "\r\nHost\r\nHost\r\nTransfer-Encoding\r\n\r\n")
    assert all(text.http_request(request[:n]) is None for n in range(request.index(b"\r\n\r\n") + 3)) and text.http_request(b"BREW / HTTP/1.1\r\n\r\n") is None
    answer = text.http_response(b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\r\nContent-Length: 2\r\n\r\nhi")
    assert (answer["stat_code"], answer["set_cookie"], answer["content_length"], answer["body"]) == ("200", "a, b", 2, b"hi")
    assert text.dechunked(b"2;x\r\nab\r\n0\r\n") == b"ab" and text.dechunked(b"z\r\n") is None and text.dechunked(b"5\r\nab") is None
    assert text.smtp_command(b"MAIL FROM:<a@b> SIZE=1")["sender"] == "a@b" and text.smtp_command(b"hello?") is None
    assert text.ftp_command(b"retr x") == "retr x" and text.ssh_version(b"SSH-2.0-x\r\nrest") == "SSH-2.0-x" and text.ssh_version(b"SSH-2.0-x") is None
    assert text.lines(b"a\r\nb\nc") == [b"a", b"b"] and text.file_identity(b"%PDF-1")["type"] == "pdf"


def test_parsers_as_columns(spark):
    df = spark.createDataFrame([(1, b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "to_server"), (2, b"junk", "to_server"), (3, None, "to_client")], "k bigint, stream binary, direction string")
    assert {r["k"]: r["m"] for r in df.select("k", parsed("http_request", F.col("stream")).alias("p")).select("k", F.col("p.method").alias("m")).collect()} == {1: "GET", 2: None, 3: None}
    assert sorted((r["k"], r["buffer"], bytes(r["data"])) for r in rule_buffers(df, ["http.uri", "http.host", "dns.query"], ["k"]).collect()) == [(1, "http.host", b"h"), (1, "http.uri", b"/")]
    assert len(PARSERS) >= 20


def ipv4(src, dst, proto, body, part=0, ident=1):
    pack = lambda a: bytes(map(int, a.split(".")))
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), ident, part, 64, proto, 0) + pack(src) + pack(dst) + body


def tcp(sport, dport, flags, payload=b"", seq=7):
    return struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 0x50, flags, 1024, 0, 0) + payload


def ether(kind, body, tags=()):
    return bytes(12) + b"".join(struct.pack(">HH", 0x8100, t) for t in tags) + struct.pack(">H", kind) + body


def test_decoding():
    inner = ipv4("1.1.1.1", "2.2.2.2", 6, tcp(1234, 80, 2, b"hi"))
    p = capture.decode(1, ether(0x0800, inner, tags=(5, 6)) + bytes(6))
    assert (p.src, p.dst, p.src_port, p.dst_port, p.tcp_flags, p.tcp_seq, p.payload, p.vlan_id) == ("1.1.1.1", "2.2.2.2", 1234, 80, 2, 7, b"hi", 5)
    for outer in (ipv4("9.9.9.9", "8.8.8.8", 4, inner), ipv4("9.9.9.9", "8.8.8.8", 47, struct.pack(">HH", 0, 0x0800) + inner), ipv4("9.9.9.9", "8.8.8.8", 17, struct.pack(">HHHH", 5, 4789, 0, 0) + b"\x08" + bytes(7) + ether(0x0800, inner))):
        q = capture.decode(101, outer)
        assert (q.src, q.dst_port, q.tunnels) == ("1.1.1.1", 80, 1)
    six = struct.pack(">IHBB", 6 << 28, 8 + 12, 0, 64) + bytes(15) + b"\1" + bytes(15) + b"\2" + b"\x11\0\0\0\0\0\0\0" + struct.pack(">HHHH", 53, 99, 12, 0) + b"data"
    assert (lambda p: (p.src, p.protocol, p.src_port, p.payload))(capture.decode(1, ether(0x86DD, six))) == ("::1", 17, 53, b"data")
    fragment = capture.decode(101, ipv4("1.1.1.1", "2.2.2.2", 6, b"x" * 16, part=0x2000))
    assert fragment.is_fragment and fragment.src_port == 0
    frame = ether(0x0800, inner)
    for n in range(len(frame)):
        capture.decode(1, frame[:n])


def test_defragmentation():
    assert capture.defragment([(8, False, b"B" * 4), (0, True, b"A" * 8)]) == b"A" * 8 + b"B" * 4
    assert capture.defragment([(0, True, b"A" * 8), (4, False, b"B" * 8)]) == b"A" * 8 + b"B" * 4 and capture.defragment([(0, True, b"A" * 8), (4, False, b"B" * 8)], last_wins=True) == b"A" * 4 + b"B" * 8
    assert capture.defragment([(8, False, b"x")]) is None and capture.defragment([(0, True, b"x")]) is None


def test_datagrams_of_a_reused_identification(spark):
    def sent(ts, *parts):
        at, out = 0, []
        for k, b in enumerate(parts):
            out.append((ts + k, 1, 0, ether(0x0800, ipv4("3.3.3.3", "4.4.4.4", 17, b, part=(0x2000 if k < len(parts) - 1 else 0) | at // 8, ident=9))))
            at += len(b)
        return out

    frames = sent(0, b"a" * 8, b"b") + sent(5_000_000, b"c" * 16, b"d") + sent(8_000_000, b"lost    ", b"-")[:1] + sent(60_000_000, b"e" * 8, b"f") + sent(200_000_000, b"g" * 20_000, b"h" * 5)
    packets = capture.decode_frames(spark.createDataFrame(frames, "ts_us bigint, link_type int, frame_len int, raw binary"))
    assert sorted(bytes(r["body"]) for r in capture.defragmented(packets).collect()) == [b"a" * 8 + b"b", b"c" * 16 + b"d", b"e" * 8 + b"f", b"g" * 20_000 + b"h" * 5]


def test_captures_through_spark(spark, tmp_path):
    frames = [(1_000_000 + k, ether(0x0800, ipv4("1.1.1.1", "2.2.2.2", 6, tcp(1000 + k, 22, 2)))) for k in range(5)] + [(9_000_000, b"short")]
    pieces = [(10_000_000, ether(0x0800, ipv4("3.3.3.3", "4.4.4.4", 17, b"a" * 8, part=0x2000, ident=9))), (10_000_001, ether(0x0800, ipv4("3.3.3.3", "4.4.4.4", 17, b"b" * 3, part=1, ident=9)))]
    (tmp_path / "a.pcap").write_bytes(capture.write_pcap_bytes([*frames, *pieces]) + b"cut")
    (tmp_path / "b.pcap").write_bytes(b"not a capture")
    read = capture.read_pcap(spark, f"file://{tmp_path}")
    packets = capture.decode_frames(read)
    assert read.count() == 8 and packets.filter("dst_port = 22").count() == 5
    assert [bytes(r["body"]) for r in capture.defragmented(packets).collect()] == [b"a" * 8 + b"b" * 3]
    (tmp_path / "c.pcap").write_bytes(capture.write_pcap_bytes(frames))
    near = capture.around_alerts(read, read.filter("path LIKE '%a.pcap' AND frame_no = 4").select(F.lit(1).alias("alert_id"), "path", F.col("frame_no").alias("at_frame")), last=3)
    assert sorted(r["frame_no"] for r in near.collect()) == [2, 3, 4]


def test_feeds(spark, tmp_path):
    (tmp_path / "deny.txt").write_text("# head\n1.2.3.4 # x\n\n1.2.3.4\n")
    assert [r["address"] for r in feeds.deny_list(spark, f"file://{tmp_path}/deny.txt").collect()] == ["1.2.3.4"]
    (tmp_path / "rep.txt").write_text("10.0.0.0/30 ; lab\nEvil.org # bad\n0123456789abcdef0123456789abcdef\nip:::1\n# none\n")
    got = sorted((r["kind"], r["value"], r["tag"], r["lo"], r["hi"]) for r in feeds.reputation(spark, f"file://{tmp_path}/rep.txt").collect() if r["kind"] != "ip" or r["lo"])
    assert got == [("domain", "evil.org", "bad", None, None), ("ip", "10.0.0.0/30", "lab", 167772160, 167772163), ("ja3", "0123456789abcdef0123456789abcdef", "", None, None)]
    assert feeds.allow_entry("category:SCAN port:80 # x") == {"category": "SCAN", "port": 80} and feeds.allow_entry("# x") is None
    assert feeds.home_networks("10.0.0.0/31, 1.1.1.1") == [(167772160, 167772161), (16843009, 16843009)]
    assert feeds.config_entries("a = 1 # c\nb=\"x\"\na=2\n") == [("a", "1"), ("b", "x"), ("a", "2")] and feeds.duration("5m") == 300 and feeds.size("2M") == 2 << 20


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, "high", "SCAN", "a", "b", "tcp", 80, 5, 'say "hi"\n', 2)], "ts_sec bigint, seq bigint, severity string, category string, src string, dst string, proto string, port int, sid bigint, message string, suppressed bigint")
    (line,) = [r["value"] for r in render.text_line(df).collect()]
    assert line.startswith("00:00:00 [HIGH  ] SCAN ") and line.endswith("(2 more suppressed)")
    assert json.loads(render.ndjson(df).first()["value"])["message"] == 'say "hi"\n'
    event = json.loads(render.eve(df).first()["value"])
    assert event["timestamp"] == "1970-01-01T00:00:00.000000+0000" and event["alert"]["severity"] == 1
    render.write_all(df, {"eve": f"file://{tmp_path}/eve", "text": f"file://{tmp_path}/text"})
    assert spark.read.text(f"file://{tmp_path}/eve").count() == 1
    assert render.prometheus({"alerts": 3}) == "# TYPE netlume_alerts_total counter\nnetlume_alerts_total 3\n"
