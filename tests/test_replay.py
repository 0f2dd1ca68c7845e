"""Captures with one attack each, from frames to alerts."""

import pytest

from netlume import __main__ as cli
from netlume.plans import messages as m
from netlume.plans.replay import Settings, replay, replay_frames
from netlume.rules.parser import parse_rules
from netlume.sources import capture, feeds

SYN, SYNACK, ACK, FIN, RST = 2, 18, 16, 17, 4


class Wire:
    """Frames in order, a millisecond apart unless told otherwise."""

    def __init__(self):
        self.frames, self.now = [], 1_700_000_000_000_000

    def put(self, packet: bytes, wait: float = 0.001) -> None:
        self.now += int(wait * 1_000_000)
        self.frames.append((self.now, m.ether(0x0800, packet)))

    def talk(self, src, dst, sport, dport, said=(), answered=True, close=True, wait=0.001):
        """A connection; said: (from the client, bytes)."""
        up = lambda flags, data=b"", seq=0: self.put(m.ipv4(src, dst, 6, m.tcp(sport, dport, flags, data, seq)), wait if flags == SYN else 0.001)
        down = lambda flags, data=b"", seq=0: self.put(m.ipv4(dst, src, 6, m.tcp(dport, sport, flags, data, seq)))
        up(SYN, seq=99)
        if not answered:
            return
        down(SYNACK, seq=499)
        at = {True: 100, False: 500}
        for mine, data in said:
            (up if mine else down)(ACK, data, at[mine])
            at[mine] += len(data)
        if close:
            up(FIN, seq=at[True])
            down(FIN, seq=at[False])
            up(ACK, seq=at[True] + 1)


def run(spark, wire, **settings):
    frames = spark.createDataFrame([("a", k, ts, 1, len(raw), bytearray(raw)) for k, (ts, raw) in enumerate(wire.frames)], "path string, frame_no bigint, ts_us bigint, link_type int, frame_len int, raw binary")
    alerts, records = replay_frames(frames, Settings(**settings))
    return [(r["category"], r["severity"], r["src"], r["dst"]) for r in alerts.collect()], records


A, V, S = "10.66.0.66", "10.0.0.10", "203.0.113.50"


def scan(w):
    for k in range(30):
        w.talk(A, V, 40_000, 1000 + k, answered=False)


def sweep(w):
    for k in range(30):
        w.talk(A, f"10.0.1.{k}", 40_000, 445, answered=False, wait=1)


def brute(w):
    for k in range(10):
        w.talk(A, V, 40_000 + k, 21, [(True, b"USER root\r\n"), (False, b"530 no\r\n")], wait=2)


def beacon(w):
    for k in range(12):
        w.talk(V, S, 40_000 + k, 8443, [(True, b"x")], wait=20)


def tunnel(w):
    import hashlib

    for k in range(60):
        w.put(m.ipv4(V, "10.0.0.1", 17, m.udp(5353, 53, m.dns_question(f"{hashlib.md5(bytes([k])).hexdigest()}.evil.org", k))))


def upload(w):
    for k in range(700):
        w.put(m.ipv4(V, S, 6, m.tcp(5000, 9000, ACK, bytes(9000), k * 9000)))
    w.put(m.ipv4(S, V, 6, m.tcp(9000, 5000, RST)))


@pytest.mark.parametrize(("attack", "want"), [(scan, ("PORT_SCAN", "medium", A, V)), (sweep, ("HORIZONTAL_SCAN", "high", A, "10.0.1.25")), (brute, ("BRUTE_FORCE", "high", A, V)), (beacon, ("BEACONING", "medium", V, S)), (tunnel, ("DNS_TUNNEL", "high", V, "10.0.0.1")), (upload, ("DATA_EXFIL_RATIO", "medium", V, S))])
def test_attacks(spark, attack, want):
    w = Wire()
    w.talk(V, S, 30_000, 80, [(True, m.http_request("benign", 0)), (False, m.http_response("benign", 0))])
    attack(w)
    got, _ = run(spark, w)
    assert [(c, s, a) for c, s, a, _ in got] == [want[:3]] and (got[0][3] in (want[3], None) or want[0] == "HORIZONTAL_SCAN")


def test_signatures_feeds_and_records(spark, tmp_path):
    w = Wire()
    w.talk(A, V, 1234, 80, [(True, m.http_request("name", 3)), (False, m.http_response("name", 0)), (True, m.http_request("name", 4))])
    w.talk(A, V, 1235, 22, [(True, b"SSH-2.0-evil\r\n")], close=False)
    w.put(m.ipv4(A, "8.8.8.8", 17, m.udp(999, 53, m.dns_question("x.bad.org", 1))))
    w.put(m.ipv4("9.9.9.9", V, 17, m.udp(1, 2, b"marker")), wait=400)
    rules, _ = parse_rules(
        'rule sid:1; name:"uri"; severity:low; buffer:http.uri; content:"/name"; flowbits:set,seen;\nrule sid:2; name:"after"; buffer:http.stat_msg; content:"Said"; flowbits:isset,seen;\nrule sid:3; name:"ssh"; content:"SSH-"; flowbits:isset,app.ssh; proto:tcp;\n'
        'rule sid:4; name:"never"; content:"HTTP"; flowbits:isset,app.ssh;\nrule sid:5; name:"dns"; buffer:dns.query; content:"bad"; proto:udp; dst_port:53;\nrule sid:6; name:"quiet"; content:"marker"; noalert;\nrule sid:7; name:"both"; buffer:http.method; content:"POST"; buffer:http.server; content:"s/";'
    )
    lines = spark.createDataFrame([(x,) for x in ("bad.org # listed", "ip:9.9.9.0/24 # net")], "value string")
    denied = spark.createDataFrame([("9.9.9.9",)], "address string")
    allowed = spark.createDataFrame([("blacklist_ip", None, None, 77)], "category string, src string, dst string, port int")
    frames = spark.createDataFrame([("a", k, ts, 1, len(raw), bytearray(raw)) for k, (ts, raw) in enumerate(w.frames)], "path string, frame_no bigint, ts_us bigint, link_type int, frame_len int, raw binary")
    alerts, records = replay_frames(frames, Settings(work=f"file://{tmp_path}", rules=rules, denied=denied, indicators=feeds.reputation_of(lines), allowed=allowed, home=feeds.home_ranges("10.0.0.0/8")))
    got = sorted((r["category"], r["sid"], r["message"], r["direction"]) for r in alerts.collect())
    assert [g[:3] for g in got if g[0] == "SIGNATURE_MATCH"] == [("SIGNATURE_MATCH", k, n) for k, n in ((1, "uri"), (2, "after"), (3, "ssh"), (5, "dns"), (7, "both"))]
    assert [g[0] for g in got if g[0] != "SIGNATURE_MATCH"] == ["BLACKLIST_IP", "THREAT_INTEL"] and {r["src_tag"] for r in alerts.collect() if r["category"] == "BLACKLIST_IP"} == {"net"}
    assert {d for c, _, _, d in got if c == "BLACKLIST_IP"} == {"inbound"} and {d for *_, s, d in got if s == "uri"} == {"internal"}
    states = {r["src_port"]: (r["state"], r["pkts_to_server"], r["pkts_to_client"]) for r in records.collect()}
    assert states == {1234: ("closed", 4, 3), 1235: ("timeout", 2, 1)}


def test_fragments_are_read_as_one(spark):
    w = Wire()
    body = m.udp(5000, 9999, b"a marker in two pieces")
    w.put(m.ipv4(A, V, 17, body[16:], part=2, ident=7))
    w.put(m.ipv4(A, V, 17, body[:16], part=0x2000, ident=7))
    rules, _ = parse_rules('rule sid:1; content:"marker in two"; proto:udp; dst_port:9999;')
    assert [g[0] for g in run(spark, w, rules=rules)[0]] == ["SIGNATURE_MATCH"]


def test_filter_empty_captures_and_command_line(spark, tmp_path, capsys):
    w = Wire()
    scan(w)
    assert run(spark, w, filter="udp")[0] == [] and run(spark, w, filter="src net 10.66.0.0/16")[0]
    (tmp_path / "a.pcap").write_bytes(capture.write_pcap_bytes([]))
    alerts, records = replay(spark, f"file://{tmp_path}/a.pcap", Settings(rules=parse_rules('rule sid:1; content:"a";')[0]))
    assert alerts.count() == 0 and records.count() == 0
    (tmp_path / "b.pcap").write_bytes(capture.write_pcap_bytes(w.frames))
    (tmp_path / "netlume.conf").write_text(f"capture = file://{tmp_path}/b.pcap\nsuppress = 1m\n")
    (tmp_path / "rules").write_text('rule sid:1; content:"a";\nbroken|x\n')
    assert cli.main(["replay", "--config", f"{tmp_path}/netlume.conf", "--format", "ndjson", "--flow-log", f"file://{tmp_path}/flows", "--work", f"file://{tmp_path}/work"]) == 0
    out = capsys.readouterr().out
    assert '"category":"PORT_SCAN"' in out and spark.read.text(f"{tmp_path}/flows/*").count() == 30
    assert cli.main(["check", f"{tmp_path}/rules"]) == 1 and cli.main(["template"]) == 0 and "suppress = 15s" in capsys.readouterr().out
    assert cli.main([]) == 2
    with pytest.raises(SystemExit):
        (tmp_path / "bad.conf").write_text("bogus = 1\n")
        cli.settings_of(["--config", f"{tmp_path}/bad.conf"])
