"""Packet filters, feeds, flows, sinks and rule windows on inputs that once went wrong."""

import socket
import struct
import threading
import time
import urllib.request

import pytest
from pyspark.sql import functions as F

from netlume.functions import scalars
from netlume.operators import bodies, enrich, flows, observe
from netlume.parse import auth, quic, text
from netlume.plans import catalogue, messages
from netlume.rules.matcher import RuleSet, match
from netlume.rules.parser import parse_rules
from netlume.rules.state import alerts
from netlume.sinks import metrics, render, syslog
from netlume.sources import capture, feeds
from netlume.sources.packet_filter import FilterError, packet_filter


def hit(terms, data):
    rules, _ = parse_rules(f"rule sid:1; buffer:http.uri; {terms}")
    return bool(RuleSet(rules).check("http.uri", "to_server", data))


def test_patterns_search_in_their_window():
    assert hit('pcre:"a.*"; depth:5;', b"abcdefghij") and hit('pcre:"^bc"; offset:1;', b"abc") and hit('content:"x"; pcre:"[0-9]+"; within:3;', b"x123456")
    assert not hit('pcre:"f"; depth:5;', b"abcdefghij") and hit('content:"a"; pcre:"(?<=a)b"; relative;', b"ab")


def test_patterns_without_end_are_given_up():
    began = time.perf_counter()
    assert not hit('pcre:"(a+)+$";', b"a" * 40 + b"b")
    assert not hit('pcre:"(a|aa)+$";', b"a" * 60 + b"b") and not hit('content:"a"; pcre:!"(a|aa)+$";', b"a" * 60 + b"b")
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("body", [b"5\r\nhello\r\n-6\r\n", b"+5\r\nhello\r\n0\r\n\r\n", b"0x5\r\nhello\r\n0\r\n\r\n", b"1_0\r\n", b"\r\n", b"ffffffffffffffffff\r\n"])
def test_chunk_sizes_are_hexadecimal_only(body):
    assert text.dechunked(body) is None
    tap = bodies.Tap()
    assert list(tap.feed(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body)) == []


def test_bodies_until_the_end_and_several_messages(spark):
    rows = [(1, 0, b"HTTP/1.1 200 OK\r\n\r\nabc"), (1, 1, b"def"), (2, 0, b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\naHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nbb"), (3, 0, b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"), (4, 0, None), (5, 0, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nab\r\n0\r\n\r\n")]
    got = bodies.files(spark.createDataFrame(rows, "k int, seq int, payload binary"), ["k"])
    assert sorted((r["k"], r["size"]) for r in got.collect()) == [(1, 6), (2, 1), (2, 2), (5, 2)]


def test_sequence_numbers_wrap():
    assert flows.assemble([(0xFFFFFFFE, b"ab"), (0, b"cd")]) == b"abcd" and flows.assemble([(0, b"cd"), (0xFFFFFFFE, b"ab")]) == b"abcd"
    assert flows.assemble([(5, b"x"), (3, b"ab"), (3, b"abcd")]) == b"abcd" and flows.assemble([(9, b"z")], first=7) == b""


def test_reassembly_with_nulls(spark):
    rows = [(1, 0, 10, b"ab"), (1, 1, None, b"?"), (1, 2, 12, None), (1, 3, 12, b"c"), (None, 0, 1, b"n")]
    got = flows.reassemble(spark.createDataFrame(rows, "k bigint, seq bigint, tcp_seq bigint, payload binary"), ["k"])
    assert {r["k"]: bytes(r["stream"]) for r in got.collect()} == {1: b"abc", None: b"n"}


def test_replies_keep_the_callers_columns(spark):
    df = spark.createDataFrame([(1, 1, "a", "b", "mine", 7), (2, 2, "b", "a", "yours", 8)], "seq bigint, ts_sec bigint, src string, dst string, lo string, hi bigint")
    got = {r["seq"]: r for r in flows.is_reply(df).collect()}
    assert (got[1]["reply"], got[2]["reply"], got[1]["lo"], got[2]["hi"]) == (False, True, "mine", 8)


def test_bad_lines_do_not_stop_a_feed(spark):
    lines = spark.createDataFrame([(x,) for x in ("ip:not-an-address", "ip:10.0.0.0/8 # a", "2001:db8::/32", "", "# x")], "value string")
    got = {r["value"]: r for r in feeds.reputation_of(lines).collect()}
    assert len(got) == 3 and got["not-an-address"]["kind"] == "bad" and got["not-an-address"]["error"] and got["10.0.0.0/8"]["lo"] == 10 << 24 and len(got["2001:db8::/32"]["first"]) == 16
    assert feeds.allowlist("port:http\nsrc:10.0.0.1 port:80\nfoo:1\n# x\nsrc:nowhere") == ([{"src": "10.0.0.1", "port": 80}], [(1, "not a port: http"), (3, "not an entry: foo:1"), (5, "not an address: nowhere")])
    assert feeds.reputation(spark, "file:///nowhere/at/all").count() == 0
    with pytest.raises(ValueError):
        feeds.home_ranges("10.0.0.0/8, x")


def test_networks_of_any_width(spark):
    nets = [("0.0.0.0/0", "all"), ("10.0.0.0/7", "wide"), ("10.1.2.3/32", "one"), ("::/0", "six"), ("2001:db8::/33", "half"), ("2001:db8:8000::1/128", "host")]
    feed = spark.createDataFrame([(bytearray(e[0]), bytearray(e[1]), t) for n, t in nets for e in [feeds.bounds(n)]], "first binary, last binary, tag string")
    rows = spark.createDataFrame([(x,) for x in ("10.1.2.3", "11.0.0.1", "12.0.0.1", "2001:db8:7fff::", "2001:db8:8000::1", "2001:DB8:8000::2", "junk", None)], "a string")
    assert {r["a"]: r["tag"] for r in enrich.in_networks(rows, "a", feed, "tag").collect()} == {"10.1.2.3": "one", "11.0.0.1": "wide", "12.0.0.1": "all", "2001:db8:7fff::": "half", "2001:db8:8000::1": "host", "2001:DB8:8000::2": "six", "junk": None, None: None}


@pytest.mark.parametrize(("filter_", "want"), [("tcp", {1, 2}), ("udp port 53", {3}), ("src host 10.0.0.1 and not dst port 80", {2, 3}), ("net 2001:db8::/32 or port 22", {2, 4}), ("vlan 5", {3}), ("greater 100 and ( icmp6 or vlan )", {4}), ("portrange 80-90", {1}), ("", {1, 2, 3, 4}), ("ip and ! tcp", {3}), ("dst 10.0.0.2", {1, 2, 3})])
def test_packet_filters(spark, filter_, want):
    rows = [(1, "10.0.0.1", "10.0.0.2", 4, 6, 5000, 80, 60, None), (2, "10.0.0.1", "10.0.0.2", 4, 6, 5001, 22, 60, None), (3, "10.0.0.1", "10.0.0.2", 4, 17, 5002, 53, 60, 5), (4, "2001:db8::1", "ff02::1", 6, 58, 0, 0, 500, None)]
    df = spark.createDataFrame([(*r, False) for r in rows], "k int, src string, dst string, ip_version int, protocol int, src_port int, dst_port int, frame_len int, vlan_id int, is_fragment boolean")
    assert {r["k"] for r in df.filter(packet_filter(filter_)).collect()} == want


@pytest.mark.parametrize("bad", ["port", "port x", "host 1.2.3.4/8", "tcp[13] = 2", "(tcp", "tcp)", "and", "net nowhere", "port 1-2", "portrange 5"])
def test_packet_filters_that_cannot_be_used(bad):
    with pytest.raises(FilterError):
        packet_filter(bad)


def test_quic_against_the_published_example():
    """Keys of the worked example, and packets of both versions; nothing but a whole, true packet gives a name."""
    assert [x.hex() for x in quic.initial_keys(bytes.fromhex("8394c8f03e515708"), 1)] == ["1f369613dd76d5467730efcbe3b1a22d", "fa044b2f42a3fd3b46fb255c", "9f50449e04a0e810283a1e9933adedd2"]
    packet = messages.quic_initial("a-name", 3)
    assert quic.quic_initial(packet)["sni"] == "a-name"
    for at in range(0, len(packet), 7):
        broken = bytearray(packet)
        broken[at] ^= 1
        assert quic.quic_initial(bytes(broken)) is None or at >= len(packet)
        quic.quic_initial(packet[:at])
    hello = messages.client_hello("split", 1)[5:]
    pieces = [p for k in (0, 1) for p in quic.quic_pieces(quic.sealed_initial(b"12345678", [(k * 50, hello[k * 50 : 50 if k == 0 else None])], number=k))["pieces"]]
    assert quic.hello_of([(p["offset"], p["data"]) for p in pieces])["sni"] == "split" and quic.hello_of([(p["offset"], p["data"]) for p in pieces[1:]]) is None


def test_quic_packets_share_the_cipher(monkeypatch):
    """Many packets, some of them broken, give what each gives alone, in a few runs of the cipher for all."""
    packets = messages.quic_initials([f"name-{k}" for k in range(300)], list(range(300)))
    packets += [None, b"", b"\xc3" * 70, *(p[: 40 + k] for k, p in enumerate(packets[:150])), *(p[:k] + bytes([p[k] ^ 4]) + p[k + 1 :] for k, p in enumerate(packets[:200]))]
    packets += [quic.sealed_initial(b"12345678", [(0, bytes(n))], number=n, least=n) for n in (0, 15, 1162, 60_000)]
    alone = [quic.quic_initial(p) if p is not None else None for p in packets]
    assert [a["sni"] for a in alone[:300]] == [f"name-{k}" for k in range(300)] and alone[300:303] == [None] * 3
    runs, plain = [], quic.aes128
    monkeypatch.setattr(quic, "aes128", lambda *a: runs.append(1) or plain(*a))
    assert quic.quic_initials(packets) == alone and len(runs) <= 10


def test_quic_query_uses_all_cores(spark, tmp_path):
    spark.range(100).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = catalogue.queries()["p12_quic_initial"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.filter("sni = concat('customer-', k)").count() == 100


def test_logins():
    assert auth.attempt(b"USER x\r\n", 21) == "FTP" and auth.attempt(messages.rdp("bob", 1), 3389) == "RDP" and auth.attempt(messages.kerberos("x", 1), 99) is None and auth.attempt(b"junk", 21) is None
    assert auth.refusals(b"530 a\r\n530 b\r\n", 21) == ["FTP", "FTP"] and auth.refusals(b"530 a\r\n", 22) == [] and auth.refusals(messages.ldap("x", 3), 389) == ["LDAP"]


def test_xbits_of_mixed_kinds(spark):
    rules, _ = parse_rules('rule sid:1; content:"a"; xbits:set,x,track ip_src,expire 10; noalert;\nrule sid:2; content:"b"; xbits:isset,x,track ip_src; xbits:isnotset,y,track ip_dst;\nrule sid:3; content:"c"; xbits:set,y,track ip_dst; noalert;')
    rows = [(1, 1, "s", "d", "a"), (2, 2, "s", "d", "b"), (3, 3, "t", "d", "b"), (4, 4, "q", "d", "c"), (5, 5, "s", "d", "b"), (6, 6, "s", "e", "b"), (7, 20, "s", "e", "b")]
    df = spark.createDataFrame(rows, "seq bigint, ts_sec bigint, src string, dst string, data string").withColumn("flow", F.col("seq")).withColumn("buffer", F.lit("payload")).withColumn("direction", F.lit("to_server"))
    assert sorted(r["seq"] for r in alerts(df, rules, ["flow"]).collect()) == [2, 6]


def test_rules_read_only_their_buffers(spark):
    rules, _ = parse_rules('rule sid:1; buffer:http.uri; content:"a";')
    df = spark.createDataFrame([(1, "http.uri", None, "a"), (2, "dns.query", None, "a")], "k int, buffer string, direction string, data string")
    assert [r["k"] for r in match(df, rules, ["k"]).collect()] == [1]


def test_total_order_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("w")).repartition(9)
    got = {r["v"]: r["place"] for r in observe.placed(df, ["v"], "place").collect()}
    assert got == {v: v + 1 for v in range(1000)}


def test_rotation_keeps_generations(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for k in range(4):
        render.write_rotated(spark.createDataFrame([(f"line {k} {n}",) for n in range(10)], "value string").coalesce(1), path, records=4, generations=2)
    kept = sorted(p.name for p in (tmp_path / "log").iterdir())
    assert kept == ["generation=000000000002", "generation=000000000003"] and len(list((tmp_path / "log" / kept[1]).glob("*.txt"))) == 3
    assert {r["value"].split()[1] for r in spark.read.text(f"{path}/{kept[1]}").collect()} == {"3"}


def test_console(spark, capsys):
    render.console(spark.createDataFrame([("a",), ("b",)], "value string").coalesce(1))
    assert capsys.readouterr().out == "a\nb\n"


def test_syslog_opens_a_broken_connection_again():
    server = socket.create_server(("127.0.0.1", 0))
    got, served = [], threading.Event()

    def run():
        first, _ = server.accept()
        got.append(first.recv(100))
        first.setsockopt(socket.SOL_SOCKET, socket.SO_LINGER, struct.pack("ii", 1, 0))
        first.close()  # a reset
        second, _ = server.accept()
        got.append(second.recv(100))
        served.set()

    threading.Thread(target=run, daemon=True).start()
    sender = syslog.Sender("127.0.0.1", server.getsockname()[1], True)
    sender.send(b"one")
    while not got:
        time.sleep(0.01)
    time.sleep(0.1)
    for _ in range(3):
        sender.send(b"two")
    assert served.wait(5) and got[0] == b"one" and got[1].startswith(b"two")
    sender.close()
    server.close()
    with pytest.raises(OSError):
        syslog.Sender("127.0.0.1", 1, True, tries=2, wait=0.01).send(b"x")


def test_metrics(spark):
    m = metrics.Metrics()
    frames = spark.createDataFrame([(1, bytearray(messages.frame("x", k)[1]), messages.frame("x", k)[0], 60) for k in range(12)], "n int, raw binary, link_type int, frame_len int")
    m.frames(capture.decode_counts(frames), frames)
    m.alerts(5, spark.createDataFrame([(1, 2)], "sid int, suppressed int"), 4)
    server = metrics.serve(m)
    body = urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/metrics").read().decode()
    assert urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health").read() == b"ok\n"
    server.shutdown()
    assert body.count("# TYPE ") == 29 and "netlume_frames_read_total 12\n" in body and "netlume_packets_decoded_total 10\n" in body and "netlume_alerts_suppressed_total 2\n" in body and "netlume_alerts_allowlisted_total 1\n" in body


def test_captures_that_are_dropped_into_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.pcap").write_bytes(capture.write_pcap_bytes([(k, b"frame")] * (k + 1)))
    stream = capture.follow_pcap(spark, f"file://{tmp_path}/in", files=1)
    q = stream.select("frame_no").writeStream.format("memory").queryName("followed").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("followed").count() == 6


def test_fnv_and_file_names(spark):
    df = spark.createDataFrame([(bytearray(b""), "a b/../c"), (bytearray(b"a"), "..x"), (None, None)], "b binary, n string")
    assert [tuple(r) for r in df.select(scalars.fnv1a_64(F.col("b")), scalars.file_name(F.col("n"))).collect()] == [("cbf29ce484222325", "a_b_.._c"), ("af63dc4c8601ec8c", "_x"), (None, None)]
