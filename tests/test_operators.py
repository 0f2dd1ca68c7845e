"""Windows, rate control, joins and flows against row-at-a-time models, over rows with many ties."""

import random

import pytest
from pyspark.sql import functions as F

from netlume.operators import control, detectors, enrich, flows, windows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(rng.randrange(3), rng.randrange(60), n, rng.randrange(6), rng.randrange(50)) for n in range(400)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "key bigint, ts_sec bigint, seq bigint, value bigint, amount bigint")


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1], r[2]))


def test_sliding_values(df, rows):
    width = 7
    got = {r["seq"]: (r["total"], r["n"]) for r in df.select("seq", windows.rate(["key"], F.col("amount"), width).alias("total"), windows.distinct(["key"], F.col("value"), width).alias("n")).collect()}
    by_intervals = {r["seq"]: r["n_distinct"] for r in windows.distinct_by_intervals(df, ["key"], "value", width).collect()}
    seen = []
    for r in in_order(rows):
        seen.append(r)
        live = [x for x in seen if x[0] == r[0] and x[1] > r[1] - width]
        want = sum(x[4] for x in live), len({x[3] for x in live})
        assert got[r[2]] == want and by_intervals[r[2]] == want[1]


def test_anchors_and_gate(df, rows):
    got = {r["seq"]: (r["anchor_sec"], r["is_anchor"]) for r in windows.greedy_anchors(df, ["key"], 9).collect()}
    last = {}
    for k, sec, seq, *_ in in_order(rows):
        fresh = k not in last or sec - last[k] >= 9
        if fresh:
            last[k] = sec
        assert got[seq] == (last[k], fresh)
    assert {r["seq"] for r in windows.gate(df, ["key"], 9).collect()} == {s for s, (_, a) in got.items() if a}


def test_periodicity_ignores_equal_seconds(spark):
    beats = [(1, 10 * n, n) for n in range(9)] + [(1, 10 * n, 100 + n) for n in range(9)] + [(2, n * n * 7, n) for n in range(9)]
    got = windows.periodicity(spark.createDataFrame(beats, "key bigint, ts_sec bigint, seq bigint"), ["key"]).collect()
    assert {(r["key"], r["ts_sec"]) for r in got if r["gap_cv"] < 0.01} == {(1, 60), (1, 70), (1, 80)}
    assert all(r["gap_mean"] == 10 for r in got if r["key"] == 1)


@pytest.mark.parametrize("kind", ["limit", "threshold", "both", "detection_filter"])
def test_rate_control(spark, kind):
    rng = random.Random(2)
    alerts = [(1, rng.choice("ab"), "d", rng.randrange(100), n) for n in range(200)]
    df = spark.createDataFrame(alerts, "sid bigint, src string, dst string, ts_sec bigint, seq bigint")
    got = {r["seq"] for r in control.threshold(df, kind, "by_src", 3, 10).collect()}
    state, want = {}, set()
    for _, src, _, sec, seq in sorted(alerts, key=lambda a: (a[3], a[4])):
        anchor, n = state.get(src, (None, 0))
        anchor, n = (sec, 0) if anchor is None or sec - anchor >= 10 else (anchor, n)
        n += 1
        state[src] = anchor, n
        if {"limit": n <= 3, "threshold": n % 3 == 0, "both": n == 3, "detection_filter": n > 3}[kind]:
            want.add(seq)
    assert got == want


def test_suppression_and_bits(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 3, 1), ("a", 14, 2), ("a", 15, 3), ("a", 40, 4)], "k string, ts_sec bigint, seq bigint")
    assert sorted((r["seq"], r["suppressed"]) for r in control.suppress(df, ["k"], 15).collect()) == [(0, 0), (3, 2), (4, 0)]
    ops = [("x", 0, 0, "isset"), ("x", 1, 1, "set"), ("x", 1, 2, "isset"), ("x", 40, 3, "isset"), ("x", 41, 4, "toggle"), ("x", 42, 5, "isset"), ("x", 43, 6, "unset"), ("x", 44, 7, "isnotset"), ("x", 45, 8, None), ("y", 2, 9, "isset")]
    bits = control.cross_bits(spark.createDataFrame(ops, "k string, ts_sec bigint, seq bigint, xbit_op string"), ["k"], 30)
    assert sorted(r["seq"] for r in bits.collect()) == [1, 2, 4, 5, 6, 7, 8]


def test_ranges_and_domains(spark):
    ranges = spark.createDataFrame([(10, 20, "a"), (15, 30, "a"), (18, 19, "b"), (1 << 20, (1 << 20) + 200_000, "wide"), (25, 26, "a")], "lo bigint, hi bigint, tag string")
    merged = enrich.merge_ranges(ranges)
    assert sorted((r["tag"], r["lo"], r["hi"]) for r in merged.collect()) == [("a", 10, 30), ("b", 18, 19), ("wide", 1 << 20, (1 << 20) + 200_000)]
    rows = spark.createDataFrame([(1, 9), (2, 10), (3, 18), (4, 30), (5, (1 << 20) + 150_000), (6, None)], "n bigint, address bigint")
    assert sorted((r["n"], r["tag"]) for r in enrich.in_ranges(rows, "address", merged, "tag").collect()) == [(1, None), (2, "a"), (3, "b"), (4, "a"), (5, "wide"), (6, None)]
    feed = spark.createDataFrame([("evil.org", "e"), ("a.evil.org", "ae"), ("org", "top")], "domain string, tag string")
    hosts = spark.createDataFrame([(1, "x.a.EVIL.org"), (2, "evil.org"), (3, "notevil.org"), (4, "org"), (5, None)], "n bigint, host string")
    assert sorted((r["n"], r["tag"]) for r in enrich.domain_tags(hosts, "host", feed, "tag").collect()) == [(1, "ae"), (2, "e"), (3, None), (4, "top"), (5, None)]


def test_as_of_and_allowlist(spark):
    rows = spark.createDataFrame([("k", 5, 0), ("k", 20, 1), ("z", 9, 2)], "key string, ts_sec bigint, seq bigint")
    past = spark.createDataFrame([("k", 1, 0, "old"), ("k", 4, 9, "new"), ("k", 30, 0, "later")], "key string, ts_sec bigint, seq bigint, v string")
    got = {r["seq"]: r["v"] for r in enrich.as_of(rows, past, ["key"], ["v"], ttl=10).collect()}
    assert got == {0: "new", 1: None, 2: None}
    alerts = spark.createDataFrame([(0, "Scan", "a", "b", 1), (1, "scan", "a", "c", 2), (2, "other", "a", "b", 3)], "seq bigint, category string, src string, dst string, port int")
    allowed = spark.createDataFrame([("SCAN", "a", "b", None), (None, None, None, 3)], "category string, src string, dst string, port int")
    assert [r["seq"] for r in enrich.allow(alerts, allowed).collect()] == [1]


def test_reassembly():
    assert flows.assemble([(0, b"abc"), (3, b"def")]) == b"abcdef"
    assert flows.assemble([(3, b"def"), (0, b"abc"), (3, b"XXX")]) == b"abcdef"
    assert flows.assemble([(0, b"ab"), (0, b"XXcd"), (3, b"dE")]) == b"abcdE"
    assert flows.assemble([(0, b"ab"), (5, b"z")]) == b"ab" and flows.assemble([]) == b""


def test_flow_records(spark):
    packets = [(1, 0, 0, "c", 60, 2), (1, 1, 1, "s", 70, 18), (1, 2, 2, "c", 80, 17), (1, 3, 3, "s", 90, 17), (1, 900, 4, "s", 10, 4)]
    df = spark.createDataFrame(packets, "flow bigint, ts_sec bigint, seq bigint, src string, frame_len bigint, tcp_flags bigint")
    got = sorted(flows.flow_records(flows.sessions(df, ["flow"]), ["flow"]).collect(), key=lambda r: r["session"])
    assert [(r["client"], r["pkts_to_server"], r["bytes_to_client"], r["state"]) for r in got] == [("c", 2, 160, "closed"), ("s", 1, 0, "reset")]


def test_detectors_on_graded_cases(spark):
    scan = [("66", "10", 0, p, p, True) for p in range(25)]
    sweep = [("7", str(h), 5, 445, 1000 + h, False) for h in range(30)]
    calm = [("8", "10", s, 443, 2000 + s, True) for s in range(0, 200, 7)]
    obs = spark.createDataFrame([*scan, *sweep, *calm], "src string, dst string, ts_sec bigint, dst_port bigint, seq bigint, answered boolean")
    assert [(r["src"], r["category"], r["measure"]) for r in detectors.port_scan(obs).collect()] == [("66", "PORT_SCAN", 21)]
    assert [(r["src"], r["measure"]) for r in detectors.horizontal_scan(obs).collect()] == [("7", 26)]
    beat = spark.createDataFrame([("9", "1", 60 * n, n) for n in range(12)], "src string, dst string, ts_sec bigint, seq bigint")
    assert [r["ts_sec"] for r in detectors.beaconing(beat, ["src", "dst"]).collect()] == [360]
    names = spark.createDataFrame([(n, n, "5", f"{n:02d}q7zk3x9w{n * 7919 % 9973:x}.t.evil.org") for n in range(60)], "ts_sec bigint, seq bigint, src string, name string")
    assert [(r["parent"], r["measure"]) for r in detectors.dns_tunnel(names, entropy=2.5).collect()] == [("evil.org", 41)]
    packets = spark.createDataFrame([("1.2.3.4", "5.6.7.8"), ("5.6.7.8", "1.2.3.4"), ("9.9.9.9", "8.8.8.8")], "src string, dst string")
    denied = spark.createDataFrame([("1.2.3.4",)], "address string")
    assert sorted(r["severity"] for r in detectors.deny_list(packets, denied).collect()) == ["high", "medium"]


def test_folds_pass_values_as_they_are(spark):
    rows = [(1, 1, "a", 9007199254740993, "x"), (2, 2, "a", None, None), (3, 9, "a", 9007199254740995, "y"), (4, None, "a", 5, "z"), (5, 3, None, 1, "n"), (6, 3, None, 2, "m")]
    df = spark.createDataFrame(rows, "seq bigint, ts_sec bigint, src string, dst bigint, anchor_sec string")
    got = {r["seq"]: r["dst"] for r in windows.gate(df, ["src"], 5).collect()}
    assert got == {1: 9007199254740993, 3: 9007199254740995, 5: 1}
    assert windows.gate(df, ["src"], 5).columns == df.columns
    with pytest.raises(ValueError, match="anchor_sec"):
        windows.greedy_anchors(df, ["src"], 5)
    assert windows.gate(df.limit(0), ["src"], 5).count() == 0 and windows.gate(df, [], 5).count() == 2


def test_anchor_windows_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rng = random.Random(4)
        rows = [(k, rng.randrange(120), rng.choice("abc")) for k in range(200)]
        df = spark.createDataFrame(rows, "seq bigint, ts_sec bigint, key string")
        got = {r["seq"]: tuple(r[2:]) for r in windows.anchor_windows(df, ["key"], 10).select("seq", "key", "anchor_sec", "is_anchor", "anchor_place", "anchor_held").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in "abc":
        anchor, place, held = None, 0, 0
        for seq, sec, _ in sorted((r for r in rows if r[2] == key), key=lambda r: (r[1], r[0])):
            first = anchor is None or sec - anchor >= 10
            if first:
                anchor, place, held = sec, 0, max(place - 1, 0)
            place += 1
            assert got[seq] == (anchor, first, place, held)


def test_running_sums_against_sliding_ones(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(60), rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3, 4]), rng.randrange(100)) for k in range(400)]
    df = spark.createDataFrame(rows, "seq bigint, ts_sec bigint, key string, value bigint, amount bigint")
    both = windows.with_rates(windows.distinct_by_intervals(df, ["key"], "value", 7), ["key"], {"total": F.col("amount"), "often": F.lit(1)}, 7)
    got = {r["seq"]: (r["n_distinct"], r["total"], r["often"]) for r in both.collect()}
    for seq, sec, key, _, _ in rows:
        seen = [r for r in rows if r[2] == key and sec - 7 < r[1] and (r[1], r[0]) <= (sec, seq)]
        assert got[seq] == (len({r[3] for r in seen} - {None}), sum(r[4] for r in seen), len(seen))
    assert windows.with_rates(df.limit(0), ["key"], {"total": F.col("amount")}, 7).count() == 0


def test_bits_of_rows_with_several_operations(spark):
    op = lambda o, b, t=None: {"op": o, "bit": b, "ttl": t}
    rows = [(1, 1, "k", [op("isset", "x"), op("set", "y")]), (2, 2, "k", [op("set", "x", 5), op("set", "y")]), (3, 3, "k", [op("isset", "x"), op("toggle", "x")]), (4, 4, "k", [op("isset", "x")]), (5, 90, "k", [op("isset", "y"), op("isnotset", "x")]), (6, 91, "j", [op("isset", "y")]), (7, 92, "j", None)]
    df = spark.createDataFrame(rows, "seq bigint, ts_sec bigint, key string, ops array<struct<op:string,bit:string,ttl:int>>")
    assert sorted(r["seq"] for r in control.bits_fold(df, ["key"], "ops").collect()) == [2, 3, 5, 7]
