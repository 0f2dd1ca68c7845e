"""Streams give what the batch forms give."""

import random

import pytest
from pyspark.sql import Window, functions as F

from netlume.operators import control, windows
from netlume.streaming import stateful

SCHEMA = "sid bigint, src string, dst string, ts_sec bigint, seq bigint, xbit_op string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    path = tmp_path_factory.mktemp("stream")
    sec = 0
    for part in range(3):
        rows = []
        for n in range(60):
            sec += rng.choice([0, 0, 1, 3, 8])
            rows.append((1, rng.choice("abc"), "d", sec, part * 100 + n, rng.choice(["set", "unset", "isset", "isnotset", "toggle", None])))
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{path}/in")
    return path


@pytest.mark.parametrize(
    ("name", "stream", "batch"),
    [
        ("gate", lambda df: stateful.gate_stream(df, ["src"], 9), lambda df: windows.gate(df, ["src"], 9)),
        ("rate", lambda df: stateful.threshold_stream(df, ["sid", "src"], "threshold", 3, 20), lambda df: control.threshold(df, "threshold", "by_src", 3, 20)),
        ("bits", lambda df: stateful.bits_stream(df, ["src"], 30), lambda df: control.cross_bits(df, ["src"], 30)),
    ],
)
def test_stream_equals_batch(spark, folder, name, stream, batch):
    live = spark.readStream.schema(SCHEMA).parquet(f"file://{folder}/in")
    got = stateful.run_once(stream(live), f"out_{name}", f"file://{folder}/checkpoint-{name}")
    assert {r["seq"] for r in got.collect()} == {r["seq"] for r in batch(spark.read.schema(SCHEMA).parquet(f"file://{folder}/in")).collect()}


def test_rules_reload_between_batches(spark, tmp_path):
    from netlume.streaming.live import Counters, ReloadingRules, matching

    path = tmp_path / "rules.txt"
    path.write_text("one|payload|any|literal|alpha")
    rules = ReloadingRules(spark, f"file://{path}")
    counters, found = Counters(), []
    spark.streams.addListener(counters)
    schema = "flow bigint, buffer string, direction string, data string"
    writer = lambda: matching(spark.readStream.schema(schema).json(f"file://{tmp_path}/in"), rules, ["flow"], lambda hits, n: found.extend((r["flow"], r["name"]) for r in hits.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True)
    feed = lambda k: spark.createDataFrame([(k, "payload", "any", "alpha beta")], schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    feed(1)
    writer().start().awaitTermination()
    path.write_text("two|payload|any|literal|beta\n")
    feed(2)
    writer().start().awaitTermination()
    path.write_text("broken|payload")
    feed(3)
    writer().start().awaitTermination()
    spark.streams.removeListener(counters)
    assert found == [(1, "one"), (2, "two"), (3, "two")] and rules.generation == 2 and rules.error
    assert counters.counts().get("batches", 0) >= 1


def _files(spark, tmp_path, batches):
    """A stream of one micro-batch for each list of rows."""
    import time

    schema = "ts_sec bigint, seq bigint, src string, amount bigint, big bigint"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"file://{tmp_path}/part{k}")
        time.sleep(0.05)
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(f"file://{tmp_path}")
    return read.withColumn("ts", F.timestamp_seconds("ts_sec"))


def test_sliding_streams_equal_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted((rng.randrange(200), k, rng.choice("ab"), rng.randrange(5), rng.choice([None, 9007199254740993])) for k in range(90))
    rows = [(s, k, a, b, c) for k, (s, _, a, b, c) in enumerate(rows)]
    batches = [rows[:30], rows[30:60], rows[60:]]
    plain = spark.createDataFrame(rows, "ts_sec bigint, seq bigint, src string, amount bigint, big bigint")
    for n, (made, want, columns) in enumerate((
        (stateful.rate_stream(_files(spark, tmp_path / "s0", batches), ["src"], "amount", 20), windows.with_rates(plain, ["src"], {"total": F.col("amount")}, 20), ["seq", "total", "big"]),
        (stateful.distinct_stream(_files(spark, tmp_path / "s1", batches), ["src"], "amount", 20), windows.distinct_by_intervals(plain, ["src"], "amount", 20), ["seq", "n_distinct", "big"]),
        (stateful.sessions_stream(_files(spark, tmp_path / "s2", batches), ["src"], 9), windows.idle_sessions(plain, ["src"], 9).withColumn("session_start", F.min("ts_sec").over(Window.partitionBy("src", "session"))), ["seq", "session_start", "big"]),
    )):
        got = stateful.run_once(made, f"sliding{n}", f"file://{tmp_path}/check{n}").select(*columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_held_rows_are_taken_in_order_and_state_goes(spark, tmp_path):
    batches = [[(10, 1, "a", 1, None), (30, 2, "a", 1, None)], [(25, 3, "a", 1, None), (29, 4, "b", 1, None)], [(100, 5, "a", 1, None)], [(200, 6, "z", 1, None)], [(400, 7, "z", 1, None)]]
    stream = _files(spark, tmp_path / "rows", batches).withWatermark("ts", "20 seconds")
    got = stateful.run_once(stateful.gate_stream(stream, ["src"], 10, event="ts", hold=True), "held", f"file://{tmp_path}/check")
    # row 3 comes after row 2 and is still taken before it, so row 2 does not pass; the last row is still waiting
    assert sorted(r["seq"] for r in got.collect()) == [1, 3, 4, 5, 6]
    state = spark.read.format("statestore").load(f"file://{tmp_path}/check")
    assert state.count() <= 1
    with pytest.raises(ValueError, match="watermark"):
        stateful.gate_stream(stream, ["src"], 10, hold=True)


def test_scan_of_growing_streams(spark, tmp_path):
    from netlume.rules.matcher import scan_streams

    literals = [b"needle", b"ab", b"x"]
    rows = [(k, k, "s" if k % 3 else "t", part) for k, part in enumerate(["nee", "a", "dle", "b n", "", "eedle", "x", "needle", None, "abx"])]
    schema = "ts_sec bigint, seq bigint, src string, text string"
    plain = spark.createDataFrame(rows, schema).select("seq", "ts_sec", "src", F.col("text").cast("binary").alias("payload"))
    for k in range(0, 10, 4):
        spark.createDataFrame(rows[k : k + 4], schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).json(f"file://{tmp_path}/in").withColumn("payload", F.col("text").cast("binary")).drop("text")
    got = stateful.run_once(stateful.scan_stream(stream, ["src"], literals, 100), "scanned", f"file://{tmp_path}/c")
    found = {(r["src"], x, r["seq"]) for r in got.collect() for x in r["found"]}
    assert found == {(r["src"], bytes(r["literal"]).decode(), r["seq"]) for r in scan_streams(plain, ["src"], literals).collect()} and len(found) == 3
