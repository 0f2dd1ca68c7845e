"""What happens to alerts after they are raised: rate control, bits across connections, suppression."""

from __future__ import annotations

from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import windows

#: Columns that tell a rule's alerts apart for each way of tracking.
TRACK = {"by_src": ["sid", "src"], "by_dst": ["sid", "dst"], "by_both": ["sid", "src", "dst"], "by_rule": ["sid"]}


def threshold(alerts: DataFrame, kind: str, track: str, count: int, seconds: int) -> DataFrame:
    """limit: the first `count` of a window; threshold: every `count`-th; both: the `count`-th; detection_filter: those after it.

    A window begins with the first alert of its key, and again with the first one `seconds` or more after that.
    """
    placed, n = windows.anchor_windows(alerts, TRACK[track], seconds), F.col("anchor_place")
    keep: dict[str, Column] = {"limit": n <= count, "threshold": n % count == 0, "both": n == count, "detection_filter": n > count}
    return placed.filter(keep[kind]).drop("anchor_sec", "is_anchor", "anchor_place", "anchor_held")


def suppress(alerts: DataFrame, keys: list[str], seconds: int = 15) -> DataFrame:
    """Repeated alerts within `seconds` of the last one let through are dropped; `suppressed` counts those before the next."""
    placed = windows.anchor_windows(alerts, keys, seconds).filter("is_anchor")
    return placed.withColumn("suppressed", F.col("anchor_held")).drop("anchor_sec", "is_anchor", "anchor_place", "anchor_held")


def bit_is_set(events: DataFrame, keys: list[str], sets: Column, unsets: Column, ttl: int) -> Column:
    """Whether the bit of a row's key is set by an earlier row, not unset since, and not older than `ttl` seconds."""
    before = Window.partitionBy(*keys).orderBy("ts_sec", "seq").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(sets, F.col("ts_sec") + ttl).when(unsets, F.lit(-1).cast("bigint"))
    return F.coalesce(F.last(change, ignorenulls=True).over(before) > F.col("ts_sec"), F.lit(False))


def cross_bits(alerts: DataFrame, keys: list[str], ttl: int = 30) -> DataFrame:
    """Alerts with xbit_op (set, unset, toggle, isset, isnotset or null), in order; those whose condition fails go.

    A toggle depends on what the bit was, so this is a fold; rules without toggles can use bit_is_set().
    """

    return bits_fold(alerts.withColumn("_ops", F.when(F.col("xbit_op").isNotNull(), F.array(F.struct(F.col("xbit_op").alias("op"), F.lit("").alias("bit"), F.lit(ttl).alias("ttl"))))), keys, "_ops").drop("_ops")


def bits_fold(rows: DataFrame, keys: list[str], ops: str, sec: str = "ts_sec", seq: str = "seq") -> DataFrame:
    """The rows whose conditions hold, of rows with operations (op, bit, ttl) on the bits of their key, in order.

    All conditions of a row are read before any of its changes is made, and a row that fails one changes nothing.  A ttl
    of null means for ever; state is a key's live bits.
    """

    def fold():
        bits: dict[str, float] = {}

        def step(order: list[pa.Array], fresh: np.ndarray):
            kept = np.ones(len(fresh), bool)
            new = fresh.tolist()
            for k, (now, todo) in enumerate(zip(order[0].to_pylist(), order[2].to_pylist(), strict=True)):
                if new[k]:
                    bits.clear()
                if not todo:
                    continue
                live = {x["bit"]: bits.get(x["bit"], -inf) > now for x in todo}
                if any((x["op"] == "isset" and not live[x["bit"]]) or (x["op"] == "isnotset" and live[x["bit"]]) for x in todo):
                    kept[k] = False
                    continue
                for x in todo:
                    if x["op"] == "set" or (x["op"] == "toggle" and not bits.get(x["bit"], -inf) > now):
                        bits[x["bit"]] = inf if x["ttl"] is None else now + x["ttl"]
                    elif x["op"] in ("unset", "toggle"):
                        bits.pop(x["bit"], None)
            return [pa.array(kept)]

        return step

    return windows.fold_in_order(rows, keys, [sec, seq, ops], "_kept boolean", fold).filter("_kept").drop("_kept")


def total_order(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy("ts_sec", "sid", "src", "dst", "message")
