"""Rules with all that they say: bits of a flow, composites, bits across flows, rate control, silence.

One fold over each flow's hits applies flow bits and completes composites; alerts then pass the bits that rules share
across flows, lose those that only set state, and pass each rule's own rate control.  Everything comes from the rule text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netlume.operators import control, windows

from .matcher import HEADER, match
from .parser import Rule

CONDITIONS = ("isset", "isnotset")
_TRACK_KEYS = {"ip_src": ["src"], "ip_dst": ["dst"], "ip_pair": ["src", "dst"]}


def rule_hits(buffers: DataFrame, rules: list[Rule], flow: list[str], sec: str = "ts_sec", seq: str = "seq", once: bool = False, packets: bool = False) -> DataFrame:
    """flow, sec, seq, src, dst, direction, sid, name, severity of rules that hold on their flow, composites where their last part does.

    Each buffer row is one pass: all its rules read the flow's bits as they were before it, then change them.  Conditions
    gate every part of a composite, its changes wait until it is complete, and it is complete once.  Rows whose column
    `stateful` is false (datagrams) have no bits: nothing is set there, and composites never complete.  With `once` a
    rule fires once for a flow and direction.  Where buffers have `marks` (names of protocols, as parse.auth.marks gives
    them), those bits are set before their pass.
    """
    told = [c for c in ("src", "dst") if c in buffers.columns]
    rows = buffers if "stateful" in buffers.columns else buffers.withColumn("stateful", F.lit(True))
    rows = rows.withColumn("side", F.col("direction")).withColumn("read", F.col("buffer"))
    hits = match(rows.select(*flow, sec, seq, "buffer", "direction", "data", "side", "read", "stateful", *[c for c in HEADER if c in rows.columns]), rules, [*flow, sec, seq, *told, "side", "read", "stateful"], packets)
    if "marks" in buffers.columns:
        marked = rows.filter(F.size("marks") > 0).select(*flow, sec, seq, *told, "side", "read", "stateful", *[F.lit(None).cast(k).alias(c) for c, k in (("sid", "bigint"), ("name", "string"), ("severity", "string"), ("part", "int"), ("parts", "int"))], "marks")
        hits = hits.withColumn("marks", F.lit(None).cast("array<string>")).unionByName(marked)
    else:
        hits = hits.withColumn("marks", F.lit(None).cast("array<string>"))
    shared = buffers.sparkSession.sparkContext.broadcast({(r.sid, r.name): r for r in rules})

    def fold():
        held = shared.value
        bits: set[str] = set()
        entry: frozenset[str] = frozenset()
        parts: dict[tuple, set[int]] = {}
        fired: set[tuple] = set()
        at = None

        def step(order: list[pa.Array], fresh: np.ndarray):
            nonlocal entry, at
            fires = np.zeros(len(fresh), bool)
            new = fresh.tolist()
            for k, (*row, sid, name, part, side, stateful, marks) in enumerate(zip(*(c.to_pylist() for c in order), strict=True)):
                if new[k]:
                    bits.clear()
                    parts.clear()
                    fired.clear()
                    at = None
                if row != at:
                    at, entry = row, frozenset(bits)
                if sid is None:  # comes first in its pass
                    bits.update(marks)
                    entry = frozenset(bits)
                    continue
                rule = held[sid, name]
                seen = entry if stateful else frozenset()
                if not all((bit in seen) == (verb == "isset") for verb, bit in rule.flowbits if verb in CONDITIONS):
                    continue
                if len(rule.parts) > 1:
                    if not stateful:
                        continue
                    done = parts.setdefault((sid, name), set())
                    if part in done or len(done) == len(rule.parts):
                        continue
                    done.add(part)
                    if len(done) < len(rule.parts):
                        continue
                if stateful:
                    for verb, bit in rule.flowbits:
                        if verb == "set" or (verb == "toggle" and bit not in bits):
                            bits.add(bit)
                        elif verb in ("unset", "toggle"):
                            bits.discard(bit)
                if once and (side, sid, name) in fired:
                    continue
                fired.add((side, sid, name))
                fires[k] = True
            return [pa.array(fires)]

        return step

    folded = windows.fold_in_order(hits, flow, [sec, seq, "read", "sid", "name", "part", "side", "stateful", "marks"], "_fires boolean", fold)
    return folded.filter("_fires").select(*flow, sec, seq, *told, F.col("side").alias("direction"), "sid", "name", "severity")


def _settings(spark, rules: list[Rule]) -> DataFrame:
    """One row a rule; the table has the size of the rule file."""
    rows = []
    for r in rules:
        ops = [{"op": verb, "bit": bit, "track": track, "ttl": ttl} for verb, bit, track, ttl in r.xbits]
        t = r.threshold or {}
        rows.append((r.sid, r.name, r.noalert, ops, t.get("kind"), t.get("track"), t.get("count"), t.get("seconds")))
    return spark.createDataFrame(rows, "sid bigint, name string, noalert boolean, ops array<struct<op:string,bit:string,track:string,ttl:int>>, kind string, track string, count int, seconds int").dropDuplicates(["sid", "name"])


def shared_bits(alerts: DataFrame, rules: list[Rule], sec: str = "ts_sec", seq: str = "seq") -> DataFrame:
    """Alerts (with `ops`) whose conditions on bits across flows hold, in order; bits belong to a source, a destination or a pair.

    Rules that keep to one kind of bit are folded by its addresses.  If a rule mixes kinds, the order of all matters and
    the alerts of rules with bits are one sequence; only those are.
    """
    tracks = [{x[2] for x in r.xbits} for r in rules if r.xbits]
    if not tracks:
        return alerts
    has = F.size("ops") > 0
    out = [alerts.filter(~has)]
    address = F.transform("ops", lambda x: F.struct(x["op"].alias("op"), F.concat_ws("\t", x["bit"], x["track"], *[F.when(x["track"].isin(*names), F.col(c).cast("string")) for c, names in (("src", ("ip_src", "ip_pair")), ("dst", ("ip_dst", "ip_pair")))]).alias("bit"), x["ttl"].alias("ttl")))
    marked = alerts.filter(has).withColumn("_ops", address)
    if any(len(t) > 1 for t in tracks):
        out.append(control.bits_fold(marked, [], "_ops", sec, seq).drop("_ops"))
    else:
        for track in sorted(set().union(*tracks)):
            out.append(control.bits_fold(marked.filter(F.col("ops")[0]["track"] == track), _TRACK_KEYS[track], "_ops", sec, seq).drop("_ops"))
    return reduce(DataFrame.unionByName, out)


def rate_controlled(alerts: DataFrame, rules: list[Rule], sec: str = "ts_sec", seq: str = "seq") -> DataFrame:
    """Alerts (with `kind`, `track`, `count`, `seconds` of their rules) that pass the rate control of their own rule."""
    out = [alerts.filter("kind IS NULL")]
    n = F.col("anchor_place")
    keep = F.when(F.col("kind") == "limit", n <= F.col("count")).when(F.col("kind") == "threshold", n % F.greatest("count", F.lit(1)) == 0).when(F.col("kind") == "both", n == F.col("count")).otherwise(n > F.col("count"))
    for track in sorted({str(r.threshold["track"]) for r in rules if r.threshold}):
        placed = windows.anchor_windows(alerts.filter(F.col("kind").isNotNull() & (F.col("track") == track)), [*control.TRACK[track], "name"], "seconds", sec, seq)
        out.append(placed.filter(keep).drop("anchor_sec", "is_anchor", "anchor_place", "anchor_held"))
    return reduce(DataFrame.unionByName, out)


def alerts(buffers: DataFrame, rules: list[Rule], flow: list[str], sec: str = "ts_sec", seq: str = "seq", once: bool = False, packets: bool = False) -> DataFrame:
    """What the rules report over buffers (flow, sec, seq, src, dst, buffer, direction, data): all stages in order."""
    found = rule_hits(buffers, rules, flow, sec, seq, once, packets).join(_settings(buffers.sparkSession, rules), ["sid", "name"])
    passed = shared_bits(found, rules, sec, seq).filter("NOT noalert")
    return rate_controlled(passed, rules, sec, seq).drop("noalert", "ops", "kind", "track", "count", "seconds")
