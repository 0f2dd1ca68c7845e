"""Joins of alerts and addresses with feeds: ranges, domain suffixes, allowlists, home networks.

Ranges are joined by blocks: a range is listed under every block of 2^16 addresses that it touches, so that the join is
an equi-join, never a nested loop; a feed of any size works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from netlume.functions import scalars

BLOCK_BITS = 16


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """(tag, lo, hi): overlapping ranges of a tag become one."""
    w = Window.partitionBy("tag").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.select("tag", "lo", "hi", reach.alias("_reach"))
    marked = marked.withColumn("_new", F.when(F.col("lo") <= F.col("_reach"), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("tag", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def in_ranges(rows: DataFrame, address: str, ranges: DataFrame, name: str) -> DataFrame:
    """Adds the tag of the range with the greatest start that holds the address, or null."""
    blocks = F.explode(F.sequence(F.shiftright("lo", BLOCK_BITS), F.shiftright("hi", BLOCK_BITS)))
    listed = ranges.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("tag").alias("_tag"), blocks.alias("_block"))
    wanted = rows.select(F.col(address).alias("_a")).distinct()
    found = wanted.join(listed, (F.shiftright("_a", BLOCK_BITS) == F.col("_block")) & F.col("_a").between(F.col("_lo"), F.col("_hi")))
    best = found.groupBy("_a").agg(F.max_by("_tag", F.struct("_lo", "_tag")).alias(name))
    return rows.join(best, F.col(address) == F.col("_a"), "left").drop("_a")


#: Leading bytes by which networks and addresses meet; a network is listed under the longest prefixes that it takes at most 256 of.
LEVELS = (4, 3, 2, 1, 0)


def _prefixes(first: bytes, last: bytes) -> list[bytes]:
    """Blocks of a range: the family and leading bytes, all of one length."""
    family = bytes([len(first)])
    for n in LEVELS[:-1]:
        if (count := int.from_bytes(last[:n], "big") - (low := int.from_bytes(first[:n], "big")) + 1) <= 256:
            return [family + (low + k).to_bytes(n, "big") for k in range(count)]
    return [family]


def in_networks(rows: DataFrame, address: str, ranges: DataFrame, name: str) -> DataFrame:
    """Adds the tag of the range (first, last: 4 or 16 bytes) with the greatest start that holds the address in text, or null.

    Both families; they never meet.  An equi-join on leading bytes, as in_ranges() is on blocks of numbers.
    """
    blocks = F.udf(lambda a, b: _prefixes(bytes(a), bytes(b)) if a is not None and b is not None and len(a) == len(b) and a <= b else [], "array<binary>")
    listed = ranges.select(F.col("first").alias("_lo"), F.col("last").alias("_hi"), F.col("tag").alias("_tag"), F.explode(blocks("first", "last")).alias("_block"))
    wanted = rows.select(F.col(address).alias("_text")).distinct().withColumn("_a", scalars.address_bytes(F.col("_text"))).filter("_a IS NOT NULL")
    family = F.when(F.octet_length("_a") == 4, F.unhex(F.lit("04"))).otherwise(F.unhex(F.lit("10")))
    wanted = wanted.withColumn("_block", F.explode(F.array(*[F.concat(family, F.substring("_a", 1, n)) for n in LEVELS])))
    found = wanted.join(listed, "_block").filter(F.col("_a").between(F.col("_lo"), F.col("_hi")))
    best = found.groupBy("_text").agg(F.max_by("_tag", F.struct("_lo", "_tag")).alias(name))
    return rows.join(best, F.col(address) == F.col("_text"), "left").drop("_text")


def fingerprint_tags(rows: DataFrame, fingerprint: str, feed: DataFrame, name: str) -> DataFrame:
    """Adds the tag of a listed fingerprint (value, tag), in any case; of several the least."""
    listed = feed.select(F.lower("value").alias("_value"), "tag").groupBy("_value").agg(F.min("tag").alias(name))
    return rows.join(listed, F.lower(F.col(fingerprint)) == F.col("_value"), "left").drop("_value")


def domain_tags(rows: DataFrame, host: str, feed: DataFrame, name: str) -> DataFrame:
    """Adds the tag of the longest listed suffix, on label boundaries; a single label matches only itself."""
    labels = F.split(F.lower(F.col("_h")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))
    wanted = rows.select(F.col(host).alias("_h")).filter("_h IS NOT NULL").distinct().select("_h", F.explode(suffixes).alias("_suffix"))
    wanted = wanted.filter(F.col("_suffix").contains(".") | (F.col("_suffix") == F.lower("_h")))
    listed = feed.select(F.lower("domain").alias("_suffix"), F.col("tag").alias("_tag"))
    best = wanted.join(listed, "_suffix").groupBy("_h").agg(F.max_by("_tag", F.struct(F.length("_suffix"), "_tag")).alias(name))
    return rows.join(best, F.col(host) == F.col("_h"), "left").drop("_h")


def allow(alerts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Alerts that no entry covers; an entry's null fields hold for any value, categories in any case.

    One equi-join for each set of fields that entries give, so entries are never compared with all alerts.
    """
    fields = ["category", "src", "dst", "port"]
    given = F.concat(*[F.when(F.col(f).isNull(), "0").otherwise("1") for f in fields])
    shapes = [r["shape"] for r in allowed.select(given.alias("shape")).distinct().collect()]  # at most 2^4
    left = alerts
    for shape in sorted(shapes):
        used = [f for f, bit in zip(fields, shape, strict=True) if bit == "1"]
        if not used:
            continue
        entries = allowed.filter(given == shape).select(*[(F.upper(f) if f == "category" else F.col(f)).alias(f"_{f}") for f in used]).distinct()
        same = [(F.upper(F.col(f)) if f == "category" else F.col(f)) == F.col(f"_{f}") for f in used]
        condition = same[0]
        for s in same[1:]:
            condition = condition & s
        left = left.join(entries, condition, "left_anti")
    return left


def direction(src_home: Column, dst_home: Column) -> Column:
    return F.when(src_home & dst_home, "internal").when(src_home, "outbound").when(dst_home, "inbound").otherwise("external")


def as_of(rows: DataFrame, past: DataFrame, keys: list[str], values: list[str], sec: str = "ts_sec", seq: str = "seq", ttl: int | None = None) -> DataFrame:
    """Adds the values of the key's last past row before each row, if not older than ttl; one shuffle, no range join."""
    held = F.struct(F.col(sec).alias("_at"), *[F.col(v) for v in values])
    kept = [c for c in rows.columns if c not in values]
    left = rows.select(*kept, F.lit(None).cast(past.select(held.alias("h")).schema["h"].dataType).alias("_past"), F.lit(1).alias("_row"))
    right = past.select(*keys, sec, seq, held.alias("_past"), F.lit(0).alias("_row"))
    w = Window.partitionBy(*keys).orderBy(sec, seq, F.desc("_row")).rowsBetween(Window.unboundedPreceding, -1)
    found = left.unionByName(right, allowMissingColumns=True).withColumn("_found", F.last("_past", ignorenulls=True).over(w)).filter("_row = 1")
    fresh = F.lit(True) if ttl is None else F.col(sec) - F.col("_found._at") < ttl
    return found.select(*kept, *[F.when(fresh, F.col(f"_found.{v}")).alias(v) for v in values])
