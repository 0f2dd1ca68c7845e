"""Benchmark decontamination by Wu-Manber search over bytes.

Texts become their words (ASCII letters lowered), joined and enclosed by single blanks, as bytes.  The patterns are the
benchmark's windows in the same form.  A shift table over blocks of eight bytes tells how far the search may jump; where
it says 0, the bucket of the block's hash selects patterns that end so, and direct comparison confirms them.  Many
stretches of text move on at once, one vector step each, and every match is one of a whole window between blanks.

Defined results: null texts have no words; items without words have no windows; an item of fewer words than a window is
one window; repeated items or rows each count; very long texts are searched whole.  Items are taken in blocks of bounded
size.  A benchmark of one block is searched for in one pass; of several, each block has a pass of its own, one after the
other, and only one is held at a time; rows then take the hits of their key and text's digest.  Results are the same.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import workspace
from .arrow_text import units, utf8, words_joined

#: UTF-8 bytes of benchmark text in one broadcast block of items.
BLOCK_BYTES = 8 << 20
#: Bytes of text in each stretch that the search runs over in step with the others.
STRETCH = 512
#: Bits of the shift table.
TABLE_BITS = 21
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Byte classes: words consist of digits, letters a-z (A-Z lowered) and all bytes from 0x80 on; the rest separates.
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalnum():
        _CLASS[_b] = ord(chr(_b).lower())
    elif _b >= 0x80:
        _CLASS[_b] = _b


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words joined and enclosed by blanks: bytes, offsets; the start of each word in them, word offsets by row."""
    # two blanks in a row, where a text begins or ends with separators, are in no pattern
    flat, bounds, starts = words_joined(data, offsets, _CLASS)
    return flat, bounds, starts, np.searchsorted(starts, bounds)


class Patterns:
    """A Wu-Manber matcher for byte patterns of one number of words."""

    def __init__(self, patterns: dict[bytes, list[int]]):
        self.words = next(iter(patterns)).count(b" ") - 1
        self.texts = list(patterns)
        self.items = [patterns[t] for t in self.texts]
        self.least = min(map(len, self.texts))
        self.block = min(8, self.least)
        self.shift = np.full(1 << TABLE_BITS, self.least - self.block + 1, np.int32)
        self.buckets: dict[int, list[int]] = defaultdict(list)
        flat = np.frombuffer(b"".join(t[: self.least] for t in self.texts), np.uint8).reshape(len(self.texts), self.least)
        for end in range(self.block, self.least + 1):
            h = self.hash(flat[:, end - self.block : end])
            np.minimum.at(self.shift, h, self.least - end)
        for k, h in enumerate(h.tolist()):
            self.buckets[h].append(k)

    def hash(self, blocks: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(blocks), 8), np.uint8)
        wide[:, : self.block] = blocks
        return ((wide.view("<u8")[:, 0] * _MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, text: np.ndarray) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence."""
        b, m, n = self.block, self.least, len(text)
        if n < m:
            return []
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = text
        wide = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
        mask = np.uint64((1 << 8 * b) - 1)
        ends = np.arange(m, n + 1, STRETCH)  # of the compared window, exclusive
        most = np.minimum(ends + STRETCH, n + 1)
        hits: list[np.ndarray] = []
        while len(ends):
            h = ((wide[ends - b] & mask) * _MIX) >> np.uint64(64 - TABLE_BITS)
            jump = self.shift[h]
            if len(zero := np.flatnonzero(jump == 0)):
                hits.append(np.stack((ends[zero], h[zero].astype(np.int64))))
            ends = ends + np.maximum(jump, 1)
            live = ends < most
            ends, most = ends[live], most[live]
        out, raw = [], text.tobytes()
        for end, h in zip(*np.concatenate(hits, axis=1).tolist(), strict=True) if hits else ():
            start = end - m
            for k in self.buckets.get(h, ()):
                if raw.startswith(self.texts[k], start):
                    out.append((start, k))
        return out


def windows(items: list[tuple[str, str]], size: int) -> dict[int, dict[bytes, list[int]]]:
    """Patterns by number of words; each with the positions of its items."""
    out: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
    data = [(text or "").encode() for _, text in items]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    flat, bounds, _, _ = normalised(np.frombuffer(b"".join(data), np.uint8), offsets)
    for k in range(len(items)):
        words = flat[bounds[k] : bounds[k + 1]].tobytes().split()
        n = min(size, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            if k not in (held := out[n][b" " + b" ".join(words[at : at + n]) + b" "]):
                held.append(k)
    return out


class Matcher:
    def __init__(self, items: list[tuple[str, str]], size: int):
        self.ids = [i for i, _ in items]
        self.parts = [Patterns(p) for p in windows(items, size).values()]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[str]]]]:
        """Words by row; for rows with occurrences, the word ranges hit and the item ids."""
        flat, bounds, starts, rows = normalised(data, offsets)
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for p in self.parts:
            for at, k in p.find(flat):
                row = int(np.searchsorted(bounds, at, "right")) - 1
                word = int(np.searchsorted(starts, at)) - int(rows[row])
                spans, ids = found.setdefault(row, ([], set()))
                spans.append((word, word + p.words))
                ids.update(self.ids[i] for i in p.items[k])
        return np.diff(rows), found


def item_blocks(benchmark: DataFrame, item: str, text: str) -> tuple[int, DataFrame]:
    """Number of blocks of about BLOCK_BYTES, and the items with their block."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = int(size // BLOCK_BYTES) + 1
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    return n, rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))


def find_windows(docs: DataFrame, items: list[tuple[str, str]], size: int, key: str, text: str) -> DataFrame:
    """key, row (as given), n_words, spans, items: occurrences of one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, size)
        for b in batches:
            data, offsets = utf8(b.column(2))
            for first, last in units(offsets):
                n, found = matcher.scan(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                spans = [[{"start": s, "end": e} for s, e in found[k][0]] if k in found else [] for k in range(last - first)]
                ids = [sorted(found[k][1]) if k in found else [] for k in range(last - first)]
                part = b.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(ids, pa.list_(pa.string()))],
                    [key, "row", "n_words", "spans", "items"],
                )

    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, row string, n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"
    return docs.select(F.col(key), "row", F.col(text)).mapInArrow(run, schema)


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, n_words, spans (word ranges hit), items (ids as sorted strings): one row for each document."""
    n, rows = item_blocks(benchmark, item, item_text)
    held = lambda k: [(r["item"], r["text"]) for r in rows.filter(F.col("block") == k).collect()]  # noqa: E731  BLOCK_BYTES or so
    if n == 1:
        return find_windows(docs.select(F.col(key), F.col(text), F.lit("").alias("row")), held(0), size, key, text).drop("row")
    named = docs.select(F.col(key), F.col(text), F.sha2(F.col(text), 256).alias("row"))
    parts = []
    for k in range(n):
        found = find_windows(named, held(k), size, key, text)
        parts.append(workspace.written(found.filter(F.size("items") > 0).select(F.col(key).alias("key"), "row", "spans", "items"), "hits"))
    # rows of one key and text have the same hits: each block's count once
    hits = reduce(DataFrame.unionAll, [p.dropDuplicates(["key", "row"]) for p in parts])
    hits = workspace.written(hits.groupBy("key", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).withColumnRenamed("row", "hit"), "hits")
    words = find_windows(named, [], size, key, text).select(key, "row", "n_words")
    words = words.select(F.col(key).alias("own"), "row", "n_words")
    joined = words.join(hits, F.col("own").eqNullSafe(F.col("key")) & F.col("row").eqNullSafe(F.col("hit")), "left")
    none = hits.schema
    return joined.select(F.col("own").alias(key), "n_words", F.coalesce("spans", F.array().cast(none["spans"].dataType)).alias("spans"), F.coalesce("items", F.array().cast(none["items"].dataType)).alias("items"))


def covered(spans) -> F.Column:
    """Words inside any of the ranges."""
    ordered = F.array_sort(spans)
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("bigint"), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end")
    )
    zero = F.lit(0).cast("bigint")
    return F.aggregate(ordered, F.struct(zero.alias("n"), zero.alias("end")), step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = occurrences(docs, benchmark, size, key, text)
    n_hit = covered(F.col("spans"))
    return found.select(
        F.col(key), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


