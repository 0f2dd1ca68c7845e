"""Document fingerprints from improbable features.

Every window of 64 bytes has an entropy; a histogram over all windows of all texts tells how rare each entropy is.  In
each run of 64 windows the rarest one (leftmost of equals) gets a vote, and windows with 16 votes or more are the
document's features.  Features go into a chain of Bloom filters of 2,048 bits, 160 features each.  Two fingerprints are
compared filter by filter: bits in common beyond those that chance gives, as a share of the most there could be; each
filter of the shorter chain counts with its best partner.

Defined results: null and empty texts have the empty fingerprint, which is like the empty one only; a text shorter than
a window, or without features, has one feature, the whole text; equal texts have equal fingerprints; very long texts
get long chains.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import units, utf8

WINDOW, RUN, VOTES = 64, 64, 16
BITS, HASHES, FEATURES = 2048, 5, 160
BINS = 1001
#: Windows of an entropy below this bin say nothing (runs of one byte).
LEAST_BIN = 100
#: Ranges of ids for each shuffle partition.
RANGES = 4
#: Bytes of text handled at once; a longer text is a unit of its own.  Each takes some hundred bytes of arrays.
UNIT = 1 << 18
_SCALE = 1024
_G = np.round(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * _SCALE).astype(np.int64)
_STEP = np.diff(_G)
_ODD = (np.arange(1, WINDOW // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def entropy_bins(flat: np.ndarray) -> np.ndarray:
    """The bin of the Shannon entropy of every window."""
    n = len(flat) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    before, after, same = np.zeros(len(flat), np.uint8), np.zeros(len(flat), np.uint8), np.empty(len(flat), bool)
    for d in range(1, WINDOW):
        eq = np.equal(flat[d:], flat[:-d], out=same[: len(flat) - d]).view(np.uint8)
        np.add(before[d:], eq, out=before[d:])
        np.add(after[:-d], eq, out=after[:-d])
    total = np.empty(n, np.int64)
    total[0] = _G[np.bincount(flat[:WINDOW], minlength=256)].sum()
    np.cumsum(_STEP[before[WINDOW:]] - _STEP[after[: n - 1]], out=total[1:])
    total[1:] += total[0]
    return (BINS - 1) - total * (BINS - 1) // int(_G[WINDOW])


def spread(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows apart by a run and a window of padding on either side: bytes, starts, sizes."""
    size, gap = np.diff(offsets), WINDOW + RUN
    starts = offsets[:-1] + gap * np.arange(1, len(size) + 1)
    flat = np.zeros(len(data) + gap * (len(size) + 1), np.uint8)
    flat[np.arange(len(data)) + np.repeat(starts - offsets[:-1], size)] = data
    return flat, starts, size


def valid_windows(flat: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    change = np.zeros(max(len(flat) - WINDOW + 2, 1), np.int32)
    some = size >= WINDOW
    change[starts[some]] += 1
    change[(starts + size - WINDOW + 1)[some]] -= 1
    return np.cumsum(change)[:-1] > 0


def histogram(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Windows by entropy bin, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BINS, np.int64)
        for b in batches:
            data, offsets = utf8(b.column(0))
            for first, last in units(offsets, UNIT):
                flat, starts, size = spread(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                found += np.bincount(entropy_bins(flat)[valid_windows(flat, starts, size)], minlength=BINS)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some])], ["bin", "n"])

    out = np.zeros(BINS, np.int64)
    for r in docs.select(F.col(text)).mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


def ranks(windows: np.ndarray) -> np.ndarray:
    """Place of each entropy bin in order of rarity, the rarest first; bins that say nothing come last."""
    rarity = -np.log2((windows + 1) / (windows.sum() + BINS))
    out = np.empty(BINS, np.int64)
    out[np.lexsort((np.arange(BINS), -rarity))] = np.arange(BINS)
    out[:LEAST_BIN] = BINS
    return out


def features(flat: np.ndarray, starts: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each selected window, in order."""
    n = len(flat) - WINDOW + 1
    keys = rank[entropy_bins(flat)]
    keys[~valid_windows(flat, starts, size)] = BINS
    none = keys == BINS
    keys = (keys << 32) | np.arange(n)
    least, span = keys, 1
    while span < RUN:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    votes = np.bincount(least & 0xFFFFFFFF, minlength=n)
    chosen = np.flatnonzero((votes >= VOTES) & ~none)
    held = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[chosen]).view("<u8").reshape(len(chosen), WINDOW // 8)
    return np.searchsorted(starts, chosen, "right") - 1, mixed((mixed(held * _ODD)).sum(axis=1, dtype=np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Chain:
    """The Bloom filters of one document."""

    __slots__ = ("filters", "n")

    def __init__(self, hashes: np.ndarray):
        if len(hashes):
            _, first = np.unique(hashes, return_index=True)
            hashes = hashes[np.sort(first)]
        self.n = len(hashes)
        self.filters = np.zeros((-(-self.n // FEATURES), BITS), bool)
        at = np.arange(self.n) // FEATURES
        for k in range(HASHES):
            self.filters[at, ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True

    def text(self) -> str:
        return f"{self.n}:{base64.b64encode(np.packbits(self.filters, axis=1).tobytes()).decode()}"

    @classmethod
    def of(cls, text: str) -> Chain:
        out = cls(np.zeros(0, np.uint64))
        n, _, coded = text.partition(":")
        out.n = int(n)
        out.filters = np.unpackbits(np.frombuffer(base64.b64decode(coded), np.uint8).reshape(-1, BITS // 8), axis=1).astype(bool)
        return out

    def like(self, other: Chain) -> float:
        a, b = (self, other) if (len(self.filters), self.n) <= (len(other.filters), other.n) else (other, self)
        if not a.n:
            return float(not b.n)
        x, y = a.filters.astype(np.float32), b.filters.astype(np.float32)
        in_x, in_y = x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
        chance, most = in_x * in_y / BITS, np.minimum(in_x, in_y)
        score = np.where(most > chance, (x @ y.T - chance) / np.maximum(most - chance, 1e-6), 0)
        held = np.minimum(FEATURES, a.n - FEATURES * np.arange(len(x)))
        return float(np.clip((score.max(axis=1) * held).sum() / held.sum(), 0, 1))


def chains(texts: list[str], rank: np.ndarray) -> list[Chain]:
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    out: list[Chain] = []
    for first, last in units(offsets, UNIT):
        flat, starts, size = spread(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        row, hashes = features(flat, starts, size, rank)
        ends = np.searchsorted(row, np.arange(last - first + 1))
        for k in range(last - first):
            own = hashes[ends[k] : ends[k + 1]]
            if not len(own) and size[k]:
                whole = hashlib.sha256(flat[starts[k] : starts[k] + size[k]].tobytes()).digest()
                own = np.frombuffer(whole[:8], "<u8")
            out.append(Chain(own))
    return out


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint: one row for each document."""
    rank = ranks(histogram(docs, text)) if rank is None else rank
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [c.text() for c in chains([t or "" for t in b.column(1).to_pylist()], rank)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], [key, "fingerprint"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, fingerprint string")


def in_sequence(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt by ranges of ids and sorted; each range ends with a copy of the row after it (`beyond`).

    Only one number for each range is gathered: the range's first id.  Rows of a range are never split.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ends = named.stat.approxQuantile("id", [k / (parts * RANGES) for k in range(1, parts * RANGES)], 0.2 / (parts * RANGES)) if parts * RANGES > 1 else []
    bounds = np.unique(np.array(ends, np.int64))

    def search(ids: pa.Array) -> pa.Array:
        # a null id goes before all others
        found = np.searchsorted(bounds, ids.fill_null(np.iinfo(np.int64).min).to_numpy(), "right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), -1, found).astype(np.int32))

    range_of = F.arrow_udf(search, "int")(F.col("id"))
    dealt = named.withColumn("dealt", range_of)
    heads = sorted((r["dealt"], r["head"]) for r in named.select("id").withColumn("dealt", range_of).groupBy("dealt").agg(F.min("id").alias("head")).collect())
    before = [(at, head, heads[k - 1][0]) for k, (at, head) in enumerate(heads)]
    firsts = spark.createDataFrame(before, "at int, head bigint, before int")
    joined = dealt.join(F.broadcast(firsts), F.col("dealt") == F.col("at"))
    here = F.struct(F.col("dealt").alias("range"), F.lit(False).alias("beyond"))
    there = F.struct(F.col("before").alias("range"), F.lit(True).alias("beyond"))
    twice = F.when(F.col("id").eqNullSafe(F.col("head")), F.array(here, there)).otherwise(F.array(here))
    rows = joined.select("id", "text", F.explode(twice).alias("place")).select("place.range", "place.beyond", "id", "text")
    return rows.repartition(parts, "range").sortWithinPartitions("range", "beyond", "id", "text")


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, whose last half gives way to the next document's first part."""
    rank = ranks(histogram(docs, text))
    columns = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, str, bool, Chain] | None = None
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                texts = b.column(3).to_pylist()
                rows = [*([last] if last else []), *zip(b.column(2).to_pylist(), texts, b.column(1).to_pylist(), chains(texts, rank), strict=True)]
                pairs = [(one, after) for one, after in zip(rows, rows[1:], strict=False) if not one[2]]
                edited = [one[1][: len(one[1]) - (n := len(one[1]) // 2)] + after[1][:n] for one, after in pairs]
                out = []
                for (one, after), text_, chain in zip(pairs, edited, chains(edited, rank), strict=True):
                    out.append((one[0], len(one[1]), hashlib.sha256(text_.encode()).hexdigest(), one[3].text(), chain.text(), one[3].like(chain), one[3].like(after[3])))
                last = rows[-1]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) if k else pa.array(c, pa.int64()) for k, c in enumerate(zip(*out, strict=True))], columns)

    return in_sequence(docs, key, text).mapInArrow(run, f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
