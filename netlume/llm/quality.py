"""Quality classifier by importance resampling.

Two generative models over hashed byte n-grams, one of target texts and one of all texts, give each document the
logarithm of its importance weight; Gumbel noise is added and the top k documents are selected, which draws k documents
without replacement in proportion to their weights.

Target texts come from a bounded sample of labelled rows (`labels_kept`, the only bound); the raw model counts all texts
whole.  If no k is given, it is the number of documents whose weight is above the cut that tells the labelled sample's
classes apart best, so that the selection is as large as the share of good documents.

Defined results: null texts and texts shorter than an n-gram have weight 0; equal texts have equal weights and each row
its own noise by its id; documents that tie with the last selected one are selected too; without labels or documents
nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import workspace
from .arrow_text import ngram_hashes, units, utf8

NGRAM, BUCKETS = 4, 1 << 16
#: Labelled rows that the target model and the cut are fitted on, chosen by a hash of their ids.
LABELS_KEPT = 20_000
#: A good text that is rejected counts as so many others that are kept.
KEEP = 5
#: Pseudo-counts of each bucket.
PRIOR = 0.5
#: Units of the selection's keys.
SCALE = 1_000_000


def labelled(docs: DataFrame, labels: DataFrame, kept: int = LABELS_KEPT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and quality (null where the bounded sample has no label); one label a document."""
    one = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("labelled")).agg(F.max("quality").cast("int").alias("quality"))
    sample = one.orderBy(F.xxhash64("labelled"), "labelled").limit(kept)
    # the sample has LABELS_KEPT rows of an id and a number at most
    return docs.select(F.col(key), F.col(text)).join(F.broadcast(sample), F.col(key) == F.col("labelled"), "left").select(key, text, "quality")


def counts(rows: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Buckets' counts in all texts and in the target's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            data, offsets = utf8(b.column(0))
            good = np.array(b.column(1).fill_null(0).to_numpy(zero_copy_only=False) == 1)
            for first, last in units(offsets):
                part, off = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                h = ngram_hashes(part, NGRAM, BUCKETS)
                live = np.ones(len(part) + NGRAM, bool)
                for back in range(1, NGRAM):
                    live[np.maximum(off[1:] - back, 0)] = False
                live = live[: len(h)]
                raw += np.bincount(h[live], minlength=BUCKETS)
                if good[first:last].any():
                    chosen = np.repeat(good[first:last], np.diff(off))[: len(h)]
                    target += np.bincount(h[live & chosen], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    found = rows.select(F.col(text), "quality").mapInArrow(run, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in found.collect():  # one row a bucket at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    if not target.any():
        return np.zeros(BUCKETS)
    share = lambda c: np.log((c + PRIOR) / (c.sum() + PRIOR * BUCKETS))
    return share(target) - share(raw)


def weights(rows: DataFrame, ratios: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, quality, log_weight, n_ngrams."""
    shared = rows.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            data, offsets = utf8(b.column(2))
            sums, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
            for first, last in units(offsets):
                part, off = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                values = np.zeros(len(part))
                h = ngram_hashes(part, NGRAM, BUCKETS)
                values[: len(h)] = table[h]
                n = np.maximum(np.diff(off) - NGRAM + 1, 0)
                ends = np.stack((off[:-1], off[:-1] + n), 1)
                total = np.concatenate(([0.0], np.cumsum(values)))
                sums.append(total[ends[:, 1]] - total[ends[:, 0]])
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(np.concatenate(sums), 6)), pa.array(np.concatenate(sizes))], [key, "quality", "log_weight", "n_ngrams"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "quality", text).mapInArrow(run, f"`{key}` {kind}, quality int, log_weight double, n_ngrams bigint")


def best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The cut that leaves fewest labelled rows on the wrong side, good ones counting more; of cuts as good, the middle of the widest gap."""
    if not len(weight) or good.all() or not good.any():
        return -np.inf
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    wrong = KEEP * np.concatenate(([0], np.cumsum(g))) + (~g).sum() - np.concatenate(([0], np.cumsum(~g)))
    ends = np.concatenate(([w[0] - 1], w, [w[-1] + 1]))
    gaps = np.diff(ends)
    at = max(np.flatnonzero(wrong == wrong.min()), key=lambda k: gaps[k])
    return float(ends[at] + 0.5 * gaps[at])


def nth_largest(rows: DataFrame, name: str, k: int) -> int:
    """The k-th largest value of a bigint column, by histograms of 4,096 bars at most."""
    low, chosen = 0, rows.select(F.col(name).alias("v"))
    for shift in (60, 48, 36, 24, 12, 0):
        bars = sorted(((r["bar"], r["count"]) for r in chosen.groupBy(F.shiftright("v", shift).alias("bar")).count().collect()), reverse=True)
        for bar, n in bars:
            if k <= n:
                break
            k -= n
        low = bar
        chosen = chosen.filter(F.shiftright("v", shift) == bar)
    return low


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, log_weight, n_ngrams, draw (weight plus noise), selected: one row for each document."""
    rows = labelled(docs, labels, key=key, text=text)
    raw, target = counts(rows, text)
    scored = weights(rows, log_ratios(raw, target), key, text)
    noise = (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = scored.withColumn("draw", F.col("log_weight") - F.log(-F.log(noise))).withColumn("place", F.floor(F.col("draw") * SCALE).cast("bigint"))
    scored = workspace.written(scored, "weights")
    if k is None:
        # one row for each labelled id, LABELS_KEPT at most: of rows that share one, the heaviest
        known = scored.filter(F.col("quality").isNotNull()).groupBy(key).agg(F.max("log_weight").alias("log_weight"), F.max("quality").alias("quality")).toPandas()
        cut = best_cut(known["log_weight"].to_numpy(float), known["quality"].to_numpy() == 1)
        k = scored.filter(F.col("log_weight") > cut).count() if cut > -np.inf else scored.count()
    last = nth_largest(scored, "place", k) if k else None
    selected = F.col("place") >= last if k else F.lit(False)
    return scored.select(key, "log_weight", "n_ngrams", "draw", selected.alias("selected"))
