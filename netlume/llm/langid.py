"""Language identification by nearest centroids.

A text's letters become hashed byte n-grams, weighted by TF-IDF and normalised.  Spherical k-means gives each language
several centroids; a text takes the language of the centroid of the highest cosine.  A text is rejected if that cosine is
far below what texts of its length had when the model was fitted.

Document frequencies are counted over all training rows; the centroids are fitted on a sample of them, drawn by
a hash of their text, of `SAMPLE_ROWS` rows in expectation, shared equally by the languages: the same rows whatever the
partitions.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; a text without n-grams of its
letters takes the first language with score 0; ties go to the language that sorts first; training rows with a null text
or language are left out; without training rows every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import ngram_hashes, units, utf8, words_joined

GRAMS, BUCKETS = (2, 3), 1 << 12
SAMPLE_ROWS = 3_200
CENTROIDS = 4
#: A text is rejected below this share of the lowest cosines (one in 200) of its length in the sample.
REJECT = 0.5
ROWS_AT_ONCE = 256
UNKNOWN = "und"
_LETTERS = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalpha():
        _LETTERS[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of each row's hashed n-grams."""
    flat, bounds, _ = words_joined(data, offsets, _LETTERS)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    out = np.zeros(n * BUCKETS, np.int64)
    for size in GRAMS:
        h = ngram_hashes(flat, size, BUCKETS)
        same = row[: len(h)] == row[len(flat) - len(h) :]
        out += np.bincount((row[: len(h)] * BUCKETS + h)[same], minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def blocks(column) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, last row and counts of parts of a column."""
    data, offsets = utf8(column)
    for a, b in units(offsets):
        for first in range(a, b, ROWS_AT_ONCE):
            last = min(first + ROWS_AT_ONCE, b)
            yield first, last, vectors(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS), np.float32))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    floors: np.ndarray = field(default_factory=lambda: np.zeros(64))

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine, whether rejected."""
        cosine = weighted(counts, self.idf) @ self.centroids.T
        best = np.argmax(np.round(cosine, 6), axis=1)
        top = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        return self.owner[best], top, top < self.floors[length_class(counts)]


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.log2(counts.sum(axis=1) + 1).astype(np.int64)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids that start from the row nearest the mean and then from rows far from those before."""
    mean = x.sum(axis=0)
    chosen = [int(np.argmax(x @ mean))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        at = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[at == c].sum(axis=0) if (at == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def fit(train: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    rows = train.select(F.lower(F.col(text)).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(BUCKETS, np.int64), {}
        for b in batches:
            for _, _, counts in blocks(b.column(0)):
                total += (counts > 0).sum(axis=0)
            for name in b.column(1).to_pylist():
                seen[name] = seen.get(name, 0) + 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), pa.array(some, pa.int32()), pa.array(total[some])], ["lang", "bucket", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.nulls(len(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["lang", "bucket", "n"])

    found = rows.mapInArrow(frequencies, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    seen = {r["lang"]: r["n"] for r in found if r["lang"] is not None}
    total, df = sum(seen.values()), np.zeros(BUCKETS)
    for r in found:
        if r["lang"] is None:
            df[r["bucket"]] = r["n"]
    model = Model((np.log((1 + total) / (1 + df)) + 1).astype(np.float32), sorted(seen))
    if not seen:
        return model
    share = F.create_map(*[F.lit(x) for name, n in seen.items() for x in (name, min(1.0, sample_rows / len(seen) / n))])
    shared = train.sparkSession.sparkContext.broadcast(model.idf)

    def vectorised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, counts in blocks(b.column(0)):
                x = weighted(counts, shared.value).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(first, last - first), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(length_class(counts))], ["lang", "vector", "length"])

    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).mapInArrow(vectorised, "lang string, vector binary, length bigint").collect()
    order = sorted(range(len(sample)), key=lambda k: (sample[k]["lang"], sample[k]["vector"]))
    names = np.array([sample[k]["lang"] for k in order], dtype=object)
    x = np.stack([np.frombuffer(sample[k]["vector"], np.float16) for k in order]).astype(np.float32) if order else np.zeros((0, BUCKETS), np.float32)
    length = np.array([sample[k]["length"] for k in order], np.int64)
    parts, owner = [], []
    for k, name in enumerate(model.languages):
        if (own := names == name).any():
            parts.append(spherical_kmeans(x[own], CENTROIDS))
            owner += [k] * len(parts[-1])
    if parts:
        model.centroids, model.owner = np.concatenate(parts), np.array(owner)
        top = (x @ model.centroids.T).max(axis=1)
        low = np.quantile(top, 0.005)
        for c in range(64):
            if (own := length == c).sum() >= 20:
                low = np.quantile(top[own], 0.005)
                model.floors[c] = REJECT * low
            elif c and model.floors[c - 1]:
                model.floors[c] = model.floors[c - 1]
    return model


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, rejected: one row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for first, last, counts in blocks(b.column(1)):
                texts = b.column(1).slice(first, last - first).to_pylist()
                letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts])
                if len(m.centroids):
                    lang, score, rejected = m.predict(counts)
                else:
                    letters[:] = False
                    lang, score, rejected = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.ones(len(texts), bool)
                names = [m.languages[k] if ok else UNKNOWN for k, ok in zip(lang, letters, strict=True)]
                score = np.where(letters, score, 0).astype(float)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(names, pa.string()), pa.array(score), pa.array(rejected | ~letters)], [key, "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), F.lower(F.col(text)).alias("text")).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, rejected boolean")
