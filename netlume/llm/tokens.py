"""Token counts with a digest cache.

The SHA-256 of the normalised content (null is empty, UTF-8) and of the tokenizer file name a stored count.  Digests that
the cache lacks are made distinct, one text of each is encoded, and the new counts are appended to the cache; all rows
then take their counts from it.  Copies, however many, cost one encoding, and only digests are grouped, never texts.

A table may be counted in batches, dealt by a hash of the ids: later ones find what earlier ones have stored.

Defined results: null and empty texts have 0 tokens; equal texts share a count; rows with equal ids are kept; special
strings inside texts are tokens of their own, as the library's default is; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import workspace

#: Words kept by one Python worker with their counts; when the memory is full, those met in one unit of texts only go.
WORDS_KEPT = 100_000
#: Texts encoded at once; the library's encodings of all their new words are there together.
UNIT_TEXTS = 128
CACHE_SCHEMA = "tokenizer binary, digest binary, n_tokens bigint"


def tokenizer_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def splits_at_spaces(definition: dict) -> bool:
    """Whether a single space between two other characters always begins a piece: byte-level pieces, texts taken as they are."""
    before = definition.get("pre_tokenizer") or {}
    return before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and definition.get("normalizer") is None and (definition.get("model") or {}).get("type") == "BPE"


class PieceCounter:
    """Counts the pieces of a SentencePiece model."""

    def __init__(self, definition: bytes):
        from sentencepiece import SentencePieceProcessor

        self.encoder = SentencePieceProcessor(model_proto=definition)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encoder.encode(texts, num_threads=1)] if texts else []


class Counter:
    """Counts tokens as the library does; if pieces begin at single spaces, each distinct chunk between them is encoded once.

    A text's count is then the sum over its chunks, each with the space before it.
    """

    def __init__(self, definition: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(definition.decode())
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.chunked = splits_at_spaces(json.loads(definition))
        self.special = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}
        self.again: set[str] = set()

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.chunked:
            return self.whole(texts)
        out, known = [0] * len(texts), self.known
        odd, plain, words = [], [], set()
        for k, text in enumerate(texts):
            chunks = text.split(" ")
            if "" in chunks or any(s in text for s in self.special):
                if text:
                    odd.append(k)
                continue
            plain.append((k, chunks))
            words.update(chunks[1:])
        lacking = [w for w in words if w not in known]
        self.again.update(words.difference(lacking))
        if lacking:
            known.update(zip(lacking, self.whole([f" {w}" for w in lacking]), strict=True))
        firsts = self.whole([chunks[0] for _, chunks in plain])
        for (k, chunks), first in zip(plain, firsts, strict=True):
            out[k] = first + sum(map(known.__getitem__, chunks[1:]))
        for k, n in zip(odd, self.whole([texts[k] for k in odd]), strict=True):
            out[k] = n
        if len(known) > WORDS_KEPT:
            self.known = {w: known[w] for w in self.again} if len(self.again) <= WORDS_KEPT // 2 else {}
            self.again = set()
        return out


@lru_cache(maxsize=2)
def counter_of(definition: bytes) -> Counter | PieceCounter:
    """Kept by the Python worker from task to task."""
    return Counter(definition) if definition.lstrip()[:1] == b"{" else PieceCounter(definition)


def append_misses(named: DataFrame, keyed: DataFrame, definition: bytes, cache: str) -> None:
    """Appends the counts of contents that the cache at this path lacks: named has (key, content), keyed (key, digest)."""
    spark = named.sparkSession
    version = hashlib.sha256(definition).digest()
    lacking = keyed.groupBy("digest").agg(F.min("key").alias("key"))
    if workspace.exists(spark, cache):
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == F.lit(version))
        lacking = lacking.join(stored, "digest", "left_anti")
    # the table of a partition holds ids and digests only; texts pass it unsorted, and rows that share an id are dealt out
    chosen = lacking.select(F.col("key").alias("first"), F.col("digest").alias("wanted")).hint("shuffle_hash")
    texts = named.withColumn("digest", digest_of("content"))
    texts = texts.join(chosen, texts["key"].eqNullSafe(chosen["first"]) & (texts["digest"] == chosen["wanted"]))
    shared = spark.sparkContext.broadcast(definition)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, UNIT_TEXTS):
                part = b.slice(at, UNIT_TEXTS)
                n = counter.counts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.binary()), part.column(0), pa.array(n, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    workspace.write(texts.select("digest", "content").mapInArrow(encode, CACHE_SCHEMA), cache)


def digest_of(content: str) -> F.Column:
    return F.unhex(F.sha2(content, 256))


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 1024, key: str = "doc_id", text: str = "text", batches: int = 1) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for every row; `cache` is a folder of counts kept from run to run.

    `path` names a definition of the tokenizers library or a SentencePiece model.
    """
    spark = docs.sparkSession
    definition = tokenizer_bytes(path)
    version = hashlib.sha256(definition).digest()
    cache = cache or workspace.scratch(spark, "token-counts")
    named = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    batch = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(batches))
    with workspace.bounded_scans(spark):
        keyed = workspace.written(named.select("key", digest_of("content").alias("digest"), F.octet_length("content").cast("bigint").alias("n_bytes")), "digests")
        for k in range(batches):
            append_misses(*((x if batches == 1 else x.filter(batch == k)) for x in (named, keyed)), definition, cache)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == F.lit(version))
    # written, so that the join deals both sides on its own and can split a digest that very many rows have
    stored = workspace.written(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "stored")
    return keyed.join(stored, "digest").select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
