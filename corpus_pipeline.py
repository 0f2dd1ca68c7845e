"""A corpus pipeline: quality, language, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), decides on every row of docs and returns what stays, with the columns of
documents; the last returns each document's tokens as digests.  A decision holds for a doc_id: rows that share one go
together, null ids included.  Empty tables pass through; extra columns stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netlume.llm import bpe, decontam, jaccard, langid, quality, workspace
from netlume.llm.queries import table, tokenizer


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in `gone`."""
    ids = gone.select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["gone"]), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, quality.resample(docs, table(spark, sf_dir, "labels")).filter("NOT selected"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, langid.identify(docs, langid.fit(docs)).filter("rejected"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id, once: five words and a similarity of 0.8."""
    found = jaccard.jaccard_components(docs, size=5, num=80, den=100)
    ids = found.groupBy(F.col("doc_id").alias("id")).agg(F.max(~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("gone"), F.count("*").alias("rows"))
    rows = docs.select(F.struct("*").alias("doc")).join(ids.filter("NOT gone"), F.col("doc.doc_id").eqNullSafe(F.col("id")))
    # only rows that share an id can be the same row twice
    return rows.filter("rows = 1").select("doc.*").unionByName(rows.filter("rows > 1").select("doc.*").dropDuplicates(["doc_id", "text"]))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, tokenizer("word_bpe_49k.json"), digests=True)


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontamination", leak_stage),
    ("bpe_codec", token_stage),
]
#: SQL cannot express the fitted stages; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        tables = workspace.Tables(spark)
        docs = tables.written(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        before = tables
    return STAGES[-1][1](spark, docs, sf_dir)
