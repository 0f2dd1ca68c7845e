"""Folders for intermediate tables, in the place that all executors of the cluster share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Rows that go to a Python worker at once while a table is written: texts are long, and each side of the pipe holds a batch.
BATCH_ROWS = 1_000
#: Rows that a scan of whole texts decodes at once: its buffers hold that many texts and grow by doubling.
SCAN_ROWS = 256


@contextmanager
def at_most(spark: SparkSession, name: str, most: int) -> Iterator[None]:
    """This number of rows at most in the session's setting for what runs inside; the session's own comes back."""
    before = spark.conf.get(name)
    if not 0 < int(before) <= most:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bounded_batches(spark: SparkSession) -> AbstractContextManager[None]:
    return at_most(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def bounded_scans(spark: SparkSession) -> AbstractContextManager[None]:
    return at_most(spark, "spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, with this application's own folder under it.

    Without that setting only a session on one machine has a place that all of its tasks see.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"{tempfile.gettempdir()}/checkpoints"
    return f"{top.rstrip('/')}/netlume-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str) -> None:
    """Writes a table, or adds to one, without a process that the driver starts.

    Where Hadoop has no native library, a driver that makes a folder or a mark of success on a disk starts a process to
    set its permissions, and for that moment the driver's memory shows twice.  So folders on a disk are made here, with
    those of Spark's committer, and no mark is written: these tables are read by the one that wrote them.
    """
    if path.startswith("file:/"):
        os.makedirs(f"/{path[5:].lstrip('/')}/_temporary/0", exist_ok=True)
    with bounded_batches(df.sparkSession):
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").mode("append").parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table and read again: the lineage ends there, and a lost executor costs no recomputation."""
    write(df, path := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Intermediate tables that go when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(path := scratch(self.spark, name))
        write(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            remove(self.spark, path)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.drop()
