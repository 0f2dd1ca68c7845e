"""Live operation: rules that are read again when their file changes, alerts to sinks, and counters."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from netlume.rules.matcher import match
from netlume.rules.parser import Rule, RuleError, parse_rules


class ReloadingRules:
    """The rules of a file in any store that Spark reads; a file that cannot be used leaves the old rules in place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rules: list[Rule] = []
        self.generation, self.seen, self.error = 0, None, ""
        self.current()

    def version(self) -> tuple[int, int] | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return None
        status = fs.getFileStatus(p)
        return status.getModificationTime(), status.getLen()

    def current(self) -> list[Rule]:
        if (now := self.version()) is not None and now != self.seen:
            self.seen = now
            try:
                text = "\n".join(r["value"] for r in self.spark.read.text(self.path, wholetext=True).collect())
                self.rules, _ = parse_rules(text)
                self.generation, self.error = self.generation + 1, ""
            except RuleError as e:
                self.error = str(e)
        return self.rules


def matching(buffers: DataFrame, rules: ReloadingRules, keys: list[str], write) -> DataStreamWriter:
    """A writer that matches each micro-batch with the rules as they are then, and gives the hits to write(df, batch)."""

    def each(batch: DataFrame, number: int) -> None:
        hits = match(batch, rules.current(), keys).persist()
        try:
            write(hits, number)
        finally:
            hits.unpersist()

    return buffers.writeStream.foreachBatch(each)


class Counters(StreamingQueryListener):
    """Rows and batches of all queries, for sinks.render.prometheus()."""

    def __init__(self):
        self.lock, self.held = threading.Lock(), Counter()

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.held["queries_started"] += 1

    def onQueryProgress(self, event) -> None:
        with self.lock:
            self.held["batches"] += 1
            self.held["rows_in"] += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.held["queries_ended"] += 1

    def counts(self) -> dict[str, int]:
        with self.lock:
            return dict(self.held)
