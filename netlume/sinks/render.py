"""Alerts as lines: fixed-width text, NDJSON, and EVE JSON.  All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# EVE's numbers of severities.
EVE_SEVERITY = {"high": 1, "medium": 2, "low": 3}


def utc(seconds: Column) -> Column:
    """A timestamp that shows UTC in the session's zone."""
    return F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())


def text_line(df: DataFrame) -> DataFrame:
    """value: time, severity, category, endpoints and message; suppressed repeats in a note."""
    note = F.when(F.coalesce(F.col("suppressed"), F.lit(0)) > 0, F.format_string(" (%d more suppressed)", "suppressed")).otherwise("") if "suppressed" in df.columns else F.lit("")
    clock = F.date_format(utc(F.col("ts_sec")), "HH:mm:ss")
    line = F.format_string("%s [%-6s] %-17s %s -> %s %s", clock, F.upper("severity"), F.col("category"), F.coalesce(F.col("src").cast("string"), F.lit("-")), F.coalesce(F.col("dst").cast("string"), F.lit("-")), F.col("message"))
    return df.select(F.concat(line, note).alias("value"))


def ndjson(df: DataFrame) -> DataFrame:
    """value: one JSON object; absent optional fields are left out."""
    fields = [F.col("ts_sec").alias("time"), "severity", "category", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "proto", "port", "sid", "message"]
    fields += [c for c in ("direction", "src_tag", "dst_tag") if c in df.columns]
    return df.select(F.to_json(F.struct(*fields)).alias("value"))


def eve_time(seconds: Column) -> Column:
    return F.date_format(utc(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'")


def eve(df: DataFrame) -> DataFrame:
    """value: an EVE alert event."""
    severity = F.create_map(*[F.lit(x) for k, v in EVE_SEVERITY.items() for x in (k, v)])[F.col("severity")]
    alert = F.struct(F.lit("allowed").alias("action"), F.coalesce(F.col("sid"), F.lit(0)).alias("signature_id"), F.col("message").alias("signature"), F.col("category"), severity.alias("severity"))
    return df.select(F.to_json(F.struct(eve_time(F.col("ts_sec")).alias("timestamp"), F.lit("alert").alias("event_type"), F.col("src").cast("string").alias("src_ip"), F.col("dst").cast("string").alias("dest_ip"), F.col("port").alias("dest_port"), F.upper("proto").alias("proto"), alert.alias("alert"))).alias("value"))


def write_all(alerts: DataFrame, targets: dict[str, str]) -> None:
    """Each format to its folder; the alerts are kept while they are rendered."""
    render = {"text": text_line, "ndjson": ndjson, "eve": eve}
    held = alerts.persist()
    try:
        for name, path in targets.items():
            render[name](held).write.mode("append").text(path)
    finally:
        held.unpersist()


def flow_log(flows: DataFrame) -> DataFrame:
    """value: one JSON object for each record of flows.tcp_flow_log(); absent fields are left out."""
    from netlume.operators.flows import METADATA, flag_letters

    plain = [c for c in ("src", "src_port", "dst", "dst_port", "proto", "state") if c in flows.columns]
    vlan = [F.coalesce("vlan_id", F.lit(0)).alias("vlan")] if "vlan_id" in flows.columns else []
    counts = ["pkts_to_server", "pkts_to_client", "bytes_to_server", "bytes_to_client"]
    flags = [flag_letters(F.col(c)).alias(c) for c in ("flags_to_server", "flags_to_client")]
    more = [c for c in METADATA if c in flows.columns]
    fields = [F.col("start_sec").alias("start"), (F.col("end_sec") - F.col("start_sec")).alias("duration"), *plain, *vlan, *counts, *flags, "alerts", *more]
    return flows.select(F.to_json(F.struct(*fields)).alias("value"))


def write_rotated(lines: DataFrame, path: str, records: int = 1_000_000, generations: int = 5) -> str:
    """Lines as a new generation of files of so many records at most; the oldest beyond `generations` go.

    A generation appears whole or not at all, so a reader never sees one that is being written.
    """
    spark = lines.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted(f.getPath().getName() for f in fs.listStatus(top) if f.getPath().getName().startswith("generation=")) if fs.exists(top) else []
    name = f"generation={int(old[-1].partition('=')[2]) + 1 if old else 0:012d}"
    lines.write.option("maxRecordsPerFile", records).text(f"{path}/.{name}")
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/.{name}"), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
    for gone in [*old, name][:-generations]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{gone}"), True)
    return f"{path}/{name}"


def console(lines: DataFrame):
    """A writer of a stream of lines to the driver's output; a batch is printed as its rows arrive, never gathered."""
    if lines.isStreaming:
        return lines.writeStream.format("console").option("truncate", "false")
    for row in lines.toLocalIterator():
        print(row["value"])
    return None


def prometheus(counts: dict[str, int], prefix: str = "netlume") -> str:
    """Counters in the text form of metrics."""
    return "".join(f"# TYPE {prefix}_{k}_total counter\n{prefix}_{k}_total {v}\n" for k, v in sorted(counts.items()))
