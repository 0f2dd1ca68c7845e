"""Queries of the library over the driver's tables, each beside SQL that gives the same rows.

The tables have no packets, so events and line items stand in for observations; windows are wide and limits low to suit
them, and each is stated once for both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from netlume.operators import control, detectors, enrich, flows, windows

DAY = 86_400
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import protocol_queries, rule_queries, state_queries  # noqa: F401  register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Whole seconds of a timestamp without zone, read as UTC whatever the session's zone is."""
    c = F.col(column)
    return F.unix_date(F.to_date(c)).cast("bigint") * DAY + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), seconds("ts").alias("ts_sec"), F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("bigint").alias("dst"), F.col("event_type").alias("dst_port"),
        F.round(F.col("value") * 100).cast("bigint").alias("bytes_out"), (F.round(F.col("value") * 100).cast("bigint") % 97).alias("bytes_in"), (F.col("event_type") != "error").alias("answered"),
    )


OBS = """obs AS (SELECT event_id AS seq, epoch_us(ts) // 1000000 AS ts_sec, user_id AS src, CAST(json_extract(props, '$.k') AS BIGINT) AS dst, event_type AS dst_port,
    CAST(round(value * 100) AS BIGINT) AS bytes_out, CAST(round(value * 100) AS BIGINT) % 97 AS bytes_in, event_type <> 'error' AS answered FROM events)"""


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations of one second a day: many ties."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.floor(seconds("l_shipdate") / DAY)).cast("bigint").alias("ts_sec"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("dst_port"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("bytes_out"), F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("bigint").alias("bytes_in"), (F.col("l_returnflag") != "R").alias("answered"), F.col("l_quantity").cast("bigint").alias("packets"),
    )


SHIP = """obs AS (SELECT l_orderkey * 10 + l_linenumber AS seq, (epoch_us(l_shipdate) // 1000000) // 86400 AS ts_sec, l_suppkey AS src, l_partkey AS dst, l_linenumber AS dst_port,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes_out, CAST(round(l_extendedprice * l_discount * 100) AS BIGINT) AS bytes_in, l_returnflag <> 'R' AS answered, CAST(l_quantity AS BIGINT) AS packets FROM lineitem)"""


def sliding(aggregate: str, keys: str, width: int, sec: str = "ts_sec") -> str:
    """SQL for a sliding value that sees earlier rows of a row's own second only: every pair of rows is compared."""
    same = " AND ".join(f"p.{k} = o.{k}" for k in keys.split(", "))
    return f"(SELECT {aggregate} FROM obs p WHERE {same} AND p.{sec} > o.{sec} - {width} AND (p.{sec} < o.{sec} OR (p.{sec} = o.{sec} AND p.seq <= o.seq)))"


def anchored(source: str, keys: str, span: int) -> str:
    """SQL for greedy anchors of `source` (a CTE with ts_sec and seq): CTE `anchors` of keys, a (encoded second and sequence)."""
    same = " AND ".join(f"o.{k} = r.{k}" for k in keys.split(", "))
    cols = ", ".join(f"r.{k}" for k in keys.split(", "))
    return f"""anchors AS (SELECT {keys}, min(CAST(ts_sec AS HUGEINT) * 100000000000 + seq) AS a FROM {source} GROUP BY {keys}
        UNION ALL SELECT {cols}, (SELECT min(CAST(ts_sec AS HUGEINT) * 100000000000 + seq) FROM {source} o WHERE {same} AND o.ts_sec >= r.a // 100000000000 + {span}) FROM anchors r WHERE r.a IS NOT NULL)"""


def gated(source: str, keys: str, span: int, columns: str) -> str:
    """SQL for the rows of `source` that pass a gate."""
    return f"{anchored(source, keys, span)} SELECT {columns} FROM {source} JOIN (SELECT DISTINCT {keys}, a FROM anchors) USING ({keys}) WHERE CAST(ts_sec AS HUGEINT) * 100000000000 + seq = a"


def alert_sql(base: str, where: str, measure: str, keys: str, span: int, columns: str, category: str, severity: str, limit: str) -> str:
    rows = f"hot AS (SELECT * FROM (SELECT *, {measure} AS measure FROM obs o WHERE {where}) WHERE measure > {limit})"
    return f"WITH RECURSIVE {base}, {rows}, {gated('hot', keys, span, f'{columns}, measure')}".replace("SELECT " + columns + ", measure", f"SELECT {columns}, CAST(measure AS BIGINT) AS measure, '{category}' AS category, '{severity}' AS severity")


def shown(alerts: DataFrame, *columns: str) -> DataFrame:
    return alerts.select(*columns, F.col("measure").cast("bigint").alias("measure"), "category", "severity")


# windows ------------------------------------------------------------------------------------------------------------


@query(f"WITH {SHIP} SELECT seq, CAST({sliding('sum(bytes_out)', 'src', 30)} AS BIGINT) AS total FROM obs o")
def w1_rate(spark, sf_dir):
    obs = shipments(spark, sf_dir)
    return windows.with_rates(obs.select("seq", "src", "ts_sec", "bytes_out"), ["src"], {"total": F.col("bytes_out")}, 30).select("seq", "total")


@query(f"WITH {SHIP} SELECT seq, {sliding('count(DISTINCT dst)', 'src', 30)} AS n_distinct FROM obs o")
def w2_distinct(spark, sf_dir):
    obs = shipments(spark, sf_dir)
    return obs.select("seq", windows.distinct(["src"], F.col("dst"), 30).alias("n_distinct"))


@query(f"WITH {SHIP} SELECT seq, {sliding('count(DISTINCT dst)', 'src', 30)} AS n_distinct FROM obs o")
def w2_distinct_by_intervals(spark, sf_dir):
    return windows.distinct_by_intervals(shipments(spark, sf_dir).select("seq", "src", "dst", "ts_sec"), ["src"], "dst", 30).select("seq", "n_distinct")


@query(f"WITH RECURSIVE {OBS}, {gated('obs', 'src', 2 * DAY, 'seq, src, ts_sec')}")
def w3_gate(spark, sf_dir):
    return windows.gate(observations(spark, sf_dir), ["src"], 2 * DAY).select("seq", "src", "ts_sec")


GAPS = """gaps AS (SELECT DISTINCT src, ts_sec FROM obs), lagged AS (SELECT *, ts_sec - lag(ts_sec) OVER (PARTITION BY src ORDER BY ts_sec) AS gap FROM gaps),
    rings AS (SELECT src, ts_sec, count(gap) OVER w AS n_gaps, avg(gap) OVER w AS gap_mean, stddev_pop(gap) OVER w AS dev FROM lagged WINDOW w AS (PARTITION BY src ORDER BY ts_sec ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {OBS}, {GAPS} SELECT src, ts_sec, n_gaps, round(gap_mean, 3) AS gap_mean, round(dev / gap_mean, 4) AS gap_cv FROM rings WHERE n_gaps >= 6")
def w4_periodicity(spark, sf_dir):
    return windows.periodicity(observations(spark, sf_dir), ["src"]).withColumn("gap_mean", F.round("gap_mean", 3)).withColumn("gap_cv", F.round("gap_cv", 4))


@query("SELECT page_id, round(list_aggregate(string_split(url, ''), 'entropy'), 5) AS bits FROM pages")
def w5_entropy(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.round(windows.entropy(F.col("url")), 5).alias("bits"))


@query(f"WITH RECURSIVE {SHIP}, {anchored('obs', 'src', 90)} SELECT seq, src, CAST((SELECT max(a // 100000000000) FROM anchors WHERE anchors.src = obs.src AND a <= CAST(ts_sec AS HUGEINT) * 100000000000 + seq) AS BIGINT) AS anchor_sec FROM obs")
def w6_anchors(spark, sf_dir):
    return windows.greedy_anchors(shipments(spark, sf_dir), ["src"], 90).select("seq", "src", "anchor_sec")


@query(f"WITH {OBS}, f AS (SELECT *, CASE WHEN ts_sec - lag(ts_sec) OVER (PARTITION BY src ORDER BY ts_sec, seq) >= {DAY} THEN 1 ELSE 0 END AS fresh FROM obs) SELECT seq, CAST(sum(fresh) OVER (PARTITION BY src ORDER BY ts_sec, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f")
def w7_idle_sessions(spark, sf_dir):
    return windows.idle_sessions(observations(spark, sf_dir), ["src"], DAY).select("seq", "session")


# detectors ----------------------------------------------------------------------------------------------------------


@query(alert_sql(OBS, "true", sliding("count(DISTINCT dst_port)", "src, dst", 10 * DAY), "src, dst", DAY, "src, dst, ts_sec", "PORT_SCAN", "medium", "1"))
def d01_port_scan(spark, sf_dir):
    return shown(detectors.port_scan(observations(spark, sf_dir), width=10 * DAY, limit=1, gate=DAY), "src", "dst", "ts_sec")


PER_DAY = "base AS (SELECT src, ts_sec, sum(packets) AS packets, ts_sec AS seq FROM raw GROUP BY src, ts_sec), obs AS (SELECT * FROM base)"


@query(alert_sql(f"{SHIP.replace('obs AS', 'raw AS', 1)}, {PER_DAY}", "true", sliding("sum(packets)", "src", 30), "src", 30, "src, ts_sec", "PACKET_FLOOD", "high", "300"))
def d02_packet_flood(spark, sf_dir):
    return shown(detectors.packet_flood(shipments(spark, sf_dir), width=30, limit=300, gate=30), "src", "ts_sec")


@query(alert_sql(OBS, "true", sliding("count(*)", "src", 2 * DAY), "src", DAY, "src, ts_sec", "PACKET_FLOOD", "high", "6"))
def d03_flood_local(spark, sf_dir):
    return shown(detectors.counted(observations(spark, sf_dir), ["src"], F.lit(1), "PACKET_FLOOD", "high", 2 * DAY, 6, DAY), "src", "ts_sec")


@query(alert_sql(OBS.replace("FROM events)", "FROM events WHERE event_type = 'error')"), "true", sliding("count(DISTINCT dst)", "src, dst_port", 7 * DAY), "src", DAY, "src, dst_port, ts_sec", "HORIZONTAL_SCAN", "high", "3"))
def d04_horizontal_scan(spark, sf_dir):
    return shown(detectors.horizontal_scan(observations(spark, sf_dir), width=7 * DAY, limit=3, gate=DAY), "src", "dst_port", "ts_sec")


@query(alert_sql(SHIP.replace("FROM lineitem)", "FROM lineitem WHERE l_returnflag = 'R')"), "true", sliding("count(DISTINCT dst)", "src", 60), "src", 30, "src, ts_sec", "HOST_SWEEP", "medium", "8"))
def d05_host_sweep(spark, sf_dir):
    return shown(detectors.host_sweep(shipments(spark, sf_dir), width=60, limit=8, gate=30), "src", "ts_sec")


@query(alert_sql(OBS, "true", sliding("count(*)", "src, dst_port", 3 * DAY), "src, dst_port", DAY, "src, dst_port, ts_sec", "BRUTE_FORCE", "high", "3"))
def d06_brute_force_attempts(spark, sf_dir):
    return shown(detectors.brute_force(observations(spark, sf_dir), False, ["src", "dst_port"], width=3 * DAY, limit=3, gate=DAY), "src", "dst_port", "ts_sec")


@query(alert_sql(OBS.replace("FROM events)", "FROM events WHERE event_type = 'error')"), "true", sliding("count(*)", "src", 3 * DAY), "src", DAY, "src, ts_sec", "BRUTE_FORCE", "high", "2"))
def d07_brute_force_refused(spark, sf_dir):
    return shown(detectors.brute_force(observations(spark, sf_dir).filter("dst_port = 'error'"), True, ["src"], width=3 * DAY, limit=2, gate=DAY), "src", "ts_sec")


@query(f"WITH RECURSIVE {OBS}, {GAPS}, hot AS (SELECT src, ts_sec, ts_sec AS seq, gap_mean AS measure FROM rings WHERE n_gaps >= 6 AND dev / gap_mean <= 0.5 AND gap_mean >= 5), {anchored('hot', 'src', DAY)} SELECT src, ts_sec, round(measure, 3) AS gap_mean FROM hot JOIN (SELECT DISTINCT src, a FROM anchors) USING (src) WHERE CAST(ts_sec AS HUGEINT) * 100000000000 + seq = a")
def d08_beaconing(spark, sf_dir):
    return detectors.beaconing(observations(spark, sf_dir), ["src"], cv=0.5, gate=DAY, idle=None).select("src", "ts_sec", F.round("measure", 3).alias("gap_mean"))


@query(alert_sql(OBS, "true", sliding("sum(bytes_out)", "src", 3 * DAY), "src", DAY, "src, ts_sec", "DATA_EXFIL_VOLUME", "medium", "60000"))
def d09_exfil_volume(spark, sf_dir):
    return shown(detectors.exfiltration_volume(observations(spark, sf_dir), width=3 * DAY, limit=60_000, gate=DAY), "src", "ts_sec")


@query(alert_sql(SHIP, f"{sliding('sum(bytes_out)', 'src', 30)} > 20 * greatest({sliding('sum(bytes_in)', 'src', 30)}, 1)", sliding("sum(bytes_out)", "src", 30), "src", 30, "src, ts_sec", "DATA_EXFIL_RATIO", "medium", "1000000"))
def d10_exfil_ratio(spark, sf_dir):
    return shown(detectors.exfiltration_ratio(shipments(spark, sf_dir), width=30, limit=1_000_000, ratio=20.0, gate=30), "src", "ts_sec")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page hosts as questions: the path is a label before the host."""
    host, path = F.regexp_extract("url", r"^https?://([^/]+)", 1), F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.col("page_id").alias("ts_sec"), (F.col("page_id") % 5).alias("src"), F.concat(F.regexp_replace(path, "[^a-z0-9]", "-"), F.lit("."), host).alias("name"))


NAMES = """named AS (SELECT page_id AS seq, page_id AS ts_sec, page_id % 5 AS src, regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '[^a-z0-9]', '-', 'g') || '.' || regexp_extract(url, '^https?://([^/]+)', 1) AS name FROM pages),
    parts AS (SELECT *, string_split(name, '.') AS labels FROM named), domains AS (SELECT *, array_to_string(labels[-2:], '.') AS parent, CASE WHEN len(labels) > 2 THEN array_to_string(labels[:-3], '.') END AS sub FROM parts)"""


@query(alert_sql(f"{NAMES}, obs AS (SELECT * FROM domains WHERE octet_length(encode(sub)) >= 8 AND list_aggregate(string_split(sub, ''), 'entropy') >= 2.5)", "true", sliding("count(DISTINCT sub)", "src, parent", 100), "src, parent", 20, "src, parent, ts_sec", "DNS_TUNNEL", "high", "2"))
def d11_dns_tunnel(spark, sf_dir):
    return shown(detectors.dns_tunnel(names(spark, sf_dir), width=100, limit=2, entropy=2.5, gate=20), "src", "parent", "ts_sec")


@query(f"WITH RECURSIVE {NAMES}, hot AS (SELECT *, octet_length(encode(name)) AS measure FROM domains WHERE octet_length(encode(name)) >= 25), {anchored('hot', 'src, parent', 20)} SELECT src, parent, ts_sec, CAST(measure AS BIGINT) AS measure, 'DNS_LONG_NAME' AS category, 'low' AS severity FROM hot JOIN (SELECT DISTINCT a FROM anchors) ON CAST(ts_sec AS HUGEINT) * 100000000000 + seq = a")
def d12_dns_long_name(spark, sf_dir):
    return shown(detectors.dns_long_name(names(spark, sf_dir), limit=25, gate=20), "src", "parent", "ts_sec")


@query("SELECT o_orderkey AS flow_id, o_custkey AS client_bytes FROM orders WHERE o_custkey >= 100 AND o_orderstatus = 'F' AND o_orderkey % 4 IN (0, 1, 2)")
def d13_protocol_mismatch(spark, sf_dir):
    text = F.lit(None).cast("string")
    port = F.element_at(F.array(F.lit(80), F.lit(443), F.lit(22), F.lit(9999)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("flow_id"), port.alias("dst_port"), F.when(F.col("o_custkey") >= 100, F.col("o_custkey") + 256).otherwise(0).alias("client_bytes"), (F.col("o_orderstatus") == "F").alias("syn_seen"), text.alias("http_uri"), text.alias("tls_sni"), text.alias("tls_ja3"), text.alias("ssh_version"))
    return detectors.protocol_mismatch(found).select("flow_id", (F.col("client_bytes") - 256).alias("client_bytes"))


@query("SELECT event_id AS seq, severity FROM events JOIN (SELECT 'high' AS severity, 3 AS m UNION ALL SELECT 'medium', 5) ON CASE WHEN severity = 'high' THEN user_id % 7 = 3 ELSE CAST(json_extract(props, '$.k') AS BIGINT) % 7 = 3 END")
def d15_deny_list(spark, sf_dir):
    found = observations(spark, sf_dir)
    # the addresses themselves, so that the list has no end however large keys are
    denied = found.select(F.explode(F.array("src", "dst")).alias("address")).filter("address % 7 = 3")
    return detectors.deny_list(found, denied).select("seq", "severity")


# rate control -------------------------------------------------------------------------------------------------------

WINDOWED = f"{{keys}}, a // 100000000000 AS anchor FROM anchors WHERE a IS NOT NULL), placed AS (SELECT o.*, (SELECT max(anchor) FROM begun b WHERE {{same}} AND anchor <= o.ts_sec) AS anchor FROM obs o), numbered AS (SELECT *, row_number() OVER (PARTITION BY {{keys}}, anchor ORDER BY ts_sec, seq) AS n FROM placed)"


def control_sql(keys: str, seconds_: int, keep: str) -> str:
    same = " AND ".join(f"b.{k} = o.{k}" for k in keys.split(", "))
    return f"WITH RECURSIVE {OBS.replace('AS answered', 'AS answered, event_type AS sid')}, {anchored('obs', keys, seconds_)}, begun AS (SELECT DISTINCT {WINDOWED.format(keys=keys, same=same)} SELECT seq FROM numbered WHERE {keep}"


def as_alerts(spark, sf_dir) -> DataFrame:
    return observations(spark, sf_dir).withColumn("sid", F.col("dst_port"))


def _control(name: str, kind: str, track: str, count: int, span: int, keep: str) -> None:
    def run(spark, sf_dir):
        return control.threshold(as_alerts(spark, sf_dir), kind, track, count, span).select("seq")

    run.__name__ = name
    query(control_sql(", ".join(control.TRACK[track]), span, keep))(run)


_control("t1_limit", "limit", "by_src", 2, 3 * DAY, "n <= 2")
_control("t2_threshold", "threshold", "by_both", 2, 9 * DAY, "n % 2 = 0")
_control("t3_both", "both", "by_dst", 3, 2 * DAY, "n = 3")
_control("t4_detection_filter", "detection_filter", "by_src", 2, 5 * DAY, "n > 2")
_control("t5_by_rule", "limit", "by_rule", 5, 3600, "n <= 5")


@query(f"WITH {OBS} SELECT seq FROM obs o WHERE dst_port = 'purchase' AND coalesce((SELECT arg_max(CASE WHEN p.dst_port = 'signup' THEN p.ts_sec + {DAY} ELSE -1 END, p.seq) FROM obs p WHERE p.src = o.src AND p.seq < o.seq AND p.dst_port IN ('signup', 'error')), -1) > ts_sec")
def t6_bit_isset(spark, sf_dir):
    obs = observations(spark, sf_dir)
    bit = control.bit_is_set(obs, ["src"], F.col("dst_port") == "signup", F.col("dst_port") == "error", DAY)
    return obs.withColumn("set", bit).filter("set AND dst_port = 'purchase'").select("seq")


@query(f"WITH {OBS} SELECT seq FROM obs o WHERE dst_port NOT IN ('purchase') OR NOT coalesce((SELECT arg_max(CASE WHEN p.dst_port = 'signup' THEN p.ts_sec + {DAY} ELSE -1 END, p.seq) FROM obs p WHERE p.src = o.src AND p.seq < o.seq AND p.dst_port IN ('signup', 'error')), -1) > ts_sec")
def t6_cross_bits_fold(spark, sf_dir):
    op = F.when(F.col("dst_port") == "signup", "set").when(F.col("dst_port") == "error", "unset").when(F.col("dst_port") == "purchase", "isnotset")
    return control.cross_bits(observations(spark, sf_dir).withColumn("xbit_op", op), ["src"], DAY).select("seq")


@query(control_sql("src, sid", 3 * DAY, "n = 1").replace("SELECT seq FROM numbered WHERE n = 1", "SELECT seq, coalesce(lag(held) OVER (PARTITION BY src, sid ORDER BY ts_sec), 0) AS suppressed FROM (SELECT *, count(*) OVER (PARTITION BY src, sid, anchor) - 1 AS held FROM numbered) WHERE n = 1"))
def x2_suppress(spark, sf_dir):
    return control.suppress(as_alerts(spark, sf_dir), ["src", "sid"], 3 * DAY).select("seq", "suppressed")


# joins with feeds ---------------------------------------------------------------------------------------------------

RANGES = [(100, 199, "lab"), (150, 260, "lab"), (120, 130, "printer"), (70_000, 140_000, "far"), (1_000, 1_000, "one")]
RANGE_SQL = "ranges AS (SELECT * FROM (VALUES " + ", ".join(f"({lo}, {hi}, '{tag}')" for lo, hi, tag in RANGES) + ") t(lo, hi, tag))"


def feed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RANGES, "lo bigint, hi bigint, tag string")


@query(f"WITH {RANGE_SQL}, m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY tag ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ranges), n AS (SELECT *, sum(fresh) OVER (PARTITION BY tag ORDER BY lo, hi) AS island FROM m) SELECT tag, min(lo) AS lo, max(hi) AS hi FROM n GROUP BY tag, island")
def u3_range_merge(spark, sf_dir):
    return enrich.merge_ranges(feed(spark)).select("tag", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))


@query(f"WITH {RANGE_SQL} SELECT c_custkey, (SELECT arg_max(tag, lo) FROM ranges WHERE c_custkey * 37 BETWEEN lo AND hi) AS tag FROM customer")
def j4_range_reputation(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 37).alias("address"))
    return enrich.in_ranges(rows, "address", enrich.merge_ranges(feed(spark)), "tag").select("c_custkey", "tag")


DOMAINS = [("spam-farm.example.org", "spam"), ("example.net", "net"), ("example.org", "org"), ("com", "never")]


@query("WITH d AS (SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{t}')" for d, t in DOMAINS) + ") t(domain, tag)), h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:]+)', 1)) AS host FROM pages) SELECT page_id, host, (SELECT arg_max(tag, length(domain)) FROM d WHERE host = domain OR (domain LIKE '%.%' AND host LIKE '%.' || domain)) AS tag FROM h")
def j5_domain_suffix(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^https?://([^/:]+)", 1)).alias("host"))
    return enrich.domain_tags(rows, "host", spark.createDataFrame(DOMAINS, "domain string, tag string"), "tag").select("page_id", "host", "tag")


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY ALL HAVING count(*) > 1)")
def j6_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    listed = docs.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    return docs.join(listed, "digest").select("doc_id", "digest")


@query(f"WITH {OBS} SELECT seq FROM obs WHERE NOT (upper(dst_port) = 'CLICK' AND src = 3) AND NOT (dst = 7) AND NOT (upper(dst_port) = 'VIEW' AND dst = 8 AND src = 1)")
def j7_allowlist(spark, sf_dir):
    allowed = spark.createDataFrame([("Click", 3, None, None), (None, None, 7, None), ("VIEW", 1, 8, None)], "category string, src bigint, dst bigint, port int")
    alerts = observations(spark, sf_dir).withColumn("category", F.col("dst_port")).withColumn("port", F.lit(0))
    return enrich.allow(alerts, allowed).select("seq")


@query(f"WITH {OBS} SELECT seq, CASE WHEN src < 50 AND dst < 50 THEN 'internal' WHEN src < 50 THEN 'outbound' WHEN dst < 50 THEN 'inbound' ELSE 'external' END AS direction FROM obs")
def j8_direction(spark, sf_dir):
    return observations(spark, sf_dir).select("seq", enrich.direction(F.col("src") < 50, F.col("dst") < 50).alias("direction"))


@query(f"WITH {OBS}, {RANGE_SQL} SELECT seq, (SELECT arg_max(tag, lo) FROM ranges WHERE src BETWEEN lo AND hi) AS src_tag, (SELECT arg_max(tag, lo) FROM ranges WHERE dst * 3 BETWEEN lo AND hi) AS dst_tag FROM obs")
def j9_tags(spark, sf_dir):
    rows = observations(spark, sf_dir).select("seq", "src", (F.col("dst") * 3).alias("dst"))
    merged = enrich.merge_ranges(feed(spark))
    return enrich.in_ranges(enrich.in_ranges(rows, "src", merged, "src_tag"), "dst", merged, "dst_tag").select("seq", "src_tag", "dst_tag")


@query(f"WITH {OBS} SELECT seq, (SELECT arg_max(p.bytes_out, p.seq) FROM obs p WHERE p.src = o.src AND p.dst_port = 'view' AND p.seq < o.seq) AS last_view FROM obs o WHERE dst_port = 'purchase'")
def j13_as_of(spark, sf_dir):
    obs = observations(spark, sf_dir)
    views = obs.filter("dst_port = 'view'").select("src", "ts_sec", "seq", F.col("bytes_out").alias("last_view"))
    return enrich.as_of(obs.filter("dst_port = 'purchase'").select("seq", "src", "ts_sec"), views, ["src"], ["last_view"]).select("seq", "last_view")


# flows --------------------------------------------------------------------------------------------------------------


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as packets."""
    c = table(spark, sf_dir, "conversations")
    client = F.col("role").isin("user", "system")
    return c.select(F.col("conv_id").alias("flow"), F.col("turn").alias("seq"), (F.col("turn") * 40).alias("ts_sec"), F.when(client, "client").otherwise("server").alias("src"), F.octet_length("text").cast("bigint").alias("frame_len"), F.when(client, 2).otherwise(F.when(F.col("turn") > 4, 17).otherwise(16)).cast("bigint").alias("tcp_flags"), F.col("text").cast("binary").alias("payload"))


MESSAGES = "m AS (SELECT conv_id AS flow, turn AS seq, turn * 40 AS ts_sec, CASE WHEN role IN ('user', 'system') THEN 'client' ELSE 'server' END AS src, octet_length(encode(text)) AS frame_len, CASE WHEN role IN ('user', 'system') THEN 2 WHEN turn > 4 THEN 17 ELSE 16 END AS tcp_flags, text FROM conversations)"


@query(f"""WITH {MESSAGES} SELECT flow, 'client' AS client, CAST(min(ts_sec) AS BIGINT) AS start_sec, CAST(max(ts_sec) AS BIGINT) AS end_sec, count(*) FILTER (WHERE src = 'client') AS pkts_to_server, count(*) FILTER (WHERE src = 'server') AS pkts_to_client,
    CAST(coalesce(sum(frame_len) FILTER (WHERE src = 'client'), 0) AS BIGINT) AS bytes_to_server, CAST(coalesce(sum(frame_len) FILTER (WHERE src = 'server'), 0) AS BIGINT) AS bytes_to_client,
    CAST(coalesce(bit_or(tcp_flags) FILTER (WHERE src = 'client'), 0) AS BIGINT) AS flags_to_server, CAST(coalesce(bit_or(tcp_flags) FILTER (WHERE src = 'server'), 0) AS BIGINT) AS flags_to_client,
    CASE WHEN bool_or(tcp_flags = 17) THEN 'half_closed' ELSE 'open' END AS state FROM m GROUP BY flow""")
def a1_flow_records(spark, sf_dir):
    return flows.flow_records(flows.sessions(messages(spark, sf_dir), ["flow"]), ["flow"]).drop("session")


@query(f"WITH {MESSAGES} SELECT flow, src, sha256(string_agg(text, '' ORDER BY seq)) AS digest FROM m GROUP BY flow, src")
def a12_reassembly(spark, sf_dir):
    from pyspark.sql import Window

    rows = messages(spark, sf_dir)
    before = Window.partitionBy("flow", "src").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("tcp_seq", F.coalesce(F.sum("frame_len").over(before), F.lit(0)))
    return flows.reassemble(rows, ["flow", "src"]).select("flow", "src", F.sha2("stream", 256).alias("digest"))


@query(f"WITH {OBS}, f AS (SELECT *, CASE WHEN ts_sec - lag(ts_sec) OVER (PARTITION BY src, dst_port ORDER BY ts_sec, seq) >= {DAY} THEN 1 ELSE 0 END AS fresh FROM obs), s AS (SELECT *, sum(fresh) OVER (PARTITION BY src, dst_port ORDER BY ts_sec, seq ROWS UNBOUNDED PRECEDING) AS session FROM f) SELECT src, dst_port, min(ts_sec) AS start_sec, count(*) AS packets, CAST(sum(bytes_out) AS BIGINT) AS bytes FROM s GROUP BY src, dst_port, session")
def w11_datagram_sessions(spark, sf_dir):
    rows = windows.idle_sessions(observations(spark, sf_dir), ["src", "dst_port"], DAY)
    return rows.groupBy("src", "dst_port", "session").agg(F.min("ts_sec").alias("start_sec"), F.count("*").alias("packets"), F.sum("bytes_out").alias("bytes")).drop("session")


@query(f"WITH RECURSIVE {OBS}, {anchored('obs', 'src', 5 * DAY)}, b AS (SELECT DISTINCT src, a // 100000000000 AS anchor FROM anchors WHERE a IS NOT NULL), p AS (SELECT o.*, (SELECT max(anchor) FROM b WHERE b.src = o.src AND anchor <= o.ts_sec) AS anchor FROM obs o) SELECT src, CAST(anchor AS BIGINT) AS anchor_sec, CAST(sum(bytes_out) AS BIGINT) AS bytes, count(*) AS packets FROM p GROUP BY src, anchor")
def w12_interim_reports(spark, sf_dir):
    return flows.interim_reports(observations(spark, sf_dir).withColumn("frame_len", F.col("bytes_out")), ["src"], 5 * DAY)


@query(f"WITH {OBS} SELECT coalesce(dst_port, 'all') AS category, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes FROM obs GROUP BY ROLLUP (dst_port)")
def alert_rollup(spark, sf_dir):
    return observations(spark, sf_dir).rollup("dst_port").agg(F.count("*").alias("n"), F.sum("bytes_out").alias("bytes")).select(F.coalesce("dst_port", F.lit("all")).alias("category"), "n", "bytes")


# the whole chain ----------------------------------------------------------------------------------------------------


def _chain(source: str, name: str, span: int) -> str:
    """anchored() over (category, src) under a name of its own."""
    return anchored(source, "category, src", span).replace("anchors AS", f"{name} AS", 1).replace("FROM anchors r", f"FROM {name} r")


_AT = "CAST(ts_sec AS HUGEINT) * 100000000000 + seq"
_PIPELINE = f"""WITH RECURSIVE {OBS}, {RANGE_SQL}, {GAPS}, refused AS (SELECT * FROM obs WHERE dst_port = 'error'),
    hot AS (SELECT 'BRUTE_FORCE' AS category, 'high' AS severity, src, ts_sec, seq FROM refused o WHERE {sliding("count(*)", "src", 3 * DAY).replace("FROM obs p", "FROM refused p")} > 2
        UNION ALL SELECT 'DATA_EXFIL_VOLUME', 'medium', src, ts_sec, seq FROM obs o WHERE {sliding("sum(bytes_out)", "src", 3 * DAY)} > 60000
        UNION ALL SELECT 'HORIZONTAL_SCAN', 'high', src, ts_sec, seq FROM refused o WHERE {sliding("count(DISTINCT dst)", "src, dst_port", 7 * DAY).replace("FROM obs p", "FROM refused p")} > 3
        UNION ALL SELECT 'BEACONING', 'medium', src, ts_sec, ts_sec FROM rings WHERE n_gaps >= 6 AND dev / gap_mean <= 0.5 AND gap_mean >= 5),
    {_chain("hot", "a1", DAY)}, passed AS (SELECT hot.* FROM hot JOIN (SELECT DISTINCT category, src, a FROM a1) USING (category, src) WHERE {_AT} = a),
    {_chain("passed", "a2", 10 * DAY)}, placed AS (SELECT p.*, (SELECT max(a) FROM a2 WHERE a2.category = p.category AND a2.src = p.src AND a <= {_AT}) AS win FROM passed p),
    limited AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY category, src, win ORDER BY ts_sec, seq) AS n FROM placed) WHERE n <= 3),
    allowed AS (SELECT category, severity, src, ts_sec, seq FROM limited WHERE NOT (category = 'BEACONING' AND src = 2)),
    {_chain("allowed", "a3", DAY)}, held AS (SELECT p.*, (SELECT max(a) FROM a3 WHERE a3.category = p.category AND a3.src = p.src AND a <= {_AT}) AS win FROM allowed p),
    firsts AS (SELECT *, coalesce(lag(more) OVER (PARTITION BY category, src ORDER BY ts_sec, seq), 0) AS suppressed FROM (SELECT *, count(*) OVER (PARTITION BY category, src, win) - 1 AS more, {_AT} = win AS is_first FROM held) WHERE is_first)
    SELECT ts_sec, category, severity, src, (SELECT arg_max(tag, lo) FROM ranges WHERE src BETWEEN lo AND hi) AS src_tag, suppressed FROM firsts"""


@query(_PIPELINE)
def alert_pipeline(spark, sf_dir):
    """Observations through four detectors, their gates, rate control, allowlist, suppression and tags: the flagship.

    Two detectors share a shuffle and a sort, and all four one gate, as their gates have the same key beside the category.
    """
    obs = observations(spark, sf_dir)
    refused = F.col("dst_port") == "error"
    tests = {"BRUTE_FORCE": ("high", F.when(refused, 1), 2, refused), "DATA_EXFIL_VOLUME": ("medium", F.col("bytes_out"), 60_000, F.lit(True))}
    common = ["ts_sec", "seq", "src", "category", "severity"]
    found = [
        detectors.several_counted(obs.select("ts_sec", "seq", "src", "dst_port", "bytes_out"), ["src"], tests, 3 * DAY),
        detectors.horizontal_scan(obs.select("ts_sec", "seq", "src", "dst", "dst_port", "answered"), width=7 * DAY, limit=3, gate=None), detectors.beaconing(obs, ["src"], cv=0.5, gate=None, idle=None),
    ]
    alerts = found[0].select(*common)
    for f in found[1:]:
        alerts = alerts.unionByName(f.select(*common))
    alerts = windows.gate(alerts, ["category", "src"], DAY)
    alerts = alerts.withColumn("sid", F.col("category")).withColumn("dst", F.lit(None).cast("bigint")).withColumn("port", F.lit(None).cast("int"))
    limited = control.threshold(alerts, "limit", "by_src", 3, 10 * DAY)
    allowed = enrich.allow(limited, spark.createDataFrame([("beaconing", 2, None, None)], "category string, src bigint, dst bigint, port int"))
    kept = control.suppress(allowed, ["category", "src"], DAY)
    return enrich.in_ranges(kept, "src", enrich.merge_ranges(feed(spark)), "src_tag").select("ts_sec", "category", "severity", "src", "src_tag", "suppressed")


@query(f"""WITH RECURSIVE {OBS}, marked AS (SELECT *, CASE WHEN ts_sec - lag(ts_sec) OVER (PARTITION BY src ORDER BY ts_sec, seq) >= {5 * DAY} THEN 1 ELSE 0 END AS fresh FROM obs),
    sess AS (SELECT src, ts_sec, sum(fresh) OVER (PARTITION BY src ORDER BY ts_sec, seq ROWS UNBOUNDED PRECEDING) AS session FROM marked), secs AS (SELECT DISTINCT src, session, ts_sec FROM sess),
    lagged AS (SELECT *, ts_sec - lag(ts_sec) OVER (PARTITION BY src, session ORDER BY ts_sec) AS gap FROM secs),
    rings AS (SELECT src, session, ts_sec, count(gap) OVER w AS n_gaps, avg(gap) OVER w AS gap_mean, stddev_pop(gap) OVER w AS dev FROM lagged WINDOW w AS (PARTITION BY src, session ORDER BY ts_sec ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
    hot AS (SELECT src, session, ts_sec, ts_sec AS seq, gap_mean FROM rings WHERE n_gaps >= 6 AND dev / gap_mean <= 0.6 AND gap_mean >= 5), {anchored("hot", "src, session", DAY)}
    SELECT src, ts_sec, round(gap_mean, 3) AS gap_mean FROM hot JOIN (SELECT DISTINCT src, session, a FROM anchors) USING (src, session) WHERE {_AT} = a""")
def d08_beaconing_with_idle(spark, sf_dir):
    """Gaps and gates that start anew after idleness."""
    return detectors.beaconing(observations(spark, sf_dir), ["src"], cv=0.6, gate=DAY, idle=5 * DAY).select("src", "ts_sec", F.round("measure", 3).alias("gap_mean"))


@query("SELECT o_orderkey AS flow_id FROM orders WHERE o_custkey % 5 <> 0 AND (o_orderkey % 4 = 0 AND o_orderpriority <> '1-URGENT' OR o_orderkey % 4 = 1 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderkey % 4 = 2 AND o_orderpriority <> '3-MEDIUM')")
def d13_protocol_mismatch_of_parsed_flows(spark, sf_dir):
    """Flows of which some spoke the protocol of their port."""
    o = table(spark, sf_dir, "orders")
    port, said = F.element_at(F.array(F.lit(8080), F.lit(8443), F.lit(22), F.lit(9999)), (F.col("o_orderkey") % 4 + 1).cast("int")), F.col("o_orderpriority")
    rows = o.select(F.col("o_orderkey").alias("flow_id"), port.alias("dst_port"), F.when(F.col("o_custkey") % 5 == 0, 255).otherwise(256).alias("client_bytes"), F.lit(True).alias("syn_seen"), F.when(said == "1-URGENT", "/").alias("http_uri"), F.when(said == "1-URGENT", "h").alias("tls_sni"), F.when(said == "2-HIGH", "j").alias("tls_ja3"), F.when(said == "3-MEDIUM", "SSH-2").alias("ssh_version"))
    return detectors.protocol_mismatch(rows).select("flow_id")
