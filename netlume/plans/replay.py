"""A capture from end to end: frames, packets, flows, observations, alerts.

Every step is one of the library's operators; this module only says in which order, with the usual order of stages:
detectors and signatures are raised, the allowlist drops, suppression thins, feeds tag.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netlume.functions import scalars
from netlume.operators import auth, control, detectors, enrich, flows, observe
from netlume.parse.registry import BUFFERS, parsed, rule_buffers
from netlume.rules import state
from netlume.rules.matcher import needed_buffers
from netlume.rules.parser import Rule
from netlume.sources import capture
from netlume.sources.packet_filter import packet_filter

#: Alerts of all producers have these columns.
ALERT = ("ts_sec", "seq", "severity", "category", "src", "dst", "proto", "port", "sid", "message")
TCP, UDP = 6, 17


@dataclass
class Settings:
    """What a replay reads beside the capture; feeds are tables, as the functions of sources.feeds give them."""

    rules: list[Rule] = field(default_factory=list)
    filter: str = ""
    denied: DataFrame | None = None
    indicators: DataFrame | None = None
    allowed: DataFrame | None = None
    home: list[tuple[bytes, bytes]] = field(default_factory=list)
    #: Changed values of detectors, by name: see detectors.DEFAULTS.
    detectors: dict[str, dict] = field(default_factory=dict)
    suppress: int = 15
    #: Folder that all executors share, for packets, sessions and streams; all producers of alerts then read those tables.
    #: Without one, spark.checkpoint.dir is taken; without that too, each producer decodes the capture for itself.
    work: str = ""


def settled(df: DataFrame, name: str, settings: Settings) -> DataFrame:
    """The rows as a table in the work folder, if there is one; the caller owns the folder."""
    spark = df.sparkSession
    top = settings.work or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        return df
    path = f"{top.rstrip('/')}/replay-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packets(frames: DataFrame, filter_: str = "") -> DataFrame:
    """Decoded packets in a total order (ts_sec, seq), fragments put together, those that the filter leaves."""
    whole = capture.whole_packets(capture.decode_frames(frames, ["frame_no"]), ["frame_no"])
    found = whole.filter(packet_filter(filter_))
    return found.withColumn("ts_sec", F.floor(F.col("ts_us") / 1_000_000).cast("bigint")).withColumn("seq", F.col("ts_us") * 4096 + F.col("frame_no") % 4096)


def tcp_packets(found: DataFrame) -> DataFrame:
    """TCP packets with their ends in order (lo, hi), session, direction and payload size."""
    a, b = F.concat_ws(" ", "src", "src_port"), F.concat_ws(" ", "dst", "dst_port")
    rows = found.filter(F.col("protocol") == TCP).withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b), "payload_len": F.octet_length("payload")})
    return flows.tcp_sessions(rows, ["lo", "hi"]).filter("session IS NOT NULL").withColumn("direction", F.when(F.col("is_client"), "to_server").otherwise("to_client"))


FLOW = ["lo", "hi", "session"]


def streams(tcp: DataFrame) -> DataFrame:
    """Each direction's bytes, with the connection's ends, client first, and the second of the direction's first byte."""
    data = tcp.filter("payload_len > 0")
    client = lambda c, s: F.when(F.col("is_client"), F.col(c)).otherwise(F.col(s))
    ends = data.groupBy(*FLOW, "direction").agg(
        F.min("ts_sec").alias("ts_sec"), F.min("seq").alias("seq"), F.first(client("src", "dst")).alias("src"), F.first(client("dst", "src")).alias("dst"),
        F.first(client("src_port", "dst_port")).alias("src_port"), F.first(client("dst_port", "src_port")).alias("dst_port"),
    )
    keys = [*FLOW, "direction"]
    return flows.reassemble(data, keys).join(ends, keys)


def signatures(found: DataFrame, joined: DataFrame, rules: list[Rule]) -> DataFrame:
    """Alerts of rules over streams, once for a flow and direction, and over datagrams."""
    if not rules:
        return joined.select(*[F.lit(None).cast(k).alias(c) for c, k in _KINDS.items()]).limit(0)
    names = needed_buffers(rules)
    known = [n for n in names if n in BUFFERS]
    ends = ["ts_sec", "seq", "src", "dst", "src_port", "dst_port"]

    def with_buffers(base: DataFrame, keys: list[str]) -> DataFrame:
        raw = base.select(*keys, *ends, "direction", "proto", "marks", "stateful", F.lit("payload").alias("buffer"), F.col("stream").alias("data"))
        if not known:
            return raw
        made = rule_buffers(base, known, [*keys, *ends, "proto", "stateful"]).withColumn("marks", F.lit(None).cast("array<string>"))
        return raw.unionByName(made.select(*raw.columns))

    tcp = joined.withColumns({"proto": F.lit("tcp"), "marks": parsed("app_marks", F.col("stream")), "stateful": F.lit(True)})
    tcp_alerts = state.alerts(with_buffers(tcp, FLOW), rules, FLOW, once=True)
    datagrams = found.filter((F.col("protocol") == UDP) & (F.octet_length("payload") > 0)).select(F.col("seq").alias("flow"), *ends, F.lit(None).cast("string").alias("direction"), F.lit("udp").alias("proto"), F.lit(None).cast("array<string>").alias("marks"), F.lit(False).alias("stateful"), F.col("payload").alias("stream"))
    udp_alerts = state.alerts(with_buffers(datagrams, ["flow"]), rules, ["flow"], packets=True)
    line = lambda df, proto: _as_alerts(df, "SIGNATURE_MATCH", F.col("name"), proto, sid=F.col("sid"))
    return line(tcp_alerts, "tcp").unionByName(line(udp_alerts, "udp"))


_KINDS = {"ts_sec": "bigint", "seq": "bigint", "severity": "string", "category": "string", "src": "string", "dst": "string", "proto": "string", "port": "int", "sid": "bigint", "message": "string"}


def _as_alerts(df: DataFrame, category: str | None, message: Column, proto: str | None = None, sid: Column | None = None) -> DataFrame:
    """ALERT columns; what the rows lack is null."""
    have = set(df.columns)
    col = lambda c, *others: next((F.col(x) for x in (c, *others) if x in have), F.lit(None))
    made = {
        "ts_sec": col("ts_sec"), "seq": F.coalesce(col("seq"), col("ts_sec")), "severity": col("severity"), "category": F.lit(category) if category else col("category"), "src": col("src"), "dst": col("dst"),
        "proto": F.lit(proto) if proto else col("proto"), "port": col("dst_port"), "sid": sid if sid is not None else F.lit(0), "message": message,
    }
    return df.select(*[v.cast(_KINDS[k]).alias(k) for k, v in made.items()])


def observations(found: DataFrame, tcp: DataFrame) -> DataFrame:
    """Flows as observations: one a session, by its client."""
    log = flows.tcp_flow_log(tcp.select(*FLOW, "is_client", "src", "src_port", "dst", "dst_port", "ts_sec", "seq", "frame_len", "tcp_flags", "payload_len"), ["lo", "hi"])
    return log.select(F.lit("flow").alias("kind"), F.col("start_sec").alias("ts_sec"), F.xxhash64("src", "src_port", "dst", "dst_port", "start_sec").alias("seq"), "src", "dst", "dst_port", F.col("bytes_to_server").alias("bytes_out"), F.col("bytes_to_client").alias("bytes_in"), (F.col("pkts_to_client") > 0).alias("answered"))


def raised(found: DataFrame, tcp: DataFrame, joined: DataFrame, settings: Settings) -> DataFrame:
    """Alerts of all detectors and rules, before the allowlist."""
    given = lambda name: settings.detectors.get(name, {})
    seen = observations(found, tcp)
    tries = flows.is_attempt(found.filter(F.col("protocol").isin(TCP, UDP)), extra=("protocol",))
    segments = tcp.filter("payload_len > 0").select("ts_sec", "seq", "src", "dst", "src_port", "dst_port", "direction", "payload")
    logins = auth.logins(segments, ["ts_sec", "seq"])
    names = found.filter((F.col("protocol") == UDP) & ((F.col("dst_port") == 53) | (F.col("src_port") == 53))).withColumn("name", parsed("dns_question", F.col("payload"))).filter("name IS NOT NULL").select("ts_sec", "seq", "src", "dst", "dst_port", "name")
    spoken = joined.groupBy(*FLOW).agg(
        F.min("ts_sec").alias("ts_sec"), F.min("seq").alias("seq"), F.first("src").alias("src"), F.first("dst").alias("dst"), F.first("dst_port").alias("dst_port"), F.coalesce(F.sum(F.when(F.col("direction") == "to_server", F.octet_length("stream"))), F.lit(0)).alias("client_bytes"),
        *[F.max(F.when(F.col("direction") == "to_server", x)).alias(c) for c, x in (("http_uri", parsed("http_request", F.col("stream"))["uri"]), ("tls_sni", parsed("client_hello", F.col("stream"))["sni"]), ("tls_ja3", parsed("client_hello", F.col("stream"))["ja3"]), ("ssh_version", parsed("ssh_version", F.col("stream"))))],
    )
    syn = tcp.filter(F.col("is_client") & (F.col("tcp_flags").bitwiseAND(F.lit(flows.SYN)) != 0)).select(*FLOW).distinct().withColumn("syn_seen", F.lit(True))
    parts = [
        detectors.port_scan(tries.select("ts_sec", "seq", "src", "dst", "dst_port", "protocol", "attempt"), **given("port_scan")), detectors.packet_flood(found.select("src", "ts_sec", F.lit(1).alias("packets")), **given("flood")),
        detectors.horizontal_scan(seen, **given("horizontal_scan")), detectors.host_sweep(seen, **given("host_sweep")), detectors.beaconing(seen, ["src", "dst", "dst_port"], **given("beaconing")),
        detectors.exfiltration_volume(seen, **given("volume")), detectors.exfiltration_ratio(seen, **given("ratio")), detectors.brute_force(logins.filter("kind = 'attempt'"), False, **given("attempts")), detectors.brute_force(logins.filter("kind = 'refusal'"), True, **given("refusals")),
        detectors.dns_tunnel(names, **given("dns_tunnel")), detectors.dns_long_name(names, **given("dns_long_name")), detectors.protocol_mismatch(spoken.join(syn, FLOW)),
    ]
    if settings.denied is not None:
        parts.append(detectors.deny_list(found.select("ts_sec", "seq", "src", "dst", "dst_port"), settings.denied))
    found_alerts = [_as_alerts(p, None, F.concat_ws(" ", "category", F.col("measure").cast("string"))) for p in parts]
    if settings.indicators is not None:
        found_alerts.append(_intel(seen, names, spoken, settings.indicators))
    return observe.union(*found_alerts, signatures(found, joined, settings.rules))


def _intel(seen: DataFrame, names: DataFrame, spoken: DataFrame, indicators: DataFrame) -> DataFrame:
    """One alert for each pair of ends of which an address, a name or a fingerprint is listed."""
    feed = indicators.filter("kind = 'ip'").select("first", "last", "tag")
    domains = indicators.filter("kind = 'domain'").select(F.col("value").alias("domain"), "tag")
    prints = indicators.filter("kind = 'ja3'").select("value", "tag")
    rows = observe.union(seen.select("ts_sec", "seq", "src", "dst", "dst_port"), names, spoken.select("ts_sec", "seq", "src", "dst", "dst_port", F.col("tls_sni").alias("name"), F.col("tls_ja3").alias("ja3")))
    tagged = enrich.fingerprint_tags(enrich.domain_tags(rows, "name", domains, "_name"), "ja3", prints, "_ja3")
    tagged = enrich.in_networks(enrich.in_networks(tagged, "dst", feed, "_dst"), "src", feed, "_src")
    hot = tagged.withColumn("tag", F.coalesce("_name", "_ja3", "_dst", "_src")).filter("tag IS NOT NULL")
    first = hot.groupBy("src", "dst").agg(F.min_by(F.struct("ts_sec", "seq", "dst_port", "tag"), F.struct("ts_sec", "seq")).alias("f")).select("src", "dst", "f.*").withColumn("severity", F.lit("high"))
    return _as_alerts(first, "THREAT_INTEL", F.concat_ws(" ", F.lit("listed"), "tag"))


def passed(alerts: DataFrame, settings: Settings) -> DataFrame:
    """Alerts after the allowlist and suppression, with direction and tags where home networks and feeds are given."""
    kept = enrich.allow(alerts, settings.allowed) if settings.allowed is not None else alerts
    flood = F.col("category") == "PACKET_FLOOD"
    keyed = kept.withColumns({"_dst": F.when(~flood, F.col("dst")), "_message": F.when(F.col("category") == "SIGNATURE_MATCH", F.col("message"))})
    out = control.suppress(keyed, ["category", "src", "_dst", "proto", "_message"], settings.suppress).drop("_dst", "_message")
    if settings.home:
        inside = lambda c: reduce(lambda x, y: x | y, [(F.octet_length(c) == len(a)) & c.between(F.lit(a), F.lit(b)) for a, b in settings.home])
        ends = out.withColumns({"_s": scalars.address_bytes(F.col("src")), "_d": scalars.address_bytes(F.col("dst"))})
        out = ends.withColumn("direction", enrich.direction(F.coalesce(inside(F.col("_s")), F.lit(False)), F.coalesce(inside(F.col("_d")), F.lit(False)))).drop("_s", "_d")
    if settings.indicators is not None:
        feed = settings.indicators.filter("kind = 'ip'").select("first", "last", "tag")
        out = enrich.in_networks(enrich.in_networks(out, "src", feed, "src_tag"), "dst", feed, "dst_tag")
    return out


def replay(spark: SparkSession, path: str, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(alerts, flow records) of the captures under a path."""
    return replay_frames(capture.read_pcap(spark, path), settings or Settings())


def replay_frames(frames: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    found = settled(packets(frames, settings.filter), "packets", settings)
    tcp = settled(tcp_packets(found), "sessions", settings)
    joined = settled(streams(tcp), "streams", settings)
    last = found.agg(F.max("ts_sec").alias("until"))
    log = flows.tcp_flow_log(tcp, ["lo", "hi"]).crossJoin(F.broadcast(last))  # one row
    over = F.col("until") - F.col("end_sec") >= F.when(F.col("pkts_to_client") > 0, flows.IDLE).otherwise(flows.UNANSWERED)
    records = log.withColumn("state", F.when((F.col("state") == "open") & over, "timeout").otherwise(F.col("state"))).withColumn("proto", F.lit("TCP")).drop("until", "session")
    return passed(raised(found, tcp, joined, settings), settings), records
