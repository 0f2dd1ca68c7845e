"""Built-in detectors: observations in, alerts out.

Every detector is a sliding value compared with a threshold, and a gate that lets one alert a key pass in a while.
Observations have ts_sec and seq (a total order), src, dst, dst_port, service, bytes_out, bytes_in, answered, name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netlume.functions import scalars

from . import enrich, windows

# The defaults of each detector (seconds, counts, bytes).
DEFAULTS = {
    "port_scan": dict(width=10, limit=20, gate=1), "flood": dict(width=10, limit=5000, gate=10), "horizontal_scan": dict(width=300, limit=25, gate=60), "host_sweep": dict(width=300, limit=200, gate=60),
    "attempts": dict(width=300, limit=15, gate=60), "refusals": dict(width=300, limit=8, gate=60), "beaconing": dict(ring=8, least=6, cv=0.15, mean=5, gate=900, idle=300), "volume": dict(width=300, limit=100 << 20, gate=60),
    "ratio": dict(width=300, limit=5 << 20, ratio=20.0, gate=60), "dns_tunnel": dict(width=300, limit=40, entropy=3.2, least=8, gate=60), "dns_long_name": dict(limit=100, gate=60),
}


def _alerts(df: DataFrame, category: str, severity: str, value: Column) -> DataFrame:
    return df.select("*", F.lit(category).alias("category"), F.lit(severity).alias("severity"), value.alias("measure"))


def _gated(hot: DataFrame, keys: list[str], seconds: int | None) -> DataFrame:
    """No gate leaves all alerts, for callers that gate several detectors at once."""
    return hot if seconds is None else windows.gate(hot, keys, seconds)


def counted(obs: DataFrame, keys: list[str], amount: Column, category: str, severity: str, width: int, limit: int, gate: int | None, gate_keys: list[str] | None = None) -> DataFrame:
    """Alerts where the sum of an amount, a whole number, in the window exceeds the limit."""
    hot = windows.with_rates(obs, keys, {"_m": amount}, width).filter(F.col("_m") > limit)
    return _gated(_alerts(hot, category, severity, F.col("_m")).drop("_m"), gate_keys or keys, gate)


def several_counted(obs: DataFrame, keys: list[str], tests: dict[str, tuple[str, Column, int, Column]], width: int) -> DataFrame:
    """Ungated alerts of several tests (category: severity, amount, limit, rows that may alert) on sums by the same keys and window.

    One shuffle and one sort serve all of them.
    """
    names = {c: f"_m{k}" for k, c in enumerate(tests)}
    rated = windows.with_rates(obs, keys, {names[c]: amount for c, (_, amount, _, _) in tests.items()}, width)
    alert = lambda c, severity, limit, rows: F.when(rows & (F.col(names[c]) > limit), F.struct(F.lit(c).alias("category"), F.lit(severity).alias("severity"), F.col(names[c]).alias("measure")))
    found = F.filter(F.array(*[alert(c, severity, limit, rows) for c, (severity, _, limit, rows) in tests.items()]), lambda x: x.isNotNull())
    return rated.select(*obs.columns, F.explode(found).alias("_a")).select(*obs.columns, "_a.*")


def spread(obs: DataFrame, keys: list[str], value: str, category: str, severity: str, width: int, limit: int, gate: int | None, gate_keys: list[str] | None = None) -> DataFrame:
    """Alerts where the number of different values in the window exceeds the limit; no set of values is gathered."""
    hot = windows.distinct_by_intervals(obs, keys, value, width, name="_m").filter(F.col("_m") > limit)
    return _gated(_alerts(hot, category, severity, F.col("_m")).drop("_m"), gate_keys or keys, gate)


def port_scan(obs: DataFrame, **given) -> DataFrame:
    """Different ports of a host in the window; where there is a column `protocol`, each protocol's are counted apart and share the gate.

    Where there is a column `attempt` (flows.is_attempt), only attempts count.
    """
    rows = obs.filter("attempt") if "attempt" in obs.columns else obs
    if "protocol" in obs.columns:
        return spread(rows, ["src", "dst", "protocol"], "dst_port", "PORT_SCAN", "medium", gate_keys=["src", "dst"], **DEFAULTS["port_scan"] | given)
    return spread(rows, ["src", "dst"], "dst_port", "PORT_SCAN", "medium", **DEFAULTS["port_scan"] | given)


def packet_flood(obs: DataFrame, packets: str = "packets", **given) -> DataFrame:
    """Packets are first summed by source and second, which Spark does in part before the shuffle."""
    per_second = obs.groupBy("src", "ts_sec").agg(F.sum(packets).alias(packets)).withColumn("seq", F.col("ts_sec"))
    return counted(per_second, ["src"], F.col(packets), "PACKET_FLOOD", "high", **DEFAULTS["flood"] | given)


def horizontal_scan(obs: DataFrame, **given) -> DataFrame:
    """The gate is the source's, so ports swept together raise one alert."""
    rows = obs.filter(~F.col("answered"))
    return spread(rows, ["src", "dst_port"], "dst", "HORIZONTAL_SCAN", "high", gate_keys=["src"], **DEFAULTS["horizontal_scan"] | given)


def host_sweep(obs: DataFrame, **given) -> DataFrame:
    return spread(obs.filter(~F.col("answered")), ["src"], "dst", "HOST_SWEEP", "medium", **DEFAULTS["host_sweep"] | given)


def brute_force(obs: DataFrame, refused: bool, keys: list[str] | None = None, **given) -> DataFrame:
    return counted(obs, keys or ["src", "dst", "dst_port"], F.lit(1), "BRUTE_FORCE", "high", **DEFAULTS["refusals" if refused else "attempts"] | given)


def beaconing(obs: DataFrame, keys: list[str], **given) -> DataFrame:
    """Gaps and gate start anew where a key was idle; `idle` None means never.  Text destinations that are groups do not count."""
    p = DEFAULTS["beaconing"] | given
    if "dst" in obs.columns and dict(obs.dtypes)["dst"] == "string":
        obs = obs.filter(F.col("dst").isNull() | ~F.coalesce(to_group(F.col("dst")), F.lit(False)))
    rows, own = obs.select(*keys, "ts_sec", "seq"), list(keys)
    if p["idle"] is not None:
        rows, own = windows.idle_sessions(rows, keys, p["idle"]), [*keys, "session"]
    found = windows.periodicity(rows, own, ring=p["ring"], least=p["least"]).filter((F.col("gap_cv") <= p["cv"]) & (F.col("gap_mean") >= p["mean"]))
    return _gated(_alerts(found.withColumn("seq", F.col("ts_sec")), "BEACONING", "medium", F.col("gap_mean")), own, p["gate"])


def exfiltration_volume(obs: DataFrame, **given) -> DataFrame:
    return counted(obs, ["src"], F.col("bytes_out"), "DATA_EXFIL_VOLUME", "medium", **DEFAULTS["volume"] | given)


def exfiltration_ratio(obs: DataFrame, **given) -> DataFrame:
    p = DEFAULTS["ratio"] | given
    hot = windows.with_rates(obs, ["src"], {"_out": F.col("bytes_out"), "_in": F.col("bytes_in")}, p["width"]).filter((F.col("_out") > p["limit"]) & (F.col("_out") / F.greatest(F.col("_in"), F.lit(1)) > p["ratio"]))
    return _gated(_alerts(hot, "DATA_EXFIL_RATIO", "medium", F.col("_out")).drop("_out", "_in"), ["src"], p["gate"])


def domain_parent(name: Column) -> Column:
    return F.substring_index(name, ".", -2)


def subdomain(name: Column) -> Column:
    labels = F.split(name, r"\.")
    return F.when(F.size(labels) > 2, F.array_join(F.slice(labels, 1, F.size(labels) - 2), "."))


def dns_tunnel(obs: DataFrame, **given) -> DataFrame:
    p = DEFAULTS["dns_tunnel"] | given
    sub = subdomain(F.col("name"))
    rows = obs.withColumn("parent", domain_parent(F.col("name"))).withColumn("sub", sub)
    rows = rows.filter((F.octet_length("sub") >= p["least"]) & (windows.entropy(F.col("sub")) >= p["entropy"]))
    return spread(rows, ["src", "parent"], "sub", "DNS_TUNNEL", "high", p["width"], p["limit"], p["gate"])


def dns_long_name(obs: DataFrame, **given) -> DataFrame:
    p = DEFAULTS["dns_long_name"] | given
    rows = obs.withColumn("parent", domain_parent(F.col("name"))).filter(F.octet_length("name") >= p["limit"])
    return _gated(_alerts(rows, "DNS_LONG_NAME", "low", F.octet_length("name")), ["src", "parent"], p["gate"])


def protocol_mismatch(flows: DataFrame) -> DataFrame:
    """Flows whose client said enough on a well-known port and never spoke its protocol."""
    web = F.col("dst_port").isin(80, 8080, 8000) & F.col("http_uri").isNull()
    tls = F.col("dst_port").isin(443, 8443) & F.col("tls_sni").isNull() & F.col("tls_ja3").isNull()
    ssh = (F.col("dst_port") == 22) & F.col("ssh_version").isNull()
    hot = flows.filter(F.col("syn_seen") & (F.col("client_bytes") >= 256) & (web | tls | ssh))
    return _alerts(hot, "PROTOCOL_ANOMALY", "medium", F.col("client_bytes"))


def deny_list(packets: DataFrame, denied: DataFrame, address: str = "address") -> DataFrame:
    """A listed source gives a high alert, a listed destination a medium one; a packet may give both.

    The list is not hinted: Spark broadcasts it while it is small and shuffles it beyond its threshold.
    """
    one = denied.select(F.col(address).alias("_listed")).distinct()
    side = lambda end, severity: _alerts(packets.join(one, F.col(end) == F.col("_listed"), "left_semi"), "BLACKLIST_IP", severity, F.col(end))
    return side("src", "high").unionByName(side("dst", "medium"))


def threat_intel(observations: DataFrame, ranges: DataFrame, domains: DataFrame, address: str = "dst_number", name: str = "name", source: str | None = None, fingerprints: DataFrame | None = None, fingerprint: str = "ja3") -> DataFrame:
    """One alert for each pair of endpoints of which an address, the name or a fingerprint is listed.

    Of one observation the name tells most, then the fingerprint, the destination, and the source where it is given.
    """
    tagged = enrich.domain_tags(enrich.in_ranges(observations, address, ranges, "_by_address"), name, domains, "_by_name")
    order = ["_by_name", "_by_address"]
    if fingerprints is not None:
        tagged = enrich.fingerprint_tags(tagged, fingerprint, fingerprints, "_by_fingerprint")
        order.insert(1, "_by_fingerprint")
    if source is not None:
        tagged = enrich.in_ranges(tagged, source, ranges, "_by_source")
        order.append("_by_source")
    hot = tagged.withColumn("tag", F.coalesce(*order)).filter(F.col("tag").isNotNull())
    first = hot.groupBy("src", "dst").agg(F.min_by(F.struct("ts_sec", "tag"), F.struct("ts_sec", "seq")).alias("_f"))
    return _alerts(first.select("src", "dst", "_f.ts_sec", "_f.tag"), "THREAT_INTEL", "high", F.col("tag"))


def to_group(address: Column) -> Column:
    """Whether an address in text is multicast or broadcast, of either family."""
    return F.coalesce(scalars.is_group_address(scalars.ipv4_number(address)), F.lower(address).startswith("ff"))
