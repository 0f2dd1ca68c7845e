"""Feeds: deny lists, reputation indicators, allowlists, home networks and configuration text."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import DataFrame, SparkSession, functions as F


def deny_list(spark: SparkSession, path: str) -> DataFrame:
    """One address a line; # begins a comment."""
    return deny_list_of(spark.read.text(path))


def deny_list_of(lines: DataFrame) -> DataFrame:
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return lines.select(line.alias("address")).filter("address <> ''").distinct()


def indicator(line: str) -> tuple[str, str, str] | None:
    """(kind, value, tag) of a line; the kind is given by a prefix or told from the shape."""
    body, *tag = re.split(r"[#;]", line, maxsplit=1)
    body = body.strip()
    if not body:
        return None
    label = tag[0].strip() if tag else ""
    kind, _, rest = body.partition(":")
    if kind in ("ip", "domain", "ja3"):
        return kind, rest.strip().lower(), label
    try:
        ipaddress.ip_network(body, strict=False)
        return "ip", body, label
    except ValueError:
        return ("ja3" if re.fullmatch(r"[0-9a-fA-F]{32}", body) else "domain"), body.lower(), label


def bounds(network: str) -> tuple[bytes, bytes] | None:
    """First and last address of a network of either family, as 4 or 16 bytes; None if it is not one."""
    try:
        net = ipaddress.ip_network(network.strip(), strict=False)
    except ValueError:
        return None
    return net[0].packed, net[-1].packed


def reputation(spark: SparkSession, path: str) -> DataFrame:
    """The indicators of a feed; no feed is an empty one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return reputation_of(spark.createDataFrame([], "value string"))
    return reputation_of(spark.read.text(path))


def reputation_of(lines: DataFrame) -> DataFrame:
    """kind, value, tag, lo and hi of IPv4 networks as numbers, first and last of networks of both families, and error.

    A line that cannot be used has kind `bad` and says why; it never stops the feed.
    """

    def parse(value: str):
        found = indicator(value)
        if found is None:
            return None
        if found[0] != "ip":
            return (*found, None, None, None, None, None)
        ends = bounds(found[1])
        if ends is None:
            return ("bad", found[1], found[2], None, None, None, None, "not an address or network")
        lo, hi = (int.from_bytes(x, "big") if len(x) == 4 else None for x in ends)
        return (*found, lo, hi, *ends, None)

    one = F.udf(parse, "kind string, value string, tag string, lo bigint, hi bigint, first binary, last binary, error string")
    return lines.select(one("value").alias("x")).filter("x IS NOT NULL").select("x.*")


def allow_entry(line: str) -> dict[str, str | int] | None:
    """category, src, dst and port of `key:value` tokens; at least one, else None; ValueError names a token that is wrong."""
    given = {}
    for token in line.split("#", 1)[0].split():
        key, colon, value = token.partition(":")
        if not colon or key not in ("category", "src", "dst", "port") or not value:
            raise ValueError(f"not an entry: {token}")
        if key == "port" and not (value.isascii() and value.isdigit() and int(value) < 65_536):
            raise ValueError(f"not a port: {value}")
        if key in ("src", "dst") and bounds(value) is None:
            raise ValueError(f"not an address: {value}")
        given[key] = int(value) if key == "port" else value
    return given or None


def allowlist(text: str) -> tuple[list[dict[str, str | int]], list[tuple[int, str]]]:
    """Entries of a list, and (line, error) of those that cannot be used."""
    entries, errors = [], []
    for n, line in enumerate(text.splitlines(), 1):
        try:
            if (found := allow_entry(line)) is not None:
                entries.append(found)
        except ValueError as e:
            errors.append((n, str(e)))
    return entries, errors


def home_ranges(spec: str) -> list[tuple[bytes, bytes]]:
    """First and last address of comma-separated networks of both families."""
    found = [(x.strip(), bounds(x)) for x in spec.split(",") if x.strip()]
    if bad := [x for x, ends in found if ends is None]:
        raise ValueError(f"not a network: {bad[0]}")
    return [ends for _, ends in found if ends]


def home_networks(spec: str) -> list[tuple[int, int]]:
    """IPv4 ranges of comma-separated networks, as numbers."""
    return [(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in home_ranges(spec) if len(a) == 4]


def config_entries(text: str) -> list[tuple[str, str]]:
    """key = value lines in order; keys may repeat; # begins a comment."""
    out = []
    for line in text.splitlines():
        key, eq, value = line.split("#", 1)[0].partition("=")
        if eq:
            out.append((key.strip(), value.strip().strip('"')))
    return out


def duration(text: str) -> int:
    """Seconds of 10, 10s, 5m, 2h or 1d."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd]?)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text}")
    return int(m[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86_400}[m[2]]


def size(text: str) -> int:
    """Bytes of 100, 100K, 100M or 1G."""
    m = re.fullmatch(r"\s*(\d+)\s*([kKmMgG]?)[bB]?\s*", text)
    if not m:
        raise ValueError(f"not a size: {text}")
    return int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2].upper()]
