"""Scalar functions as columns, JVM-side but for IPv6 text."""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def ipv4_number(address: Column) -> Column:
    """A dotted address as a number, or null."""
    octets = F.transform(F.split(address, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("bigint"))
    ok = address.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$")
    return F.when(ok, F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x))


def ipv4_text(number: Column) -> Column:
    part = lambda k: F.shiftright(number, 8 * k).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", part(3), part(2), part(1), part(0))


def percent_decoded(text: Column) -> Column:
    """Each %HH becomes its character (ISO-8859-1); bad escapes stay."""
    parts = F.split(text, "%")
    one = lambda p: F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.decode(F.unhex(F.substring(p, 1, 2)), "ISO-8859-1"), F.substring(p, 3, 1 << 30))).otherwise(F.concat(F.lit("%"), p))
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)
    return F.concat(parts[0], F.array_join(rest, ""))


def read_uint(data: Column, at: int, n: int, little: bool = False) -> Column:
    """An unsigned number of n bytes at a place of binary data, or null beyond its end."""
    digits = F.hex(F.substring(data, at + 1, n))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n))])
    return F.when(F.octet_length(data) >= at + n, F.conv(digits, 16, 10).cast("decimal(20,0)").cast("bigint") if n < 8 else F.conv(digits, 16, 10).cast("decimal(20,0)"))


def is_group_address(number: Column) -> Column:
    """Multicast, the broadcast address, and the last address of private /24s."""
    top = F.shiftright(number, 24)
    private = (top == 10) | (F.shiftright(number, 20) == (172 * 16 + 1)) | (F.shiftright(number, 16) == 192 * 256 + 168)
    return (top.between(224, 239)) | (number == 0xFFFFFFFF) | (private & (number.bitwiseAND(F.lit(255)) == 255))


def packed_address(text: str | None) -> bytes | None:
    try:
        return ipaddress.ip_address(text).packed if text else None
    except ValueError:
        return None


def address_bytes(text: Column) -> Column:
    """4 or 16 bytes of an address in text, or null.  IPv4 stays in the JVM; only text with a colon goes to Python."""
    four = F.unhex(F.lpad(F.hex(ipv4_number(text)), 8, "0"))
    six = F.udf(packed_address, "binary", useArrow=True)(F.when(text.contains(":"), text))
    return F.when(text.contains(":"), six).otherwise(four)


def address_text(data: Column) -> Column:
    """Text of 4 or 16 bytes, IPv6 in its short form."""
    return F.udf(lambda b: str(ipaddress.ip_address(bytes(b))) if b is not None and len(b) in (4, 16) else None, "string", useArrow=True)(data)


def fnv1a_64(data: Column) -> Column:
    """FNV-1a over bytes, as the 16 hexadecimal digits of 64 bits."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for b in column.to_pylist():
            h = 0xCBF29CE484222325
            for c in b or b"":
                h = ((h ^ c) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            out.append(None if b is None else f"{h:016x}")
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(data)


def file_name(text: Column) -> Column:
    """A name that any file system takes: other characters than letters, digits, dot, dash and underscore become one underscore."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), r"^\.+", "_")
