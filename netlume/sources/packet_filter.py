"""Packet filters in the usual text form, as a condition on decoded packets.

    expression = term {("and" | "or") term}      "or" binds as tight as "and": both go from left to right
    term       = "not" term | "(" expression ")" | primitive
    primitive  = [proto] [src | dst] (host ADDRESS | net NETWORK | port N | portrange N-M) | proto | vlan [ID] | less N | greater N

What is left out (byte expressions, link addresses) is refused, never ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from netlume.functions import scalars

from .feeds import bounds

PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1, "icmp6": 58, "esp": 50, "ah": 51, "gre": 47}


class FilterError(ValueError):
    """A filter that cannot be used, and why."""


class _Reader:
    def __init__(self, text: str):
        self.words = re.findall(r"[()!]|[^\s()!]+|&&|\|\|", text)
        self.at = 0

    def peek(self) -> str:
        return self.words[self.at] if self.at < len(self.words) else ""

    def take(self) -> str:
        word = self.peek()
        if not word:
            raise FilterError("the filter ends too early")
        self.at += 1
        return word

    def expression(self) -> Column:
        left = self.term()
        while self.peek() in ("and", "or", "&&", "||"):
            both = self.take() in ("and", "&&")
            right = self.term()
            left = left & right if both else left | right
        return left

    def term(self) -> Column:
        if self.peek() in ("not", "!"):
            self.take()
            return ~self.term()
        if self.peek() == "(":
            self.take()
            inside = self.expression()
            if self.take() != ")":
                raise FilterError("a bracket is not closed")
            return inside
        return self.primitive()

    def number(self, text: str, most: int = 65_535) -> int:
        if not (text.isascii() and text.isdigit() and int(text) <= most):
            raise FilterError(f"not a number: {text}")
        return int(text)

    def primitive(self) -> Column:
        word = self.take()
        proto = F.lit(True)
        if word in PROTOCOLS or word in ("ip", "ip6"):
            proto = F.col("ip_version") == (4 if word == "ip" else 6) if word in ("ip", "ip6") else F.col("protocol") == PROTOCOLS[word]
            if self.peek() not in ("src", "dst", "host", "net", "port", "portrange"):
                return F.coalesce(proto, F.lit(False))
            word = self.take()
        ends = ["src", "dst"]
        if word in ends:
            ends, word = [word], self.take() if self.peek() in ("host", "net", "port", "portrange") else "host"
        if word == "vlan":
            tag = F.col("vlan_id")
            return F.coalesce(tag == self.number(self.take(), 4095) if self.peek().isdigit() else tag.isNotNull(), F.lit(False))
        if word in ("less", "greater"):
            n = self.number(self.take(), 1 << 30)
            return F.coalesce(F.col("frame_len") <= n if word == "less" else F.col("frame_len") >= n, F.lit(False))
        if word in ("host", "net"):
            text = self.take()
            if (range_ := bounds(text)) is None or (word == "host" and "/" in text):
                raise FilterError(f"not an address: {text}")
            test = [scalars.address_bytes(F.col(e)).between(F.lit(range_[0]), F.lit(range_[1])) & (F.octet_length(scalars.address_bytes(F.col(e))) == len(range_[0])) for e in ends]
        elif word in ("port", "portrange"):
            low, dash, high = self.take().partition("-")
            if bool(dash) != (word == "portrange"):
                raise FilterError("a port is one number, a portrange two")
            a, b = self.number(low), self.number(high or low)
            proto = proto & F.col("protocol").isin(6, 17) & ~F.coalesce(F.col("is_fragment"), F.lit(False))
            test = [F.col(f"{e}_port").between(a, b) for e in ends]
        else:
            raise FilterError(f"unknown word: {word}")
        some = test[0] if len(test) == 1 else F.coalesce(test[0], F.lit(False)) | F.coalesce(test[1], F.lit(False))
        return F.coalesce(proto & some, F.lit(False))


def packet_filter(text: str) -> Column:
    """The condition of a filter; an empty one holds for all packets."""
    reader = _Reader(text)
    if not reader.words:
        return F.lit(True)
    found = reader.expression()
    if reader.peek():
        raise FilterError(f"unexpected: {reader.peek()}")
    return found
