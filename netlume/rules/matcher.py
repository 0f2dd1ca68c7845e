"""Matching of rules with buffers.

A buffer is tested against many rules, but few of its literals occur: one automaton of every part's longest literal
selects the parts worth testing.  It runs once over each buffer in an Arrow UDF, so the cost hardly grows with the
number of rules.  Parts without a literal are tested always.
"""

from __future__ import annotations

import base64
import hashlib
import ipaddress
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from netlume.operators import windows

from .parser import Part, Rule, Term, passes

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_PERCENT = re.compile(rb"%([0-9A-Fa-f]{2})")


def transformed(data: bytes, names: tuple[str, ...]) -> bytes:
    for name in names:
        if name == "percent_decode":
            data = _PERCENT.sub(lambda m: bytes([int(m[1], 16)]), data)
        elif name == "url_decode":
            data = _PERCENT.sub(lambda m: bytes([int(m[1], 16)]), data.replace(b"+", b" "))
        elif name == "header_lowercase":
            data = b"\n".join(h.translate(_LOWER) + c + v for h, c, v in (x.partition(b":") for x in data.split(b"\n")))
        elif name == "strip_whitespace":
            data = re.sub(rb"[ \t\r\n\x0b\x0c]+", b"", data)
        elif name == "compress_whitespace":
            data = re.sub(rb"[ \t\r\n\x0b\x0c]+", b" ", data)
        else:
            data = hashlib.new(name, data).digest()
    return data


def decode_base64(data: bytes) -> bytes:
    """What can be decoded: foreign bytes are skipped, `=` ends it, both alphabets count."""
    kept = bytes(c for c in data.partition(b"=")[0].translate(bytes.maketrans(b"-_", b"+/")) if chr(c).isalnum() or c in b"+/")
    kept = kept[: len(kept) - (len(kept) % 4 == 1)]
    return base64.b64decode(kept + b"=" * (-len(kept) % 4))


def read_number(data: bytes, at: int, n: int, how: tuple[str, ...]) -> tuple[int, int] | None:
    """(value, place after it): bytes of either order, or digits in text."""
    if at < 0:
        return None
    if "string" in how:
        base = 16 if "hex" in how else 8 if "oct" in how else 10
        text = data[at : at + (n or 20)].lower()
        digits = re.match({16: rb"(?:0x)?([0-9a-f]+)", 8: rb"([0-7]+)", 10: rb"([0-9]+)"}[base], text)
        return (int(digits[1], base), at + digits.end()) if digits else None
    if not 1 <= n <= 8 or at + n > len(data):
        return None
    return int.from_bytes(data[at : at + n], "little" if "little" in how else "big"), at + n


#: Seconds that one search for a pattern may take; a pattern that needs longer counts as unable to decide.
SEARCH_SECONDS = 0.5


class GaveUp(Exception):
    """A search that took too long."""


@lru_cache(maxsize=100_000)
def _compiled(text: str, nocase: bool) -> regex.Pattern:
    return regex.compile(text.encode("latin-1"), (regex.IGNORECASE if nocase else 0) | regex.VERSION0)


def _search(t: Term, data: bytes, start: int = 0) -> int | None:
    try:
        m = _compiled(t.value, t.nocase).search(data, start, timeout=SEARCH_SECONDS)
    except TimeoutError:
        raise GaveUp from None
    return m.end() if m else None


COMPARE = {
    "<": int.__lt__, ">": int.__gt__, "=": int.__eq__, "!=": int.__ne__, "<=": int.__le__, ">=": int.__ge__,
    "&": lambda a, b: a & b != 0, "^": lambda a, b: a ^ b != 0,
}


class Reading:
    """One evaluation of a part's terms over a buffer.

    A term matches at its first occurrence in its window and is not moved when a later one fails.
    """

    def __init__(self, data: bytes):
        self.data, self.cursor, self.names = data, 0, {}
        self.moved = False

    def value(self, x: int | str) -> int | None:
        return self.names.get(x) if isinstance(x, str) else x

    def window(self, t: Term) -> tuple[int, int] | None:
        """Where a match may begin and must end."""
        given = {k: self.value(v) for k, v in t.place.items()}
        if None in given.values():
            return None
        start, end = 0, len(self.data)
        if "distance" in given or "within" in given:
            start = max(0, self.cursor + given.get("distance", 0))
            if "within" in given:
                end = min(end, self.cursor + max(given["within"], 0))
        elif given:
            start = max(given.get("offset", 0), 0)
            if "depth" in given:
                end = min(end, start + max(given["depth"], 0))
        return min(start, len(self.data)), end

    def find(self, t: Term) -> int | None:
        """The end of the first match, or None.  A pattern sees only its window, or with `relative` all that is before it too."""
        if t.kind == "pcre" and t.relative:
            return _search(t, self.data, min(self.cursor, len(self.data)))
        if (w := self.window(t)) is None or w[0] > w[1]:
            return None
        start, end = w
        if t.kind == "content":
            data, text = (self.data.translate(_LOWER), t.value.translate(_LOWER)) if t.nocase else (self.data, t.value)
            at = data.find(text, start, end)
            return at + len(text) if at >= 0 else None
        found = _search(t, self.data[start:end])
        return None if found is None else start + found

    def test(self, t: Term) -> bool:
        base = self.cursor if t.relative else 0
        if t.kind in ("content", "pcre"):
            if any(self.value(v) is None for v in t.place.values()):
                return False
            try:
                end = self.find(t)
            except GaveUp:  # neither found nor known to be absent
                return False
            if t.negated:
                return end is None
            if end is None:
                return False
            self.cursor = end
            return True
        if t.kind == "bsize":
            return passes(t.value, len(self.data))
        if t.kind == "isdataat":
            n = self.value(t.value)
            return n is not None and (len(self.data) > base + n) != t.negated
        if t.kind == "base64_decode":
            n, at = t.value
            raw = self.data[base + at :]
            self.data, self.cursor = decode_base64(raw if n is None else raw[:n]), 0
            return bool(self.data)
        n, at = self.value(t.value[0]), None
        if t.kind == "byte_test":
            _, op, against, at, how = t.value
            against, at = self.value(against), self.value(at)
            if None in (n, against, at) or (got := read_number(self.data, base + at, n, how)) is None:
                return False
            return COMPARE[op](got[0], against) != t.negated
        at = self.value(t.value[1])
        how = t.value[-1]
        if n is None or at is None or (got := read_number(self.data, base + at, n, how)) is None:
            return False
        if t.kind == "byte_jump":
            more = dict(x.split(None, 1) for x in how if " " in x)
            step = got[0] * int(more.get("multiplier", 1))
            if "align" in how:
                step += -step % 4
            to = (0 if "from_beginning" in how else got[1]) + step + int(more.get("post_offset", 0))
            if not 0 <= to <= len(self.data):
                return False
            self.cursor = to
            return True
        if t.kind == "byte_extract":
            self.names[t.value[2]] = got[0]
            return True
        op, other = t.value[2], self.value(t.value[3])
        if other is None or (op == "/" and not other) or (op in ("<<", ">>") and other > 63):
            return False
        made = {"+": got[0] + other, "-": got[0] - other, "*": got[0] * other, "/": got[0] // (other or 1), "<<": got[0] << min(other, 64), ">>": got[0] >> min(other, 64)}[op]
        if not 0 <= made < 1 << 64:
            return False
        self.names[t.value[4]] = made
        return True


def part_matches(part: Part, data: bytes) -> bool:
    reading = Reading(data)
    return all(reading.test(t) for t in part.terms)


@lru_cache(maxsize=65_536)
def _address(text: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address:
    return ipaddress.ip_address(text)


def _in_networks(test: tuple[bool, list], address: str | None) -> bool:
    negated, nets = test
    if not nets:
        return not negated
    if address is None:
        return False
    a = _address(address)
    return any(a.version == n.version and a in n for n in nets) != negated


def _in_ports(test: tuple[bool, list], port: int | None) -> bool:
    negated, ranges = test
    return (not ranges or any(lo <= (port or 0) <= hi for lo, hi in ranges)) != negated


FLAG_BITS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32, "C": 128, "E": 64}


def flags_match(test: str, flags: int) -> bool:
    """Exact, at least (+), any (*) or none (!); flags after a comma are ignored."""
    wanted, _, ignored = test.partition(",")
    bits = sum(FLAG_BITS[c] for c in wanted if c in FLAG_BITS)
    flags &= ~sum(FLAG_BITS[c] for c in ignored.strip() if c in FLAG_BITS)
    if "+" in wanted:
        return flags & bits == bits
    if "*" in wanted:
        return flags & bits != 0
    return flags & bits == 0 if "!" in wanted else flags == bits


def header_matches(rule: Rule, h: dict) -> bool:
    """Header tests; addresses and ports are those of the connection's client (src) and server (dst)."""
    for name, test in rule.header.items():
        if name == "proto":
            ok = h.get("proto") == test
        elif name in ("src_ip", "dst_ip"):
            ok = _in_networks(test, h.get(name[:3]))
        elif name in ("src_port", "dst_port"):
            ok = _in_ports(test, h.get(name))
        elif name == "flags":
            ok = h.get("proto") == "tcp" and flags_match(test, h.get("tcp_flags") or 0)
        elif name == "stream_size":
            side, op, n = (x.strip() for x in test.split(","))
            sizes = {"server": [h.get("server_bytes")], "client": [h.get("client_bytes")], "both": [h.get("client_bytes"), h.get("server_bytes")], "either": [h.get("client_bytes"), h.get("server_bytes")]}[side]
            found = [x is not None and COMPARE[op](x, int(n)) for x in sizes]
            ok = any(found) if side == "either" else all(found)
        else:
            value = h.get({"itype": "icmp_type", "icode": "icmp_code", "window": "tcp_window", "ip_proto": "protocol", "dsize": "payload_len"}[name])
            ok = value is not None and passes(test, value)
        if not ok:
            return False
    return True


DIRECTIONS = ("to_server", "to_client")


class RuleSet:
    """Rules by (buffer, transforms), each group with its automaton."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.groups: dict[str, dict[tuple[str, ...], tuple[object, dict, list]]] = defaultdict(dict)
        held: dict[tuple[str, tuple[str, ...]], list[tuple[int, int]]] = defaultdict(list)
        for k, r in enumerate(rules):
            for p, part in enumerate(r.parts):
                held[part.buffer, tuple(part.transforms)].append((k, p))
        for (buffer, names), entries in held.items():
            automaton, always, by_key = ahocorasick.Automaton(), [], defaultdict(list)
            for k, p in entries:
                key = rules[k].parts[p].key()
                (by_key[key.decode("latin-1")] if key else always).append((k, p))
            for key in by_key:
                automaton.add_word(key, key)
            if by_key:
                automaton.make_automaton()
            self.groups[buffer][names] = (automaton if by_key else None, by_key, always)

    def check(self, buffer: str, direction: str | None, data: bytes | None, header: dict | None = None) -> list[tuple[int, int]]:
        """(rule, part) of all that match; null buffers match nothing."""
        if data is None:
            return []
        out = []
        for names, (automaton, by_key, always) in self.groups.get(buffer, {}).items():
            view = transformed(data, names)
            chosen = list(always)
            if automaton is not None:
                text = view.translate(_LOWER).decode("latin-1")
                for key in {key for _, key in automaton.iter(text)}:
                    chosen += by_key[key]
            for k, p in chosen:
                r = self.rules[k]
                if r.direction != "any" and direction in DIRECTIONS and r.direction != direction:
                    continue
                if (header is None or header_matches(r, header)) and part_matches(r.parts[p], view):
                    out.append((k, p))
        return sorted(self.first_old(out, data, direction))

    def first_old(self, hits: list[tuple[int, int]], data: bytes, direction: str | None) -> list[tuple[int, int]]:
        """Of the plain literals of the old form one hit for each direction stays: the one that ends first, the longest of those."""
        old = [(k, p) for k, p in hits if self.rules[k].old and self.rules[k].parts[p].terms[0].kind == "content" and not self.rules[k].parts[p].terms[0].negated]
        if len(old) < 2:
            return hits
        ends = {h: (data.find(x := self.rules[h[0]].parts[0].terms[0].value) + len(x), -len(x), h[0]) for h in old}
        sides = [direction] if direction in DIRECTIONS else DIRECTIONS
        stay = {min((h for h in old if self.rules[h[0]].direction in ("any", side)), key=ends.get, default=None) for side in sides}
        return [h for h in hits if h not in ends or h in stay]


HEADER = ("proto", "src", "dst", "src_port", "dst_port", "tcp_flags", "tcp_window", "icmp_type", "icmp_code", "protocol", "payload_len", "client_bytes", "server_bytes")


_RULE_SETS: dict[str, RuleSet] = {}


def _rule_set(name: str, shared) -> RuleSet:
    """Built once a worker, not once a task."""
    if name not in _RULE_SETS:
        while len(_RULE_SETS) >= 4:
            _RULE_SETS.pop(next(iter(_RULE_SETS)))
        _RULE_SETS[name] = RuleSet(shared.value)
    return _RULE_SETS[name]


def needed_buffers(rules: list[Rule]) -> list[str]:
    """Buffers that any rule reads; others need not be made or moved."""
    return sorted({p.buffer for r in rules for p in r.parts})


_SWAPPED = {"src": "dst", "dst": "src", "src_port": "dst_port", "dst_port": "src_port"}


def match(buffers: DataFrame, rules: list[Rule], keys: list[str], packets: bool = False) -> DataFrame:
    """keys, sid, name, severity, part, parts: hits of (keys, buffer, direction, data) and header columns where given.

    Header columns are those of the connection, client first; with `packets` they are a packet's own and are swapped on
    the way to the client, where a direction is known.  The rule set is broadcast: its size is that of the rule file.
    """
    header = [c for c in HEADER if c in buffers.columns] if any(r.header for r in rules) else []
    kinds = dict(buffers.dtypes)
    shared, name = buffers.sparkSession.sparkContext.broadcast(rules), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule_set = _rule_set(name, shared)
        for b in batches:
            buffer, direction, data = (b.column(len(keys) + k).to_pylist() for k in range(3))
            more = [b.column(len(keys) + 3 + k).to_pylist() for k in range(len(header))]
            at, hits = [], []
            for k in range(b.num_rows):
                swap = packets and direction[k] == "to_client"
                h = {_SWAPPED.get(c, c) if swap else c: more[n][k] for n, c in enumerate(header)} if header else None
                for r, p in rule_set.check(buffer[k], direction[k], data[k], h):
                    at.append(k)
                    hits.append((rule_set.rules[r], p))
            taken = [b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            cols = [
                pa.array([r.sid for r, _ in hits], pa.int64()), pa.array([r.name for r, _ in hits], pa.string()), pa.array([r.severity for r, _ in hits], pa.string()),
                pa.array([p for _, p in hits], pa.int32()), pa.array([len(r.parts) for r, _ in hits], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([*taken, *cols], [*keys, "sid", "name", "severity", "part", "parts"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", sid bigint, name string, severity string, part int, parts int"
    read = buffers.filter(F.col("buffer").isin(needed_buffers(rules)))
    return read.select(*keys, "buffer", "direction", F.col("data").cast("binary").alias("data"), *header).mapInArrow(run, schema)


def complete(hits: DataFrame, flow: list[str], order: Column | None = None) -> DataFrame:
    """flow, sid, name, severity and when: rules all of whose parts matched on a flow, once each."""
    at = order if order is not None else F.lit(0)
    firsts = hits.groupBy(*flow, "sid", "name", "severity", "parts", "part").agg(F.min(at).alias("_at"))
    done = firsts.groupBy(*flow, "sid", "name", "severity", "parts").agg(F.count("*").alias("_n"), F.max("_at").alias("completed"))
    return done.filter(F.col("_n") == F.col("parts")).drop("_n", "parts")


def scan_streams(segments: DataFrame, keys: list[str], literals: list[bytes], seq: str = "seq", payload: str = "payload") -> DataFrame:
    """keys, literal and seq of the segment that completes a literal's first occurrence in its stream.

    Only new bytes are read, and as many before them as the longest literal less one: a stream costs its length once,
    however many segments it comes in, and no stream is held.
    """
    kinds, n, most = dict(segments.dtypes), len(keys), max(map(len, literals)) - 1
    names = {x.decode("latin-1"): x for x in literals}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for name, data in names.items():
            automaton.add_word(name, data)
        automaton.make_automaton()
        last, tail, seen = None, b"", set()
        for b in batches:
            if not b.num_rows:
                continue
            fresh, last = windows.key_changes([b.column(k) for k in range(n)], last)
            at, found = [], []
            for k, (new, data) in enumerate(zip(fresh.tolist(), b.column(n + 1).to_pylist(), strict=True)):
                if new:
                    tail, seen = b"", set()
                text = tail + (data or b"")
                for _, literal in automaton.iter(text.decode("latin-1")):
                    if literal not in seen:
                        seen.add(literal)
                        at.append(k)
                        found.append(literal)
                tail = text[len(text) - most :] if most and len(text) > most else text if most else b""
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(place) for k in range(n)), pa.array(found, pa.binary()), b.column(n).take(place)], [*keys, "literal", seq])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", literal binary, `{seq}` {kinds[seq]}"
    return segments.repartition(*keys).sortWithinPartitions(*keys, seq).select(*keys, seq, F.col(payload).cast("binary")).mapInArrow(run, schema)
