"""Parser of rule text, old form (name|buffer|direction|type|pattern) and new form (rule sid:...; ...;)."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field

import regex
from pyspark.sql import DataFrame, functions as F

SEVERITIES = ("low", "medium", "high")
DIRECTIONS = {"any": "any", "to_server": "to_server", "to_client": "to_client", "from_client": "to_server", "from_server": "to_client"}
TRANSFORMS = ("percent_decode", "url_decode", "header_lowercase", "strip_whitespace", "compress_whitespace", "sha1", "md5", "sha256")
PARTS, VARIABLES = 15, 8


class RuleError(ValueError):
    """A rule that cannot be used, and why."""


@dataclass
class Term:
    """One step of a part: content, pcre, byte_test, byte_jump, byte_extract, byte_math, isdataat, bsize, base64_decode."""

    kind: str
    negated: bool = False
    value: object = None
    nocase: bool = False
    relative: bool = False
    #: offset, depth, distance, within: a number or a variable's name.
    place: dict[str, int | str] = field(default_factory=dict)


@dataclass
class Part:
    buffer: str
    transforms: list[str] = field(default_factory=list)
    terms: list[Term] = field(default_factory=list)

    def key(self) -> bytes:
        """The longest literal that must occur, ASCII letters lowered: what the prefilter looks for."""
        best = b""
        for t in self.terms:
            if t.kind == "base64_decode":
                break
            if t.kind == "content" and not t.negated and len(t.value) > len(best):
                best = t.value
        return best.lower()


@dataclass
class Rule:
    sid: int
    name: str
    severity: str = "high"
    direction: str = "any"
    parts: list[Part] = field(default_factory=list)
    #: proto, src_ip, dst_ip, src_port, dst_port, flags, itype, icode, window, ip_proto, dsize, stream_size.
    header: dict[str, object] = field(default_factory=dict)
    flowbits: list[tuple[str, str]] = field(default_factory=list)
    xbits: list[tuple[str, str, str, int]] = field(default_factory=list)
    threshold: dict[str, object] | None = None
    noalert: bool = False
    #: Rules of the old form report one hit a buffer at most.
    old: bool = False


def split_options(text: str) -> list[tuple[str, str]]:
    """(name, value) pairs; semicolons inside quotes do not end an option."""
    out, at, quoted, escaped = [], "", False, False
    for c in text:
        if escaped:
            at, escaped = at + c, False
        elif c == "\\" and quoted:
            at, escaped = at + c, True
        elif c == '"':
            at, quoted = at + c, not quoted
        elif c == ";" and not quoted:
            if at.strip():
                name, _, value = at.strip().partition(":")
                out.append((name.strip(), value.strip()))
            at = ""
        else:
            at += c
    if quoted:
        raise RuleError("a quote is not closed")
    if at.strip():
        name, _, value = at.strip().partition(":")
        out.append((name.strip(), value.strip()))
    return out


def unquoted(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] == '"' else text


_ESCAPES = {"n": b"\n", "r": b"\r", "t": b"\t", '"': b'"', "\\": b"\\", "|": b"|", ";": b";", ":": b":"}


def literal(text: str) -> bytes:
    """Bytes of a content pattern: escapes, and hexadecimal between bars."""
    out, k = bytearray(), 0
    text = unquoted(text)
    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text):
            if text[k + 1] not in _ESCAPES:
                raise RuleError(f"unknown escape \\{text[k + 1]}")
            out += _ESCAPES[text[k + 1]]
            k += 2
        elif c == "|":
            end = text.find("|", k + 1)
            if end < 0:
                raise RuleError("a hexadecimal block is not closed")
            try:
                out += bytes.fromhex(text[k + 1 : end].replace(" ", ""))
            except ValueError as e:
                raise RuleError("bad hexadecimal") from e
            k = end + 1
        else:
            out += c.encode()
            k += 1
    if not out:
        raise RuleError("empty content")
    return bytes(out)


def pattern(text: str) -> str:
    """A regular expression in Python's byte semantics; `$` means the true end."""
    body = unquoted(text).replace('\\"', '"')
    out, k, in_class = "", 0, False
    while k < len(body):
        c = body[k]
        if c == "\\" and k + 1 < len(body):
            out += {"\\z": r"\Z", "\\Z": r"(?=\n?\Z)"}.get(body[k : k + 2], body[k : k + 2])
            k += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        out += r"\Z" if c == "$" and not in_class else c
        k += 1
    return out


def compiles(text: str) -> None:
    try:
        regex.compile(text.encode("latin-1"))
    except (regex.error, UnicodeEncodeError) as e:
        raise RuleError(f"bad pattern: {e}") from e


def number(text: str) -> int | str:
    text = text.strip()
    try:
        return int(text, 0)
    except ValueError:
        if re.fullmatch(r"[A-Za-z_][\w.]*", text):
            return text
        raise RuleError(f"not a number or name: {text}") from None


def length_test(text: str) -> tuple[str, int, int]:
    """(operator, a, b) of N, <N, >N, <=N, >=N or A<>B (both ends exclusive)."""
    if m := re.fullmatch(r"\s*(\d+)\s*<>\s*(\d+)\s*", text):
        return "<>", int(m[1]), int(m[2])
    if m := re.fullmatch(r"\s*(<=|>=|<|>|=)?\s*(\d+)\s*", text):
        return m[1] or "=", int(m[2]), 0
    raise RuleError(f"bad length test: {text}")


def passes(test: tuple[str, int, int], n: int) -> bool:
    op, a, b = test
    return {"=": n == a, "<": n < a, ">": n > a, "<=": n <= a, ">=": n >= a, "<>": a < n < b}[op]


def addresses(text: str) -> tuple[bool, list]:
    """(negated, networks); no network means any."""
    text = text.strip()
    negated, body = text.startswith("!"), text.lstrip("!").strip("[] ")
    if body == "any":
        return negated, []
    try:
        return negated, [ipaddress.ip_network(x.strip(), strict=False) for x in body.split(",") if x.strip()]
    except ValueError as e:
        raise RuleError(str(e)) from e


def ports(text: str) -> tuple[bool, list[tuple[int, int]]]:
    text = text.strip()
    negated, body = text.startswith("!"), text.lstrip("!").strip("[] ")
    if body == "any":
        return negated, []
    out = []
    for x in body.split(","):
        low, _, high = x.strip().replace(":", "-").partition("-")
        if not low.isdigit() or (high and not high.isdigit()):
            raise RuleError(f"bad port: {x}")
        out.append((int(low), int(high or low)))
    return negated, out


def _fields(value: str) -> list[str]:
    return [x.strip() for x in value.split(",")]


def _window(value: str) -> dict[str, object]:
    """type, track, count and seconds of rate control."""
    given = dict(x.split(None, 1) for x in _fields(value) if " " in x)
    kind, track = given.get("type", "detection_filter"), given.get("track", "")
    if kind not in ("limit", "threshold", "both", "detection_filter") or track not in ("by_src", "by_dst", "by_both", "by_rule"):
        raise RuleError(f"bad rate control: {value}")
    return {"kind": kind, "track": track, "count": int(given["count"]), "seconds": int(given["seconds"])}


def parse_new(line: str) -> Rule:
    rule = Rule(0, "")
    parts: list[Part] = []

    def part() -> Part:
        if not parts:
            parts.append(Part("payload"))
        return parts[-1]

    def last() -> Term:
        if not parts or not parts[-1].terms:
            raise RuleError("a modifier without a term")
        return parts[-1].terms[-1]

    for name, value in split_options(line.removeprefix("rule").strip()):
        negated = value.startswith("!")
        if name == "sid":
            rule.sid = int(value)
        elif name in ("name", "msg"):
            rule.name = unquoted(value)
        elif name == "severity":
            if value not in SEVERITIES:
                raise RuleError(f"unknown severity {value}")
            rule.severity = value
        elif name in ("direction", "flow"):
            known = [DIRECTIONS[x] for x in _fields(value) if x in DIRECTIONS]
            if not known:
                raise RuleError(f"unknown direction {value}")
            rule.direction = known[-1]
        elif name == "buffer":
            if parts and not parts[-1].terms and not parts[-1].transforms and len(parts) > 1:
                raise RuleError("a buffer without a test")
            parts.append(Part(value))
        elif name in ("content", "!content", "pcre", "pcre_bt"):
            negated = negated or name[0] == "!"
            body = value.removeprefix("!")
            text = literal(body) if "content" in name else pattern(body)
            if "content" not in name:
                compiles(text)
            part().terms.append(Term("content" if "content" in name else "pcre", negated, text))
        elif name == "nocase":
            last().nocase = True
        elif name == "relative":
            last().relative = True
        elif name in ("offset", "depth", "distance", "within"):
            if name in ("distance", "within") and len(part().terms) < 2:
                raise RuleError("the first term has nothing to be relative to")
            last().place[name] = number(value)
        elif name == "transform":
            if part().terms or value not in TRANSFORMS:
                raise RuleError(f"a transform that is unknown or comes too late: {value}")
            part().transforms.append(value)
        elif name == "bsize":
            part().terms.append(Term("bsize", value=length_test(value)))
        elif name == "isdataat":
            more = _fields(value.removeprefix("!"))
            part().terms.append(Term("isdataat", negated, number(more[0]), relative="relative" in more))
        elif name == "byte_test":
            n, op, against, at, *more = _fields(value)
            flip = op.startswith("!") and op != "!="
            part().terms.append(Term("byte_test", flip, (number(n), op.removeprefix("!") if flip else op, number(against), number(at), tuple(more)), relative="relative" in more))
        elif name == "byte_jump":
            n, at, *more = _fields(value)
            part().terms.append(Term("byte_jump", value=(number(n), number(at), tuple(more)), relative="relative" in more))
        elif name == "byte_extract":
            n, at, into, *more = _fields(value)
            part().terms.append(Term("byte_extract", value=(number(n), number(at), into, tuple(more)), relative="relative" in more))
        elif name == "byte_math":
            given = dict(x.split(None, 1) for x in _fields(value) if " " in x)
            more = tuple(x for x in _fields(value) if " " not in x)
            part().terms.append(Term("byte_math", value=(number(given["bytes"]), number(given["offset"]), given["oper"], number(given["rvalue"]), given["result"], more), relative="relative" in more))
        elif name == "base64_decode":
            given = dict(x.split(None, 1) for x in _fields(value) if " " in x)
            part().terms.append(Term("base64_decode", value=(int(given["bytes"]) if "bytes" in given else None, int(given.get("offset", 0))), relative="relative" in _fields(value)))
        elif name == "proto":
            if value not in ("tcp", "udp", "icmp", "icmpv6"):
                raise RuleError(f"unknown protocol {value}")
            rule.header["proto"] = value
        elif name in ("src_ip", "dst_ip"):
            rule.header[name] = addresses(value)
        elif name in ("src_port", "dst_port"):
            rule.header[name] = ports(value)
        elif name in ("itype", "icode", "window", "ip_proto", "dsize"):
            rule.header[name] = length_test(value)
        elif name in ("flags", "stream_size"):
            rule.header[name] = value
        elif name == "flowbits":
            verb, *bit = _fields(value)
            if verb == "noalert":
                rule.noalert = True
            elif verb in ("set", "unset", "toggle", "isset", "isnotset") and bit:
                rule.flowbits.append((verb, bit[0]))
            else:
                raise RuleError(f"bad flow bit: {value}")
        elif name == "xbits":
            verb, bit, *more = _fields(value)
            given = dict(x.split(None, 1) for x in more if " " in x)
            if verb not in ("set", "unset", "toggle", "isset", "isnotset") or given.get("track") not in ("ip_src", "ip_dst", "ip_pair"):
                raise RuleError(f"bad bit: {value}")
            rule.xbits.append((verb, bit, given["track"], int(given.get("expire", 30))))
        elif name in ("threshold", "detection_filter"):
            rule.threshold = _window(value if name == "threshold" else f"type detection_filter,{value}")
        elif name == "noalert":
            rule.noalert = True
        elif name != "rev":
            raise RuleError(f"unknown option {name}")
    rule.parts, rule.name = parts or [Part("payload")], rule.name or f"sid-{rule.sid}"
    check(rule)
    return rule


def check(rule: Rule) -> None:
    """Refuses rules that could never be meant."""
    if not rule.sid:
        raise RuleError("no sid")
    if len(rule.parts) > PARTS:
        raise RuleError(f"more than {PARTS} buffers")
    alone = any(k in rule.header for k in ("flags", "itype", "icode", "window", "ip_proto", "stream_size"))
    for p in rule.parts:
        if not p.terms and not (alone and len(rule.parts) == 1):
            raise RuleError(f"nothing to test in {p.buffer}")
        if p.terms and p.buffer in ("payload", "packet") and all(t.negated for t in p.terms):
            raise RuleError("only negations on the raw payload")
        if p.terms and p.terms[0].relative:
            raise RuleError("the first term has nothing to be relative to")
        if len({t.value[2] for t in p.terms if t.kind == "byte_extract"} | {t.value[4] for t in p.terms if t.kind == "byte_math"}) > VARIABLES:
            raise RuleError(f"more than {VARIABLES} variables")


def parse_old(line: str, sid: int) -> Rule:
    fields = line.split("|", 4)
    if len(fields) != 5:
        raise RuleError("not five fields")
    name, buffer, direction, kind, text = fields
    negated = kind.startswith("not_")
    if direction not in DIRECTIONS or kind.removeprefix("not_") not in ("literal", "regex") or not text:
        raise RuleError("unknown direction or type, or no pattern")
    if negated and buffer in ("payload", "packet"):
        raise RuleError("only negations on the raw payload")
    if kind.endswith("literal"):
        term = Term("content", negated, text.encode())
    else:
        compiles(body := pattern(text))
        term = Term("pcre", negated, body)
    return Rule(sid, name, "high", DIRECTIONS[direction], [Part(buffer, terms=[term])], old=True)


def parse_rules(text: str, strict: bool = True) -> tuple[list[Rule], list[tuple[int, str]]]:
    """Rules, and (line, error) of those refused; strict raises the first error."""
    rules, errors = [], []
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        try:
            rules.append(parse_new(line) if re.match(r"rule\s", line) else parse_old(line, -n))
        except (RuleError, ValueError, KeyError) as e:
            if strict:
                raise RuleError(f"line {n}: {e}") from e
            errors.append((n, str(e)))
    return rules, errors


def check_lines(lines: DataFrame) -> DataFrame:
    """line and error of the rules in (line, value) that cannot be used."""

    def error(value: str | None) -> str | None:
        _, errors = parse_rules(value or "", strict=False)
        return errors[0][1] if errors else None

    return lines.select("line", F.udf(error, "string", useArrow=True)("value").alias("error")).filter("error IS NOT NULL")
