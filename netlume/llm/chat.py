"""Chat formatting by schema fingerprints.

A record is a JSON object in any layout.  The set of its nested field paths (array elements are `[]`) is hashed; the
digest selects a declarative mapping, and the mapping turns the record into canonical turns of role and text.  The turns
are rendered with a template whose control strings are escaped inside roles and texts, so that reading back is exact.

Defined results: a null record, invalid or too deeply nested JSON, or a layout that no mapping knows has `layout` null and
no turns, and so has a list of turns with an element that is no object; half of a surrogate pair becomes U+FFFD; a null
text is empty; a null role is empty; fields outside every mapping are ignored; repeated and tied turns are all kept, in
the order of turn, role, text; very long texts are kept whole.  One record is one output row, so its text has to fit in
one cell, as everywhere in Spark.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Strings that mark turns, here or in common templates; escaped wherever they occur inside a role or text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PATH_MARKS = re.compile(r"[\\.\[\]]")
_SURROGATE = re.compile("[\ud800-\udfff]")


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    Either `items` names a list field and `role`/`text` the fields of its elements, or `fields` lists (role, field)
    pairs of a flat record; `joined` pairs append a field to the turn before it.  Optional paths may be missing.
    """

    name: str
    items: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    joined: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        if self.items:
            return {f"{self.items}[].{self.role}", f"{self.items}[].{self.text}", *self.optional}
        return {f for _, f in self.fields} | {f for _, f in self.joined}

    def layouts(self) -> Iterator[frozenset[str]]:
        must = self.paths() - set(self.optional)
        for n in range(len(self.optional) + 1):
            for some in itertools.combinations(self.optional, n):
                yield frozenset(must | set(some))


MAPPINGS = (
    Mapping("messages", items="messages", role="role", text="content", optional=("system",)),
    Mapping("shared", items="conversations", role="from", text="value", optional=("system",)),
    Mapping("turns", items="turns", role="role", text="text", optional=("turns[].turn",)),
    Mapping("dialogue", items="dialog", role="speaker", text="utterance"),
    Mapping("instruction", fields=(("system", "system"), ("user", "instruction"), ("assistant", "output")), joined=(("instruction", "input"),), optional=("system", "input")),
    Mapping("prompt_completion", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("prompt_response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("question_answer", fields=(("user", "question"), ("assistant", "answer")), joined=(("question", "context"),), optional=("context",)),
)
#: Spellings of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a JSON value down to its leaves; names that look like paths are escaped."""
    if isinstance(value, dict):
        named = ((_PATH_MARKS.sub(r"\\\g<0>", k), v) for k, v in value.items())
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in named)) if value else {prefix}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{prefix}[]") for v in value)) if value else {f"{prefix}[]"}
    return {prefix}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:32]


def whole(text: str) -> str:
    """Surrogate pairs as their character, halves as U+FFFD."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if _SURROGATE.search(text) else text


def said(value) -> str:
    """A value as text: null is empty, what is no string stays JSON."""
    return whole(value) if isinstance(value, str) else "" if value is None else whole(json.dumps(value, ensure_ascii=False))


def loaded(raw: str | None):
    """A record's value, or None."""
    try:
        return json.loads(raw) if raw is not None else None
    except (ValueError, RecursionError):
        return None


class Layouts:
    """Mappings by the fingerprint of each layout that they accept."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.known = set().union(*(m.paths() for m in mappings))
        self.empty = {f"{m.items}[]": m for m in mappings if m.items}
        self.by_print = {fingerprint(layout): m for m in mappings for layout in m.layouts()}

    def select(self, record) -> tuple[str, Mapping | None]:
        paths = field_paths(record) if isinstance(record, dict) else set()
        digest = fingerprint(paths & self.known)
        found = self.by_print.get(digest)
        if found is None and len(lists := [self.empty[p] for p in paths if p in self.empty]) == 1:
            return digest, lists[0]
        return digest, found

    def turns(self, record) -> tuple[str, str | None, list[tuple[str, str]]]:
        """Fingerprint, layout name and turns."""
        try:
            digest, m = self.select(record)
        except RecursionError:
            digest, m = fingerprint(()), None
        items = record.get(m.items) if m is not None and m.items else []
        if m is None or not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
            return digest, None, []
        if m.items:
            out = [("system", said(record["system"]))] if record.get("system") else []
            for x in items:
                role = said(x.get(m.role))
                out.append((ROLES.get(role, role), said(x.get(m.text))))
            return digest, m.name, out
        joined = dict(m.joined)
        out = []
        for role, name in m.fields:
            if name in record and (name != "system" or record[name]):
                more = said(record.get(joined.get(name)))
                out.append((role, said(record[name]) + (f"\n\n{more}" if more else "")))
        return digest, m.name, out


def escape(text: str) -> str:
    """Doubles backslashes and breaks each control string after its first character; undone by unescape()."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\")) if "<" in text or "[" in text or "\\" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else m[1], text) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the code point spans under the loss mask: what assistants say."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{MIDDLE}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out = []
    for part in formatted.split(CLOSE)[:-1]:
        role, _, text = part.removeprefix(OPEN).partition(MIDDLE)
        out.append((unescape(role), unescape(text)))
    return out


def records(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", layouts: tuple[str, ...] = ("turns",)) -> DataFrame:
    """One JSON record a conversation from rows of turns; null keys form a conversation of their own.

    With several layouts (of MAPPINGS with `items`) a hash of the key deals conversations to them, as in a mixed corpus.
    """
    by_name = {m.name: m for m in MAPPINGS if m.items}
    one = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    turns = rows.groupBy(F.col(conv).alias(conv)).agg(F.array_sort(F.collect_list(one)).alias("_turns"))

    def laid_out(m: Mapping) -> Column:
        extra = [("turn", "turn")] if f"{m.items}[].turn" in m.optional else []
        each = F.transform("_turns", lambda x: F.struct(x["role"].alias(m.role), x["text"].alias(m.text), *[x[a].alias(b) for a, b in extra]))
        return F.to_json(F.struct(each.alias(m.items)), {"ignoreNullFields": "false"})

    choice = F.pmod(F.xxhash64(F.col(conv).cast("string")), F.lit(len(layouts)))
    record = F.coalesce(*[F.when(choice == k, laid_out(by_name[name])) for k, name in enumerate(layouts)])
    return turns.select(F.col(conv), record.alias("record"))


def format_chat(df: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Replaces the record column by fingerprint, layout, formatted and loss_spans; other columns stay."""
    kept = [c for c in df.columns if c not in (record, "fingerprint", "layout", "formatted", "loss_spans")]
    names = ", ".join(f"`{c.replace('`', '``')}` {t}" for c, t in df.select(*[f"`{c}`" for c in kept]).dtypes)
    layouts = Layouts(mappings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for raw in b[record]:
                digest, layout, turns = layouts.turns(loaded(raw))
                text, spans = render(turns)
                made.append((digest, layout, text, [{"start": s, "end": e} for s, e in spans]))
            out = b[kept].reset_index(drop=True)
            for k, name in enumerate(("fingerprint", "layout", "formatted", "loss_spans")):
                out[name] = pd.Series([m[k] for m in made], dtype=object)
            yield out

    schema = f"{names + ', ' if names else ''}fingerprint string, layout string, formatted string, loss_spans array<struct<start: bigint, end: bigint>>"
    return df.select(*[f"`{c}`" for c in [*kept, record]]).mapInPandas(run, schema)


def formatted_digests(df: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what is read back from `formatted` and from under the loss mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, layout, digest, text, spans in zip(b[conv], b["layout"], b["fingerprint"], b["formatted"], b["loss_spans"], strict=True):
                turns, h = read_back(text), hashlib.sha256()
                for role, said in turns:
                    h.update(f"{role}\n{said}\n".encode())
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append((key, len(turns), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), layout, digest))
            yield pd.DataFrame(out, columns=[conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "layout", "fingerprint"])

    kind = dict(df.dtypes)[conv]
    return df.select(conv, "layout", "fingerprint", "formatted", "loss_spans").mapInPandas(run, f"`{conv}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, layout string, fingerprint string")
