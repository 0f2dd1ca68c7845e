"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one last token exists in its byte-pair encoding.  An automaton of all tokens gives
those that end at each position; a candidate is the last token if it is compatible with the last token of the prefix
before it, that is, if the pair, encoded together, gives just that pair.  Back-pointers from the end give the exact ids.

Defined results: null and empty texts give no ids; special strings inside texts are tokens of their own, as the
library's default is; any code point is encodable; very long pieces take time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Chunks kept by one Python worker with their ids; the memory is emptied when it is full.
CHUNKS_KEPT = 400_000
PIECES_KEPT = 300_000
#: Outcomes of pair tests kept likewise.
PAIRS_KEPT = 1_000_000
#: Tokens are held as their id and, in the low bits, their size in bytes.
BITS, SIZE = 10, 1023
#: Code points that stand for a byte at the end of a word.
ENDS = 0xE000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {}, 0x100
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class Codec:
    """Encodes and decodes with the vocabulary and merges of a tokenizer definition that has word ends."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.symbol = byte_alphabet()
        ends = {c: chr(ENDS + b) for b, c in enumerate(self.symbol)}

        def spelled(token: str) -> str:
            return token[: -len(self.suffix) - 1] + ends[token[-len(self.suffix) - 1]] if token.endswith(self.suffix) and len(token) > len(self.suffix) else token

        vocab = model["vocab"]
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for k, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.pair[left, right] = k
            self.parts.setdefault(made, (left, right))
            self.rank.setdefault(made, k)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, i in vocab.items():
            text = spelled(token)
            if len(text) == 1 or i in self.parts:
                self.automaton.add_word(text, i << BITS | len(text))
        self.automaton.make_automaton()
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def compatible(self, before: int, after: int) -> bool:
        """Whether the two tokens' characters, encoded together, give these two tokens.

        Merges run in order of rank, leftmost first.  Undone from the last one, each step shows the two symbols that
        faced each other at the seam until then; had they a merge that ran earlier, it would have joined them.
        """
        left, right = before >> BITS, after >> BITS
        rank, pair, parts = self.rank, self.pair, self.parts
        until, fits = float("inf"), True
        while True:
            if (k := pair.get((left, right))) is not None and k < until:
                fits = False
                break
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                break
            # of equal ranks the left one ran first; a merge at the seam goes before one of its rank further right
            if a > b:
                until, left = a, parts[left][1]
            else:
                until, right = b + 1, parts[right][0]
        if len(self.fits) > PAIRS_KEPT:
            self.fits.clear()
        self.fits[before << 40 | after] = fits
        return fits

    def piece(self, text: str) -> list[int]:
        """The ids of one pre-tokenised piece."""
        raw = text.encode("utf-8")
        symbol = self.symbol
        word = "".join([symbol[x] for x in raw[:-1]]) + chr(ENDS + raw[-1])
        last, fits = [-1] * len(word), self.fits  # last[k]: the last token of the prefix that ends with k, as (id, size)
        for end, code in self.automaton.iter(word):
            if last[end] >= 0:
                continue
            start = end - (code & SIZE)
            if start >= 0:
                before = last[start]
                if before < 0:
                    continue
                fit = fits.get(before << 40 | code)
                if fit is None:
                    fit = self.compatible(before, code)
                if not fit:
                    continue
            last[end] = code
        out, at = [], len(word) - 1
        while at >= 0:
            code = last[at]
            out.append(code >> BITS)
            at -= code & SIZE
        out.reverse()
        return out

    def chunk(self, text: str) -> tuple[int, ...]:
        """The ids of a normalised chunk without blanks at its ends."""
        out: list[int] = []
        for piece in self.split.findall(text):
            if (ids := self.pieces.get(piece)) is None:
                if len(self.pieces) > PIECES_KEPT:
                    self.pieces.clear()
                ids = self.pieces[piece] = tuple(self.piece(piece))
            out += ids
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else (text,)
        for part in parts:
            if (i := self.special.get(part)) is not None:
                out.append(i)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            known = self.known
            for c in part.lower().replace("\n", " ").split(" "):
                ids = known.get(c)
                if ids is None:
                    if len(known) > CHUNKS_KEPT:
                        known.clear()
                    ids = known[c] = self.chunk(c)
                out += ids
        return out

    def decode(self, ids) -> str:
        """The tokens joined as the library joins them where no decoder is set."""
        return " ".join(map(self.name.__getitem__, ids))


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=2)
def codec(definition: str) -> Codec:
    """Kept by the Python worker from task to task."""
    return Codec(definition)


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """key, ids array<int>, decoded string for every row; with digests, n_tokens, ids_sha256 and decoded_sha256 in their place."""
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cols: list[list] = [[], [], []]
                for t in part.column(1).to_pylist():
                    ids = coder.encode(t or "")
                    decoded = coder.decode(ids)
                    if digests:
                        row = len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
                    else:
                        row = ids, decoded, None
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                if digests:
                    arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
                    yield pa.RecordBatch.from_arrays([part.column(0), *arrays], [key, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.string())], [key, "ids", "decoded"])

    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
