"""Files carried by HTTP: bodies of messages that came in pieces, hashed once they are whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netlume.parse import text

from .windows import key_changes

#: Bytes of a body that are hashed at most; a longer one gives no file.
MOST = 64 << 20


class Tap:
    """Reads one direction's bytes as they come; holds the head of a message, never more of its body than its hashes."""

    def __init__(self):
        self.held, self.left, self.chunked, self.hashes, self.size, self.start, self.closing = b"", None, False, None, 0, b"", False
        self.chunk: int | None = None

    def feed(self, data: bytes) -> Iterator[dict[str, object]]:
        """The files that these bytes complete."""
        self.held += data
        while True:
            if self.hashes is None:
                head, end, rest = self.held.partition(b"\r\n\r\n")
                if not end:
                    return
                found = text.http_response(head + end) or text.http_request(head + end)
                if found is None:
                    self.held = rest
                    continue
                self.held, self.hashes, self.size, self.start = rest, (hashlib.md5(), hashlib.sha256()), 0, b""
                self.chunked, self.chunk = bool(found["chunked"]), None
                self.left = None if self.chunked else found["content_length"]
                self.closing = self.left is None and not self.chunked and "stat_code" in found
                if self.left is None and not self.chunked and not self.closing:
                    self.hashes = None  # a request without a length has no body
                    continue
            if self.chunked:
                if not self._chunks():
                    return
            else:
                n = len(self.held) if self.left is None else min(self.left, len(self.held))
                self._add(self.held[:n])
                self.held = self.held[n:]
                if self.left is None:
                    return
                self.left -= n
                if self.left:
                    return
            if (done := self._file()) is not None:
                yield done
            self.hashes = None

    def _add(self, data: bytes) -> None:
        for h in self.hashes or ():
            h.update(data)
        self.size += len(data)
        self.start = (self.start + data)[: text.HEAD] if len(self.start) < text.HEAD else self.start

    def _chunks(self) -> bool:
        """Whether the last chunk is read; a malformed body ends the message without a file."""
        while True:
            if self.chunk is None:
                line, end, rest = self.held.partition(b"\r\n")
                if not end:
                    return False
                size = line.partition(b";")[0].strip(b" \t")
                if not size or len(size) > 16 or size.strip(b"0123456789abcdefABCDEF"):
                    self.size, self.held = MOST + 1, b""
                    return True
                self.chunk, self.held = int(size, 16) + 2, rest
                if self.chunk == 2:  # trailers up to an empty line
                    *_, end = self.held.partition(b"\r\n")
                    self.held = end
                    return True
            n = min(self.chunk, len(self.held))
            self._add(self.held[: max(min(n, self.chunk - 2), 0)])
            self.held, self.chunk = self.held[n:], self.chunk - n
            if self.chunk:
                return False
            self.chunk = None

    def _file(self) -> dict[str, object] | None:
        if not 0 < self.size <= MOST or self.hashes is None:
            return None
        found = text.file_identity(self.start)
        return {"size": self.size, "md5": self.hashes[0].hexdigest(), "sha256": self.hashes[1].hexdigest(), "type": found["type"], "description": found["description"]}

    def end(self) -> Iterator[dict[str, object]]:
        """A body that lasts until the connection ends."""
        if self.hashes is not None and self.closing and (done := self._file()) is not None:
            yield done


def files(segments: DataFrame, keys: list[str], seq: str = "seq", payload: str = "payload") -> DataFrame:
    """keys, size, md5, sha256, type and description of each whole body, from a direction's bytes in order; a body that stays unfinished gives none."""
    kinds, n = dict(segments.dtypes), len(keys)
    names = ["size", "md5", "sha256", "type", "description"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tap, key = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            fresh, last = key_changes([b.column(k) for k in range(n)], last)
            keyed, found = [], []
            for k, (new, data) in enumerate(zip(fresh.tolist(), b.column(n).to_pylist(), strict=True)):
                if new:
                    if tap is not None:
                        for f in tap.end():
                            keyed.append(key)
                            found.append(f)
                    tap, key = Tap(), [b.column(c).slice(k, 1) for c in range(n)]
                for f in tap.feed(data or b""):
                    keyed.append(key)
                    found.append(f)
            if found:
                yield _rows(keyed, found)
        if tap is not None and (rest := list(tap.end())):
            yield _rows([key] * len(rest), rest)

    def _rows(keyed: list, found: list[dict]) -> pa.RecordBatch:
        made = [pa.array([f[c] for f in found], pa.int64() if c == "size" else pa.string()) for c in names]
        return pa.RecordBatch.from_arrays([*(pa.concat_arrays([x[c] for x in keyed]) for c in range(n)), *made], [*keys, *names])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", size bigint, md5 string, sha256 string, type string, description string"
    return segments.repartition(*keys).sortWithinPartitions(*keys, seq).select(*keys, F.col(payload).cast("binary")).mapInArrow(run, schema)
