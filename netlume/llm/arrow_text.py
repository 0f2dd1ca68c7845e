"""Views of Arrow string columns as flat NumPy byte arrays, cut into work units of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once by the vectorised kernels; a longer text is a unit of its own.
UNIT_BYTES = 1 << 20


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def units(offsets: np.ndarray, most: int = UNIT_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about `most` bytes together; whole rows only."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; empty segments give 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def words_joined(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that `table` maps to other than 0, each with a blank before it and one after each row.

    Returns the bytes, their offsets by row, and the place of each run's first byte.
    """
    n = len(offsets) - 1
    kinds = np.zeros(len(data) + 2 * n, np.uint8)
    row = np.arange(n)
    kinds[np.arange(len(data)) + np.repeat(2 * row + 1, np.diff(offsets))] = table[data]
    inside = kinds != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    keep = inside.copy()
    keep[:-1] |= starts[1:]
    keep[offsets[:-1] + 2 * row] = True
    keep[offsets[1:] + 2 * row + 1] = True
    kinds[~inside] = 0x20
    place = np.cumsum(keep)
    bounds = np.concatenate((place[offsets[:-1] + 2 * row] - 1, place[-1:] if n else [0]))
    return kinds[keep], bounds, place[np.flatnonzero(starts)] - 1


def ngram_hashes(data: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """A bucket for each window of n bytes, n at most 8; the window at the end of a row belongs to no row."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    wide = np.ndarray((len(data) - n + 1,), "<u8", padded, strides=(1,))
    mixed = (wide & np.uint64((1 << 8 * n) - 1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
    return (mixed >> np.uint64(65 - buckets.bit_length())).astype(np.int64)
