"""N-gram Jaccard join by prefix trees.

A document's set holds the 64-bit hashes of its distinct word n-grams.  Equal sets are one class.  All n-grams have one
global order: by the level of their counts over all classes, which a sketch of fixed size holds, then by hash; any order
gives the same links, this one puts what many classes share last.  Linked sets meet in the first n-grams of both, the
part of a path on which a partner has to touch it, so only those first n-grams are shuffled.  Of the classes that meet
on one and whose sizes leave no gap that links cannot cross, the first is the centre; a centre and all classes that meet
it form a block, so every two classes that can link are in one.  A block's sets are stored in a prefix tree, where every
set is looked up: overlaps along shared paths are counted once, and a subtree is left as soon as the n-grams that remain
on either side cannot reach the threshold.  In the tree the order is the one of the block, its rarest n-grams first.
Links give connected components.

Before texts move, classes leave a block if their counts of n-grams by ranges of hashes differ from those of all others
there by more than linked sets can.  Blocks beyond `BLOCK` sets skip that and are dealt into shards that are joined on
their own, each with the same few pivots; of those that are still in several components after it, all sets outside the
largest one meet all others, `BLOCK` of either at a time, first by their counts, then by their n-grams.  No link is lost at
any size.

Defined results: null texts and texts without words have no n-grams and are linked with nothing; texts of fewer words
than an n-gram have one, the whole sequence; equal texts share a component; rows with equal or null ids are kept; very
long texts are taken whole; of a table only key and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import workspace
from .arrow_text import units, utf8, words_joined
from .components import connected_components

#: Sets in one prefix tree (of either side of it in the second round), and in it sets that all shards of a block share.
BLOCK, PIVOTS = 256, 16
#: Ranges whose n-grams are counted: that many at least, and one for eight n-grams.
COUNTED = 64
#: Branches with more kids than this keep an index of them.
KIDS = 8
#: The sketch has 2^BITS counts, dealt in PIECES; it is the only thing that goes to the driver, and from there to all tasks as a byte for each count.
BITS, PIECES = 21, 64
#: Bytes of text hashed at once; a longer text is a unit of its own.
UNIT = 1 << 18
#: First n-grams that a task gathers to a batch.
HELD = 1 << 19
#: A shuffled n-gram keeps its upper 48 bits; 15 bits hold its set's size, 512 steps for each doubling, and one its place.
STEPS = 512
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORDS = np.arange(256, dtype=np.uint8)
_WORDS[0x41:0x5B] += 0x20
_WORDS[0] = 0xFF  # UTF-8 never has it
_WORDS[[0x20, 9, 10, 11, 12, 13]] = 0


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, made longer as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            one = np.ones(1, _U)
            self.up = np.concatenate((one, np.cumprod(np.full(n, _BASE))))
            self.down = np.concatenate((one, np.cumprod(np.full(n, _INVERSE))))
        return self.up, self.down


_POWERS = Powers()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words, and their offsets by row."""
    flat, bounds, starts = words_joined(data, offsets, _WORDS)
    up, down = _POWERS.to(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, _U)
    np.cumsum(flat * up[: len(flat)], out=sums[1:])
    blank = np.flatnonzero(flat == 0x20)
    ends = blank[np.searchsorted(blank, starts)]
    return mixed((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, bounds)


def ngram_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Each row's set in order."""
    words, rows = word_hashes(data, offsets)
    total = np.zeros(max(len(words) - size + 1, 0), _U)
    for k, odd in enumerate(mixed(np.arange(1, size + 1, dtype=_U)) | _U(1)):
        total += words[k : k + len(total)] * odd
    total = mixed(total)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(total[a : b - size + 1]))
        elif b > a:
            part = words[a:b] * mixed(np.arange(101, 101 + b - a, dtype=_U))
            out.append(mixed(part.sum(dtype=_U)[None] + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def range_counts(ngrams: np.ndarray) -> bytes:
    """N-grams in each of 2^k equal ranges; what exceeds a byte counts as 255, which only brings sets nearer."""
    bits = max(COUNTED.bit_length() - 1, (len(ngrams) - 1).bit_length() - 3)
    return np.minimum(np.bincount((ngrams >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def class_of(ngrams: np.ndarray) -> int:
    """Digest of a set, as a signed number."""
    return int(mixed(mixed(ngrams ^ _BASE).sum(dtype=_U)[None] + _U(len(ngrams)))[0].astype(np.int64))


def levels_of(counts: np.ndarray) -> np.ndarray:
    """A byte for each count of the sketch: 0 up to one deviation above the mean, then a step for each factor of 1.4."""
    mean = counts.mean()
    over = np.maximum((counts - mean) / max(mean, 1.0) ** 0.5, 1)
    return np.where(over > 1, 1 + np.floor(2 * np.log2(over)), 0).astype(np.uint8)


class Prefixes:
    """The first n-grams of sets, so many that sets with den * overlap >= num * union share one of them."""

    def __init__(self, levels: np.ndarray, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold must be over 0 and not over 1")
        self.levels, self.num, self.den = levels, num, den

    def lengths(self, n: int) -> tuple[int, int]:
        """First n-grams that meet smaller partners, and those among them that meet partners as large or larger."""
        return n + (-self.num * n) // self.den + 1, n + (-2 * self.num * n) // (self.num + self.den) + 1

    def packed(self, ngrams: np.ndarray) -> np.ndarray:
        """48 bits of each first n-gram, 15 of the set's size, and a last one that is 0 where it meets larger partners too."""
        probed, indexed = self.lengths(len(ngrams))
        at = self.levels[(ngrams >> _U(64 - BITS)).astype(np.int64)]
        if at.any():
            ngrams = ngrams[np.argsort(at, kind="stable")]
        out = (ngrams[:probed] & _U(0xFFFF_FFFF_FFFF_0000)) | _U(int(log2(len(ngrams)) * STEPS) << 1)
        out[indexed:] |= _U(1)
        return out

    def widest(self) -> int:
        """Steps by which the sizes of linked sets can differ."""
        return int(log2(self.den / self.num) * STEPS) + 2


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


class Branch:
    __slots__ = ("path", "kids", "leaf", "deepest", "least", "most", "some", "alike", "index", "always")

    def __init__(self, path: np.ndarray, leaf: int = -1):
        self.path, self.leaf, self.kids = path, leaf, []
        self.deepest = self.least = self.most = 0  # n-grams below, smallest and largest set below
        self.some, self.alike = leaf, False  # one set below, and whether all are known to be of its component
        self.index: dict[int, list[Branch]] | None = None  # of many kids, those that can be reached by an n-gram
        self.always: list[Branch] = []


class PrefixTree:
    """Sets of positions in one global order, their common beginnings stored once."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        self.root = Branch(np.zeros(0, np.int64))
        stack = [(self.root, 0)]  # branches of the last set, with the depth at their ends
        before = None
        for k in order:
            s = sets[k]
            depth = 0
            if before is not None:
                n = min(len(before), len(s))
                differ = np.flatnonzero(before[:n] != s[:n])
                depth = int(differ[0]) if len(differ) else n
            while len(stack) > 1 and stack[-1][1] > depth:
                last, end = stack.pop()
                if stack[-1][1] < depth:  # the common beginning ends inside this branch
                    keep = len(last.path) - (end - depth)
                    upper = Branch(last.path[:keep])
                    last.path = last.path[keep:]
                    stack[-1][0].kids[-1] = upper
                    upper.kids.append(last)
                    stack.append((upper, depth))
            leaf = Branch(s[depth:], k)
            stack[-1][0].kids.append(leaf)
            stack.append((leaf, len(s)))
            before = s
        self.measure()

    def measure(self) -> None:
        order, stack = [], [self.root]
        while stack:
            b = stack.pop()
            order.append(b)
            stack += b.kids
        for b in reversed(order):
            if b.leaf >= 0:
                b.least = b.most = len(self.sets[b.leaf])
                b.alike = not b.kids
            if b.kids:
                b.deepest = max(len(k.path) + k.deepest for k in b.kids)
                b.least = min([k.least for k in b.kids] + [b.least] * (b.leaf >= 0))
                b.most = max([k.most for k in b.kids] + [b.most] * (b.leaf >= 0))
                b.some = b.some if b.some >= 0 else b.kids[0].some
            if len(b.kids) > KIDS:
                # a set may miss so many of its n-grams: one more of a kid's first ones has to be met
                b.index = {}
                for k in b.kids:
                    first = k.path[: k.most * (self.den - self.num) // self.den + 1].tolist()
                    if len(first) == len(k.path):
                        b.always.append(k)
                    else:
                        for gram in first:
                            b.index.setdefault(gram, []).append(k)

    def reachable(self, b: Branch, grams: list[int]) -> list[Branch]:
        if b.index is None:
            return b.kids
        found = {id(k): k for g in grams if g in b.index for k in b.index[g]}
        return [*b.always, *found.values()]

    def lookup(self, probe: int, held: np.ndarray, forest: Forest) -> Iterator[int]:
        """Sets that link with the probe, one at least of each component that has such; `held` marks the probe's n-grams."""
        x, num, den = self.sets[probe], self.num, self.den
        size, grams = len(x), x.tolist()
        stack = [(self.root, 0, 0)]
        while stack:
            b, overlap, depth = stack.pop()
            if b.alike and forest.find(b.some) == forest.find(probe):
                continue
            if b.least * num > den * size or b.most * den < num * size:
                continue
            if len(b.path):
                overlap += int(np.count_nonzero(held[b.path]))
                depth = int(np.searchsorted(x, b.path[-1], "right"))
            if (den + num) * (overlap + min(size - depth, b.deepest)) < num * (size + b.least):
                continue
            if b.leaf >= 0 and b.leaf != probe and (den + num) * overlap >= num * (size + len(self.sets[b.leaf])) and forest.find(b.leaf) != forest.find(probe):
                yield b.leaf
            if b.kids:
                stack += [(k, overlap, depth) for k in self.reachable(b, grams)]
                if not b.alike and b.index is None:
                    roots = {forest.find(k.some) for k in b.kids} | ({forest.find(b.leaf)} if b.leaf >= 0 else set())
                    b.alike = len(roots) == 1 and all(k.alike for k in b.kids)


def tree_links(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links between sets that give the components of all links among them."""
    if len(sets) < 2:
        return []
    grams, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(grams), np.int64)
    place[np.lexsort((grams, often))] = np.arange(len(grams))  # the rarest first
    local = [np.sort(part) for part in np.split(place[at], np.cumsum([len(s) for s in sets])[:-1])]
    tree, forest, out = PrefixTree(local, num, den), Forest(len(sets)), []
    held = np.zeros(len(grams), bool)
    for probe in range(len(sets)):
        held[local[probe]] = True
        for other in tree.lookup(probe, held, forest):
            out.append((probe, other))
            forest.join(probe, other)
        held[local[probe]] = False
    return out


def near_by_counts(sizes: np.ndarray, counts: list[bytes], roots: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether each set may link with one that has another root, by sizes and counts."""
    keep, wide = np.zeros(len(sizes), bool), np.array([len(c) for c in counts])
    held: dict[tuple[int, int], np.ndarray] = {}

    def at(ranges: int, own: int) -> np.ndarray:
        """Counts of the sets that have so many ranges, added up to fewer."""
        if (ranges, own) not in held:
            rows = np.frombuffer(b"".join(c for c in counts if len(c) == ranges), np.uint8).reshape(-1, own, ranges // own)
            held[ranges, own] = rows.sum(axis=2, dtype=np.int32)
        return held[ranges, own]

    groups = {int(r): np.flatnonzero(wide == r) for r in np.unique(wide)}
    place = np.empty(len(sizes), np.int64)
    for members in groups.values():
        place[members] = np.arange(len(members))
    for k in range(len(sizes)):
        for ranges, members in groups.items():
            fit = (roots[members] != roots[k]) & (sizes[members] * den >= sizes[k] * num) & (sizes[k] * den >= sizes[members] * num)
            if keep[k]:
                fit &= ~keep[members]
            if not fit.any():
                continue
            own = min(ranges, int(wide[k]))
            rows, row = at(ranges, own)[fit], at(int(wide[k]), own)[place[k]]
            near = members[fit][np.abs(rows - row).sum(axis=1) <= (sizes[members[fit]] + sizes[k]) * (den - num) // (den + num)]
            if len(near):
                keep[k] = True
                keep[near] = True
    return keep


def sets_of(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    data, offsets = utf8(column)
    for first, last in units(offsets, UNIT):
        yield from ngram_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], size)


def classes(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """key, n_shingles, node (null for the empty set), digest of the text and counts of each row, then each task's part of the sketch (piece, counts)."""
    kind = dict(docs.dtypes)[key]
    names = [key, "n_shingles", "node", "text_digest", "piece", "counts"]
    schema = f"`{key}` {kind}, n_shingles bigint, node bigint, text_digest bigint, piece int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, held, seen, empty = np.zeros(1 << BITS, np.int64), [], 0, set(), None
        for b in batches:
            n, node, ranges = [], [], []
            for s in sets_of(b.column(1), size):
                n.append(len(s))
                node.append(class_of(s) if len(s) else None)
                ranges.append(range_counts(s) if len(s) else None)
                if len(s) and node[-1] not in seen:
                    seen.add(node[-1])
                    waiting.append((s >> _U(64 - BITS)).astype(np.int32))
                    held += len(s)
                if held > 1 << BITS:
                    total += np.bincount(np.concatenate(waiting), minlength=1 << BITS)
                    waiting, held = [], 0
            empty = b.column(0).slice(0, 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), b.column(2), pa.nulls(len(n), pa.int32()), pa.array(ranges, pa.binary())], names)
        if empty is not None:
            total += np.bincount(np.concatenate([np.zeros(0, np.int32), *waiting]), minlength=1 << BITS)
            counts = [zlib.compress(x.tobytes(), 1) for x in np.split(np.minimum(total, (1 << 32) - 1).astype("<u4"), PIECES)]
            none = [pa.nulls(PIECES, x) for x in (empty.type, pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(PIECES), pa.int32()), pa.array(counts, pa.binary())], names)

    return docs.select(F.col(key), F.col(text), F.xxhash64(F.col(text))).mapInArrow(run, schema)


def sketch_levels(members: DataFrame) -> np.ndarray:
    """Levels of the sketch; its parts are summed in PIECES tasks at most, and 8 MB reach the driver at any size of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(zlib.decompress(counts), "<u4").astype(np.int64)
        whole = [np.minimum(x, (1 << 32) - 1).astype("<u4").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(whole, pa.binary())], ["piece", "counts"])

    tasks = min(PIECES, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = members.filter("piece IS NOT NULL").select("piece", "counts").repartition(tasks, "piece")
    found = {r["piece"]: r["counts"] for r in parts.mapInArrow(run, "piece int, counts binary").collect()}
    one = np.zeros((1 << BITS) // PIECES, "<u4").tobytes()
    return levels_of(np.frombuffer(b"".join(found.get(k, one) for k in range(PIECES)), "<u4").astype(np.float64))


def candidates(docs: DataFrame, levels: np.ndarray, size: int, num: int, den: int, text: str) -> DataFrame:
    """Pairs (a, b) of classes that meet on a first n-gram; b is the centre of all that do."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(levels)

    def shuffled(grams: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(nodes))], ["packed", "node"])

    def first_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, seen = Prefixes(shared.value, num, den), set()
        for b in batches:
            grams, nodes, held = [np.zeros(0, _U)], [np.zeros(0, np.int64)], 0
            for s in sets_of(b.column(0), size):
                if len(s) and (node := class_of(s)) not in seen:
                    seen.add(node)
                    grams.append(prefixes.packed(s))
                    nodes.append(np.full(len(grams[-1]), node))
                    held += len(grams[-1])
                if held > HELD:
                    yield shuffled(grams, nodes)
                    grams, nodes, held = [], [], 0
            if grams:
                yield shuffled(grams, nodes)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the group that a batch breaks off only the centre is carried on, or all until one of it meets larger partners."""
        widest = Prefixes(shared.value, num, den).widest()
        packed, node = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def pairs(last: bool) -> pa.RecordBatch:
            nonlocal packed, node
            size_ = (packed >> 1) & 0x7FFF
            fresh = np.ones(len(packed), bool)
            fresh[1:] = (packed[1:] >> 16 != packed[:-1] >> 16) | (np.diff(size_) > widest)
            group = np.cumsum(fresh) - 1
            starts = np.flatnonzero(fresh)
            meets = np.bincount(group[(packed & 1) == 0], minlength=len(starts)) > 0
            centre = node[starts][group] if len(node) else node
            found = np.unique(np.stack((node, centre))[:, meets[group] & (node != centre)], axis=1) if len(node) else np.zeros((2, 0), np.int64)
            if len(node) and not last:
                if meets[-1]:
                    packed, node = packed[-1:] & ~1, centre[-1:]
                else:
                    packed, node = packed[starts[-1] :], node[starts[-1] :]
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

        for b in batches:
            packed = np.concatenate((packed, b.column(0).to_numpy()))
            node = np.concatenate((node, b.column(1).to_numpy()))
            yield pairs(False)
        yield pairs(True)

    rows = docs.select(F.col(text)).mapInArrow(first_ngrams, "packed bigint, node bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, F.shiftrightunsigned("packed", 16)).sortWithinPartitions("packed", "node")
    return rows.mapInArrow(meet, "a bigint, b bigint").distinct()


def join_blocks(sets: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) within each `task` of rows (task, node, text)."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nodes, grams = None, [], []

        def links() -> pa.RecordBatch:
            found = tree_links(grams, num, den)
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], ["a", "b"])

        for b in batches:
            data, offsets = utf8(b.column(2))
            tasks, wanted = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, last in units(offsets, UNIT):
                for k, s in enumerate(ngram_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], size), first):
                    if tasks[k] != task:
                        yield links()
                        task, nodes, grams = tasks[k], [], []
                    if len(s) and class_of(s) == wanted[k] and (not nodes or nodes[-1] != wanted[k]):
                        nodes.append(wanted[k])
                        grams.append(s)
        yield links()

    return sets.select("task", "node", "text").repartition(parts, "task").sortWithinPartitions("task", "node").mapInArrow(run, "a bigint, b bigint")


def thinned(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(node, centre) of those rows (task, node, centre, root, n, counts) that may link with one of their task that has another root."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def left() -> pa.RecordBatch:
            keep = np.zeros(len(held), bool)
            if len(held) > 1:
                keep = near_by_counts(np.array([h[3] for h in held]), [h[4] for h in held], np.array([h[2] for h in held]), num, den)
            kept = [h for h, ok in zip(held, keep, strict=True) if ok]
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in kept], pa.int64()), pa.array([h[1] for h in kept], pa.int64())], ["node", "centre"])

        for b in batches:
            out = []
            for at, *row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if at != task:
                    out.append(left())
                    task, held = at, []
                if not held or held[-1][0] != row[0]:
                    held.append(row)
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()
        yield left()

    rows = rows.select("task", "node", "centre", "root", "n", "counts").repartition(parts, "task").sortWithinPartitions("task", "node")
    return rows.mapInArrow(run, "node bigint, centre bigint")


def task(*columns: str) -> Column:
    return F.xxhash64(*columns).alias("task")


def all_against_outside(known: DataFrame, large: DataFrame, keep: workspace.Tables) -> DataFrame:
    """(task, node, centre, root) of blocks (node, centre, root, elsewhere) in several components: all sets outside the largest one meet all others.

    Blocks that were whole in one task have been compared and do not come again; `large` lists those that were not.
    """
    counts = known.groupBy("centre", "root").agg(F.count("*").alias("n"), F.max("elsewhere").alias("elsewhere"))
    top = counts.groupBy("centre").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"), F.sum("n").alias("held"), F.max("elsewhere").alias("elsewhere"))
    top = top.join(large.select("centre", F.lit(True).alias("large")), "centre", "left").filter("roots > 1 AND (elsewhere OR large)")
    top = keep.written(top.select("centre", F.col("top.root").alias("largest"), F.ceil(F.col("held") / BLOCK).cast("int").alias("shards"), F.ceil((F.col("held") - F.col("top.n")) / BLOCK).cast("int").alias("outer")), "top")
    shard = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    rest = known.select("node", "centre", "root").join(top, "centre").withColumn("shard", shard)
    inside = rest.select("node", "centre", "root", "shard", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("x"))
    own = F.pmod(F.xxhash64("node", F.lit("outer")), F.col("outer")).cast("int")
    outside = rest.filter((F.col("root") != F.col("largest")) & (F.col("shards") > 1)).select("node", "centre", "root", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), own.alias("x"))
    return inside.unionByName(outside).select(task("centre", "shard", "x"), "node", "centre", "root")


def links(docs: DataFrame, kinds: DataFrame, pairs: DataFrame, size: int, num: int, den: int, key: str, text: str, keep: workspace.Tables) -> DataFrame:
    """Links (a, b) between classes that meet, enough for the components of all links."""
    centres = pairs.select(F.col("b").alias("node"), F.col("b").alias("centre")).distinct()
    stars = keep.written(pairs.select(F.col("a").alias("node"), F.col("b").alias("centre")).unionByName(centres), "stars")
    counts = kinds.select("node", "n", "counts")
    wide = keep.written(stars.groupBy("centre").agg(F.count("*").alias("held")).filter(F.col("held") > BLOCK), "wide")
    small = stars.join(wide, "centre", "left_anti").join(counts, "node")
    near = thinned(small.select(task("centre"), "node", "centre", F.col("node").alias("root"), "n", "counts"), num, den)
    blocks = keep.written(near.unionByName(stars.join(wide, "centre", "left_semi").select("node", "centre")), "blocks")
    # one text stands for its class, and is kept once, however many blocks it is in
    wanted = kinds.join(blocks.select("node").distinct(), "node").select("node", "sample")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    same = wanted["sample.key"].eqNullSafe(texts["key"]) & (wanted["sample.text_digest"] == F.xxhash64(texts["text"]))
    sets = keep.written(texts.join(wanted, same).select("node", "text"), "sets")

    # first every class in one block only, its smallest; large ones in shards that share pivots, some of their sets drawn by a hash
    once = keep.written(blocks.groupBy("node").agg(F.min("centre").alias("centre")), "once")
    large = keep.written(once.groupBy("centre").agg(F.count("*").alias("held")).filter(F.col("held") > BLOCK), "large")
    shard = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    placed = once.join(large, "centre", "left").withColumn("shards", F.coalesce(F.ceil(F.col("held") / BLOCK), F.lit(1)).cast("int")).withColumn("shard", shard)
    draw = F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(1 << 30)) / float(1 << 30)
    pivots = placed.filter((F.col("shards") > 1) & (draw < PIVOTS / F.col("held"))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    rows = placed.select(task("centre", "shard"), "node").unionByName(pivots.select(task("centre", "shard"), "node"))
    found = keep.written(join_blocks(rows.join(sets, "node"), size, num, den), "links")

    # then the blocks that are still in several components: by their counts, and what may link by its n-grams
    roots = connected_components(found)
    known = blocks.join(once.withColumnRenamed("centre", "at"), "node").join(roots, "node", "left")
    known = keep.written(known.select("node", "centre", F.coalesce("component", "node").alias("root"), (F.col("at") != F.col("centre")).alias("elsewhere")), "roots")
    apart = thinned(all_against_outside(known, large, keep).join(counts, "node"), num, den).distinct()
    still = keep.written(known.join(apart, ["node", "centre"]), "apart")
    again = all_against_outside(still.withColumn("elsewhere", F.lit(True)), large, keep).select("task", "node")
    return found.unionByName(join_blocks(again.join(sets, "node"), size, num, den))


def jaccard_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links of den * overlap >= num * union): one row a document."""
    with workspace.Tables(docs.sparkSession) as keep:
        members = workspace.written(classes(docs, size, key, text), "members")
        pairs = keep.written(candidates(docs, sketch_levels(members), size, num, den, text), "candidates")
        # a class once, whatever the number of its copies: what follows is dealt by class, and only the last join meets all rows
        sample = F.struct(F.col(key).alias("key"), "text_digest")
        kinds = keep.written(members.filter("node IS NOT NULL").groupBy("node").agg(F.min(key).alias("first"), F.min(sample).alias("sample"), F.first("n_shingles").alias("n"), F.first("counts").alias("counts")), "classes")
        rooted = keep.written(kinds.select("node", "first").join(connected_components(links(docs, kinds, pairs, size, num, den, key, text, keep)), "node"), "rooted")
        least = keep.written(rooted.groupBy("component").agg(F.min("first").alias("least")), "least")
        found = rooted.join(least, "component").select("node", "least").unionByName(kinds.join(rooted.select("node"), "node", "left_anti").select("node", F.col("first").alias("least")))
        found = workspace.written(found, "found")
    rows = members.filter("piece IS NULL").select(F.col(key), "n_shingles", "node")
    return rows.join(found, "node", "left").select(F.col(key), "n_shingles", F.coalesce("least", F.col(key)).alias("component_id"))
