"""Sliding-window primitives over keyed rows with integer seconds.

Rows have a total order of (second, sequence).  A row sees earlier rows of its own second but not later ones, so each
sliding value joins two frames: whole earlier seconds of the window, and the rows before it in its own second.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F


def _frames(keys: list[str], sec: str, seq: str, width: int):
    earlier = Window.partitionBy(*keys).orderBy(sec).rangeBetween(-(width - 1), -1)
    same = Window.partitionBy(*keys, sec).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return earlier, same


def rate(keys: list[str], value: Column, width: int, sec: str = "ts_sec", seq: str = "seq") -> Column:
    """Sum of a value over the last `width` seconds, this row included."""
    earlier, same = _frames(keys, sec, seq, width)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0)) + F.sum(value).over(same)


def distinct(keys: list[str], value: Column, width: int, sec: str = "ts_sec", seq: str = "seq") -> Column:
    """Number of different values seen in the last `width` seconds, this row included."""
    earlier, same = _frames(keys, sec, seq, width)
    return F.size(F.array_union(F.collect_set(value).over(earlier), F.collect_set(value).over(same))).cast("bigint")


def running(df: DataFrame, keys: list[str], amounts: dict[str, tuple[Column, Column, int]], sec: str = "ts_sec", seq: str = "seq") -> DataFrame:
    """Adds sliding sums as running ones: each amount (what a row adds, what is taken off again, seconds until then).

    Every row becomes its own beginning and one end for each number of seconds, so a window costs the same however many
    rows it holds; amounts must be whole numbers.  The input's columns travel in a struct, so their names cannot clash.
    """
    widths = sorted({w for _, _, w in amounts.values()})
    zero = F.lit(0).cast("bigint")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    event = lambda at, kind, place, held, parts: F.struct(at.cast("bigint").alias("at"), F.lit(kind).alias("kind"), place.alias("place"), held.alias("held"), *[x.alias(f"a{k}") for k, x in enumerate(parts)])
    add = [F.coalesce(a.cast("bigint"), zero) for a, _, _ in amounts.values()]
    events = [event(F.col(sec), 1, F.col(seq), row, add)]
    for width in widths:
        off = [-F.coalesce(o.cast("bigint"), zero) if w == width else zero for _, o, w in amounts.values()]
        events.append(event(F.col(sec) + width, 0, F.lit(None).cast(df.schema[seq].dataType), F.when(F.lit(False), row), off))
    names = [f"k{k}" for k in range(len(keys))]
    flat = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.explode(F.array(*events)).alias("e")).select(*names, "e.*")
    # ends of a second come before its rows
    w = Window.partitionBy(*names).orderBy("at", "kind", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(f"a{k}").over(w).alias(f"s{k}") for k in range(len(amounts))]
    done = flat.select("kind", "held", *sums).filter("kind = 1")
    return done.select("held.*", *[F.col(f"s{k}").alias(name) for k, name in enumerate(amounts)])


def with_rates(df: DataFrame, keys: list[str], values: dict[str, Column], width: int, sec: str = "ts_sec", seq: str = "seq") -> DataFrame:
    """As rate(), for whole numbers and windows of many rows: adds a sum for each value; a null adds nothing."""
    return running(df, keys, {name: (v, v, width) for name, v in values.items()}, sec, seq)


def distinct_by_intervals(df: DataFrame, keys: list[str], value: str, width: int, sec: str = "ts_sec", seq: str = "seq", name: str = "n_distinct") -> DataFrame:
    """As distinct(), for windows with very many values: adds a count without gathering a set.

    A sighting counts until the value is seen again or `width` seconds have gone, so its beginnings and ends are a
    running sum.  One shuffle by the keys serves both steps.
    """
    by_value = Window.partitionBy(*keys, value).orderBy(sec, seq)
    seen, before, after = F.col(value).isNotNull(), F.col(sec) - F.lag(sec).over(by_value), F.lead(sec).over(by_value) - F.col(sec)
    marked = df.repartition(*keys).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(k).alias(f"k{k_}") for k_, k in enumerate(keys)], F.col(sec).alias("sec"), F.col(seq).alias("seq"), (seen & (F.coalesce(before, F.lit(width)) >= width)).alias("fresh"), (seen & (F.coalesce(after, F.lit(width)) >= width)).alias("gone"))
    counted = running(marked, [f"k{k}" for k in range(len(keys))], {"n": (F.col("fresh").cast("bigint"), F.col("gone").cast("bigint"), width)}, "sec", "seq")
    return counted.select("row.*", F.col("n").alias(name))


def key_changes(columns: list[pa.Array], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where a key differs from the row before it, and the last key; nulls and NaN are keys like others."""
    n = len(columns[0]) if columns else 0
    fresh = np.zeros(n, bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        same = pc.fill_null(pc.equal(a, b), False)
        both = pc.and_(a.is_null(nan_is_null=True), b.is_null(nan_is_null=True))
        fresh[1:] |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
    end = tuple(c[n - 1].as_py() for c in columns)
    first = tuple(c[0].as_py() for c in columns)
    fresh[0] = last is None or any(x != y and not (x != x and y != y) for x, y in zip(first, last, strict=True))
    return fresh, end


def fold_in_order(df: DataFrame, keys: list[str], order: list[str], added: str, fold: Callable[[], Callable]) -> DataFrame:
    """Adds columns (`added`, a schema) that depend on a key's earlier rows.

    `fold()` is called once a task and gives a function of a batch's order columns, as Arrow arrays, and of the places
    where a new key begins; it returns the new columns and keeps its own state.  Rows stream through one task a key, sorted
    by the shuffle, and pass as they are: only the state is held, however many rows a key has.
    """
    kept, names = df.columns, [x.split()[0] for x in added.split(",")]
    if set(names) & set(kept):
        raise ValueError(f"the table already has {sorted(set(names) & set(kept))}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, last = fold(), () if not keys else None
        for b in batches:
            if not b.num_rows:
                continue
            if keys:
                fresh, last = key_changes([b.column(len(kept) + k) for k in range(len(keys))], last)
            else:
                fresh, last = np.arange(b.num_rows) == (0 if last == () else -1), None
            made = step([b.column(len(kept) + len(keys) + k) for k in range(len(order))], fresh)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *made], [*kept, *names])

    rows = df.repartition(*keys) if keys else df.coalesce(1)
    rows = rows.sortWithinPartitions(*keys, *order)
    return rows.select(*[F.col(f"`{c}`") for c in kept], *[F.col(c).alias(f"_{k}") for k, c in enumerate([*keys, *order])]).mapInArrow(run, _schema(df, added))


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *more])


def _anchors(given: int | None) -> Callable[[], Callable]:
    """Goes from anchor to anchor by binary search: a batch costs its anchors, not its rows.  Without a span the third order column has each key's."""

    def fold():
        anchor, since, before = None, 0, 0  # rows from the anchor on so far, and of the window before, less its anchor

        def step(order: list[pa.Array], fresh: np.ndarray):
            nonlocal anchor, since, before
            n = len(fresh)
            secs, spans = order[0].to_pylist(), None if given is not None else order[2].to_pylist()
            at, first = np.zeros(n, np.int64), np.zeros(n, bool)
            place, held = np.zeros(n, np.int64), np.zeros(n, np.int64)
            bounds = [*np.flatnonzero(fresh).tolist(), n]
            if bounds[0] != 0:
                bounds.insert(0, 0)
            for start, end in zip(bounds[:-1], bounds[1:], strict=True):
                if fresh[start]:
                    anchor, since, before = None, 0, 0
                i, span = start, given if spans is None else spans[start]
                while i < end and secs[i] is None:  # sorted first; such rows anchor nothing
                    i += 1
                while i < end:
                    if anchor is None or secs[i] - anchor >= span:
                        before = max(since - 1, 0)
                        anchor, since, first[i] = secs[i], 0, True
                    j = bisect_left(secs, anchor + span, i, end)
                    at[i:j], held[i:j] = anchor, before
                    place[i:j] = np.arange(since + 1, since + 1 + j - i)
                    since += j - i
                    i = j
            valid = np.array([s is None for s in secs]) if order[0].null_count else None
            return [pa.array(at, pa.int64(), mask=valid), pa.array(first), pa.array(place, pa.int64(), mask=valid), pa.array(held, pa.int64(), mask=valid)]

        return step

    return fold


def anchor_windows(df: DataFrame, keys: list[str], span: int | str, sec: str = "ts_sec", seq: str = "seq") -> DataFrame:
    """Adds anchor_sec, is_anchor, anchor_place (a row's number in its window, from 1) and anchor_held (rows after the anchor in the window before).

    The first row anchors a window, and then the first row `span` seconds or more after an anchor.  This one fold is the
    alert gate, the tumbling window of rate control and the suppression of repeated alerts.  Rows without a second are in
    no window.  A span may be the name of a column that is the same for all rows of a key.
    """
    own = isinstance(span, str)
    return fold_in_order(df, keys, [sec, seq, *([span] if own else [])], "anchor_sec bigint, is_anchor boolean, anchor_place bigint, anchor_held bigint", _anchors(None if own else span))


def greedy_anchors(df: DataFrame, keys: list[str], span: int, sec: str = "ts_sec", seq: str = "seq") -> DataFrame:
    """Adds anchor_sec and is_anchor."""
    return anchor_windows(df, keys, span, sec, seq).drop("anchor_place", "anchor_held")


def gate(df: DataFrame, keys: list[str], span: int, sec: str = "ts_sec", seq: str = "seq") -> DataFrame:
    """Only the rows that pass: none of the key passed in the `span` seconds before.  Columns may have any name."""
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(k).alias(f"k{n}") for n, k in enumerate([*keys, sec, seq])])
    names = [f"k{n}" for n in range(len(keys) + 2)]
    return anchor_windows(row, names[:-2], span, *names[-2:]).filter("is_anchor").select("row.*")


def idle_sessions(df: DataFrame, keys: list[str], idle: int, sec: str = "ts_sec", seq: str = "seq", name: str = "session") -> DataFrame:
    """Numbers each key's sessions: a gap of `idle` seconds or more begins a new one."""
    w = Window.partitionBy(*keys).orderBy(sec, seq)
    fresh = F.when(F.col(sec) - F.lag(sec).over(w) >= idle, 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_fresh")


def periodicity(df: DataFrame, keys: list[str], sec: str = "ts_sec", ring: int = 8, least: int = 6) -> DataFrame:
    """keys, sec, n_gaps, gap_mean, gap_cv over the last `ring` gaps between different seconds, where there are `least`."""
    w = Window.partitionBy(*keys).orderBy(sec)
    gaps = df.select(*keys, sec).distinct().withColumn("_gap", F.col(sec) - F.lag(sec).over(w))
    last = w.rowsBetween(-(ring - 1), Window.currentRow)
    out = gaps.select(*keys, sec, F.count("_gap").over(last).alias("n_gaps"), F.avg("_gap").over(last).alias("gap_mean"), F.stddev_pop("_gap").over(last).alias("_dev"))
    return out.filter(F.col("n_gaps") >= least).withColumn("gap_cv", F.col("_dev") / F.col("gap_mean")).drop("_dev")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of a string; give bytes as ISO-8859-1 text.

    Letters are sorted, so equal ones are runs; a run of n ends where the next letter differs.
    """
    letters = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(letters).cast("double")
    state = F.struct(F.lit(0.0).alias("bits"), F.lit(0).alias("run"), F.lit("").alias("of"))
    bits = lambda s: s["bits"] + F.when(s["run"] > 0, s["run"] / n * F.log2(n / s["run"])).otherwise(0.0)
    step = lambda s, c: F.struct(F.when(s["of"] == c, s["bits"]).otherwise(bits(s)).alias("bits"), F.when(s["of"] == c, s["run"] + 1).otherwise(1).alias("run"), c.alias("of"))
    return F.aggregate(letters, state, step, bits)
