"""Stateful streaming forms of the folds: gates, threshold windows, sliding windows, sessions and cross-connection bits.

Rows of a micro-batch are taken in the total order of (second, sequence).  Where `event` names a timestamp column with a
watermark, three things follow: rows later than the watermark are dropped by Spark before they arrive; a key's state goes
once the watermark has passed the second from which it cannot matter any more; and with `hold` a row waits until the
watermark has passed it, so that rows are taken in order across micro-batches too.  Without `event` rows are taken as they
come and state stays.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _ordered(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")


def fold_stream(
    df: DataFrame, keys: list[str], order: list[str], state: str, step: Callable, more: str, columns: list[str], matters_until: Callable[[tuple], int | None] | None = None, event: str | None = None, hold: bool = False
) -> DataFrame:
    """Adds to each row what step(state tuple or None, order values) returns after the new state.

    The first order column is the second.  `matters_until(state)` is the second from which on the state is as good as none.
    """
    if hold and event is None:
        raise ValueError("rows can only be held until a watermark passes them")
    kinds = dict(df.dtypes)
    names = df.columns
    # whole numbers travel as text: beside a null they would become floating
    wide = [c for c in names if kinds[c] == "bigint"]
    places = [f"_o{k}" for k in range(len(order))]
    sent = df.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], *[F.col(c).alias(p) for c, p in zip(order, places, strict=True)], *[F.col(f"`{c}`").cast("string").alias(c) if c in wide else F.col(f"`{c}`") for c in names])
    schema = ", ".join(f"`{c}` {'string' if c in wide else kinds[c]}" for c in names) + f", {more}"
    size = len(state.split(","))

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        *now, waiting = held.get if held.exists else (*[None] * size, None)
        now = tuple(now) if held.exists and now[0] is not None else None
        rows = pickle.loads(waiting) if waiting else None
        mark = held.getCurrentWatermarkMs() if event is not None else None
        if not held.hasTimedOut:
            fresh = _ordered(batches, places)
            rows = fresh if rows is None else pd.concat([rows, fresh], ignore_index=True).sort_values(places, kind="stable")
        if rows is None:
            rows = pd.DataFrame(columns=[*places, *names])
        ready = rows[rows[places[0]] * 1000 <= mark] if hold else rows
        rest = rows[rows[places[0]] * 1000 > mark] if hold else rows.iloc[:0]
        made = []
        for row in ready[places].itertuples(index=False):
            now, *out = step(now, row)
            made.append(out)
        until = matters_until(now) if matters_until is not None and now is not None else None
        gone = event is not None and until is not None and until * 1000 <= mark
        if (now is None or gone) and not len(rest):
            held.remove()
        else:
            held.update((*(now if now is not None and not gone else [None] * size), pickle.dumps(rest) if len(rest) else None))
            if event is not None:
                wake = [int(rest[places[0]].min()) * 1000] if len(rest) else [until * 1000] if until is not None else []
                if wake:
                    held.setTimeoutTimestamp(max(wake[0], mark + 1))
        if len(ready):
            out = ready[names].copy()
            for k, c in enumerate(columns):
                out[c] = [m[k] for m in made]
            yield out

    timeout = GroupStateTimeout.EventTimeTimeout if event is not None else GroupStateTimeout.NoTimeout
    # sliding windows keep what is in them; `state` columns may be null while rows only wait
    folded = sent.groupBy(*[f"_k{n}" for n in range(len(keys))]).applyInPandasWithState(run, schema, f"{state}, _waiting binary", "append", timeout)
    return folded.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if c in wide else F.col(f"`{c}`") for c in names], *columns)


def gate_stream(df: DataFrame, keys: list[str], span: int, sec: str = "ts_sec", seq: str = "seq", event: str | None = None, hold: bool = False) -> DataFrame:
    """The rows that pass a gate; equal to windows.gate() over the same rows in order."""

    def step(state, row):
        now = int(row[0])
        return ((now,), True) if state is None or now - state[0] >= span else (state, False)

    return fold_stream(df, keys, [sec, seq], "anchor bigint", step, "_passes boolean", ["_passes"], lambda s: s[0] + span, event, hold).filter("_passes").drop("_passes")


def threshold_stream(df: DataFrame, keys: list[str], kind: str, count: int, seconds: int, sec: str = "ts_sec", seq: str = "seq", event: str | None = None, hold: bool = False) -> DataFrame:
    """Rate control as control.threshold()."""
    keep = {"limit": lambda n: n <= count, "threshold": lambda n: n % count == 0, "both": lambda n: n == count, "detection_filter": lambda n: n > count}[kind]

    def step(state, row):
        now = int(row[0])
        anchor, n = state if state is not None and now - state[0] < seconds else (now, 0)
        return (anchor, n + 1), keep(n + 1)

    return fold_stream(df, keys, [sec, seq], "anchor bigint, n bigint", step, "_kept boolean", ["_kept"], lambda s: s[0] + seconds, event, hold).filter("_kept").drop("_kept")


def bits_stream(df: DataFrame, keys: list[str], ttl: int, sec: str = "ts_sec", seq: str = "seq", op: str = "xbit_op", event: str | None = None, hold: bool = False) -> DataFrame:
    """Cross-connection bits as control.cross_bits()."""

    def step(state, row):
        now, verb = int(row[0]), row[2]
        until = state[0] if state is not None else -1
        live = until > now
        if verb == "set" or (verb == "toggle" and not live):
            return (now + ttl,), True
        if verb in ("unset", "toggle"):
            return (-1,), True
        return (until,), verb is None or live == (verb == "isset")

    return fold_stream(df, keys, [sec, seq, op], "until bigint", step, "_kept boolean", ["_kept"], lambda s: max(s[0], 0), event, hold).filter("_kept").drop("_kept")


def rate_stream(df: DataFrame, keys: list[str], amount: str, width: int, name: str = "total", sec: str = "ts_sec", seq: str = "seq", event: str | None = None, hold: bool = False) -> DataFrame:
    """Adds the sum of a whole number over the last `width` seconds, as windows.with_rates(); state is one sum for each second of the window."""

    def step(state, row):
        now, value = int(row[0]), int(row[2]) if row[2] is not None and row[2] == row[2] else 0
        secs, sums = (list(state[0]), list(state[1])) if state is not None else ([], [])
        while secs and secs[0] <= now - width:
            secs.pop(0)
            sums.pop(0)
        if secs and secs[-1] == now:
            sums[-1] += value
        else:
            secs.append(now)
            sums.append(value)
        return (secs, sums), sum(sums)

    return fold_stream(df, keys, [sec, seq, amount], "secs array<bigint>, sums array<bigint>", step, f"{name} bigint", [name], lambda s: s[0][-1] + width, event, hold)


def distinct_stream(df: DataFrame, keys: list[str], value: str, width: int, name: str = "n_distinct", sec: str = "ts_sec", seq: str = "seq", event: str | None = None, hold: bool = False) -> DataFrame:
    """Adds the number of different values of the last `width` seconds, as windows.distinct_by_intervals(); state is a second for each value of the window."""

    def step(state, row):
        now, seen = int(row[0]), row[2]
        held = dict(zip(state[0], state[1], strict=True)) if state is not None else {}
        held = {v: s for v, s in held.items() if s > now - width}
        if seen is not None and seen == seen:
            held[str(seen)] = now
        return (list(held), list(held.values())), len(held)

    text = df.withColumn("_value", F.col(value).cast("string"))
    return fold_stream(text, keys, [sec, seq, "_value"], "vals array<string>, secs array<bigint>", step, f"{name} bigint", [name], lambda s: max(s[1], default=0) + width, event, hold).drop("_value")


def sessions_stream(df: DataFrame, keys: list[str], idle: int, sec: str = "ts_sec", seq: str = "seq", event: str | None = None, hold: bool = False) -> DataFrame:
    """Adds session_start: the second of the first row of the session; a gap of `idle` seconds or more begins a new one."""

    def step(state, row):
        now = int(row[0])
        start = state[1] if state is not None and now - state[0] < idle else now
        return (now, start), start

    return fold_stream(df, keys, [sec, seq], "last bigint, start bigint", step, "session_start bigint", ["session_start"], lambda s: s[0] + idle, event, hold)


def scan_stream(df: DataFrame, keys: list[str], literals: list[bytes], idle: int, payload: str = "payload", sec: str = "ts_sec", seq: str = "seq", event: str | None = None, hold: bool = False) -> DataFrame:
    """Adds found: the literals that a segment completes for the first time in its stream, as matcher.scan_streams().

    State is the literals seen and as many bytes as the longest literal less one, so every byte is read once; a stream that
    is quiet for `idle` seconds begins anew.
    """
    most, names = max(map(len, literals)) - 1, [x.decode("latin-1") for x in literals]

    def step(state, row):
        now, data = int(row[0]), bytes(row[2]) if row[2] is not None else b""
        last, tail, seen = state if state is not None and now - state[0] < idle else (now, b"", [])
        text = (bytes(tail) + data).decode("latin-1")
        fresh = [x for x in names if x not in seen and x in text]
        kept = text[len(text) - most :] if most and len(text) > most else text if most else ""
        return (now, kept.encode("latin-1"), [*seen, *fresh]), fresh

    return fold_stream(df, keys, [sec, seq, payload], "last bigint, tail binary, seen array<string>", step, "found array<string>", ["found"], lambda s: s[0] + idle, event, hold)


def run_once(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what there is and returns the rows; for tests and catch-up."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
