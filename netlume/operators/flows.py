"""Flows: packets or messages of two endpoints as sessions, their counters, and their bytes put together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import windows

FIN, SYN, RST, ACK = 1, 2, 4, 16
IDLE, UNANSWERED = 300, 10
#: Letters of a flow record's flags, in the record's order.
FLAG_LETTERS = ((SYN, "S"), (ACK, "A"), (FIN, "F"), (RST, "R"), (8, "P"), (32, "U"))


def canonical(packets: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Adds lo and hi, the endpoints in order, so that both directions share a key."""
    return packets.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))


def sessions(packets: DataFrame, keys: list[str], idle: int = 300) -> DataFrame:
    """Numbers the sessions of each key; `idle` seconds without a packet end one."""
    return windows.idle_sessions(packets, keys, idle, name="session")


def tcp_sessions(packets: DataFrame, keys: list[str], idle: int = IDLE, unanswered: int = UNANSWERED) -> DataFrame:
    """Adds session, is_client and closes to TCP packets (ts_sec, seq, src, src_port, tcp_flags, payload_len).

    `keys` are the canonical ends.  A reset or a FIN of either side ends a session with that packet; `idle` seconds
    without one, or `unanswered` while the far end never spoke, end it before the next.  An empty segment without SYN, FIN
    or RST begins none: such a packet has no session.
    """

    def fold():
        client = last = None
        answered, fins, number = False, set(), 0

        def step(order: list[pa.Array], fresh: np.ndarray):
            nonlocal client, last, answered, number
            session, own, ends = [], [], []
            new = fresh.tolist()
            for k, (sec, _, src, port, flags, size) in enumerate(zip(*(c.to_pylist() for c in order), strict=True)):
                if new[k]:
                    client, number = None, 0
                if client is not None and sec - last >= (idle if answered else unanswered):
                    client = None
                flags, size = flags or 0, size or 0
                if client is None:
                    if not flags & (SYN | FIN | RST) and not size:
                        session.append(None)
                        own.append(None)
                        ends.append(False)
                        continue
                    client, answered, number = (src, port), False, number + 1
                    fins.clear()
                mine = (src, port) == client
                answered, last = answered or not mine, sec
                if flags & FIN:
                    fins.add(mine)
                done = bool(flags & RST) or len(fins) == 2
                session.append(number - 1)
                own.append(mine)
                ends.append(done)
                if done:
                    client = None
            return [pa.array(session, pa.int64()), pa.array(own, pa.bool_()), pa.array(ends, pa.bool_())]

        return step

    return windows.fold_in_order(packets, keys, ["ts_sec", "seq", "src", "src_port", "tcp_flags", "payload_len"], "session bigint, is_client boolean, closes boolean", fold)


def stream_sizes(packets: DataFrame, keys: list[str], size: str = "payload_len", sec: str = "ts_sec", seq: str = "seq") -> DataFrame:
    """Adds client_bytes and server_bytes: what either side of a session (is_client) has sent so far, this packet included."""
    w = Window.partitionBy(*keys).orderBy(sec, seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col(size))).over(w), F.lit(0)).cast("bigint")
    return packets.withColumns({"client_bytes": total(F.col("is_client")), "server_bytes": total(~F.col("is_client"))})


def first_seen(columns: list[str], sec: str = "ts_sec", seq: str = "seq") -> list[Column]:
    """Aggregates: the first value of each column that is not null."""
    return [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(sec, seq))).alias(c) for c in columns]


def flag_letters(flags: Column) -> Column:
    return F.concat(*[F.when(flags.bitwiseAND(F.lit(bit)) != 0, letter).otherwise("") for bit, letter in FLAG_LETTERS])


METADATA = ["http_host", "http_uri", "tls_sni", "tls_ja3", "auth_user", "rpc_interface", "file_md5", "file_sha256", "file_type", "file_size", "ssh_version"]


def tcp_flow_log(packets: DataFrame, keys: list[str], until: Column | None = None) -> DataFrame:
    """A record for each session of tcp_sessions(): ends, counters, state, first metadata where the columns are there, alerts.

    A session that did not close is `timeout` if a limit had passed at `until` (a second; null: none has), else `open`.
    """
    rows = packets.filter("session IS NOT NULL")
    out, back = F.col("is_client"), ~F.col("is_client")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("bigint")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("frame_len"))), F.lit(0)).cast("bigint")
    flags = lambda c: F.coalesce(F.bit_or(F.when(c, F.col("tcp_flags").cast("bigint"))), F.lit(0)).cast("bigint")
    begin = F.struct("ts_sec", "seq")
    held = [c for c in METADATA if c in packets.columns]
    alerts = F.coalesce(F.sum("alerts"), F.lit(0)).cast("bigint") if "alerts" in packets.columns else F.lit(0).cast("bigint")
    ends = [F.min_by(c, begin).alias(c) for c in ("src", "src_port", "dst", "dst_port") + (("vlan_id",) if "vlan_id" in packets.columns else ())]
    names = [f"_k{k}" for k in range(len(keys))]
    records = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "session").agg(
        *ends, F.min("ts_sec").alias("start_sec"), F.max("ts_sec").alias("end_sec"), count(out).alias("pkts_to_server"), count(back).alias("pkts_to_client"), total(out).alias("bytes_to_server"), total(back).alias("bytes_to_client"),
        flags(out).alias("flags_to_server"), flags(back).alias("flags_to_client"), *first_seen(held), alerts.alias("alerts"),
    )
    limit = F.when(F.col("pkts_to_client") > 0, IDLE).otherwise(UNANSWERED)
    over = F.lit(False) if until is None else F.coalesce(until - F.col("end_sec") >= limit, F.lit(False))
    state = F.col("state")
    return records.withColumn("state", flow_state("flags_to_server", "flags_to_client")).withColumn("state", F.when((state == "open") & over, "timeout").otherwise(state)).drop(*names)


def flow_records(packets: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each session: who began it, counters of either direction, flags, and its state."""
    first = F.min_by("src", F.struct("ts_sec", "seq"))
    w = Window.partitionBy(*keys, "session").orderBy("ts_sec", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = packets.withColumn("_client", F.first("src").over(w))
    out, back = F.col("src") == F.col("_client"), F.col("src") != F.col("_client")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    total = lambda c: F.sum(F.when(c, F.col("frame_len")).otherwise(0)).cast("bigint")
    flags = lambda c: F.coalesce(F.bit_or(F.when(c, F.col("tcp_flags"))), F.lit(0)).cast("bigint")
    records = rows.groupBy(*keys, "session").agg(
        first.alias("client"), F.min("ts_sec").alias("start_sec"), F.max("ts_sec").alias("end_sec"), count(out).alias("pkts_to_server"), count(back).alias("pkts_to_client"),
        total(out).alias("bytes_to_server"), total(back).alias("bytes_to_client"), flags(out).alias("flags_to_server"), flags(back).alias("flags_to_client"),
    )
    return records.withColumn("state", flow_state("flags_to_server", "flags_to_client"))


def flow_state(to_server: str, to_client: str):
    a, b = F.col(to_server), F.col(to_client)
    both = a.bitwiseOR(b)
    return F.when(both.bitwiseAND(RST) > 0, "reset").when((a.bitwiseAND(FIN) > 0) & (b.bitwiseAND(FIN) > 0), "closed").when(both.bitwiseAND(FIN) > 0, "half_closed").otherwise("open")


def assemble(segments: list[tuple[int, bytes]], first: int | None = None) -> bytes:
    """Bytes of one direction from (sequence number, bytes), in order of arrival.

    What was placed first stays; a later copy only adds what lies beyond it; a gap ends the stream.  Numbers are those of
    TCP: they go on from 2^32 - 1 to 0, and one in the half before another lies before it.
    """
    held: dict[int, bytes] = {}
    base = first if first is not None else next((at for at, data in segments if data), 0)
    for at, data in segments:
        at = (at - base + (1 << 31)) % (1 << 32) - (1 << 31)
        if data and len(held.get(at, b"")) < len(data):
            held[at] = held.get(at, b"") + data[len(held.get(at, b"")) :]
    out, place = bytearray(), 0 if first is not None else min(held, default=0)
    for at in sorted(held):
        if at > place:
            break
        if at + len(held[at]) > place:
            out += held[at][place - at :]
            place = at + len(held[at])
    return bytes(out)


def reassemble(segments: DataFrame, keys: list[str], offset: str = "tcp_seq", data: str = "payload", seq: str = "seq") -> DataFrame:
    """keys and stream: each direction's bytes.  Segments stream by key; a stream's bytes are one cell.

    Numbers of an earlier connection mean nothing in a later one, so keys of real captures hold the session too.
    """
    schema = ", ".join([*(f"`{k}` {dict(segments.dtypes)[k]}" for k in keys), "stream binary"])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, key = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            fresh, last = windows.key_changes([b.column(k) for k in range(n)], last)
            keyed, streams = [], []
            for k, (new, at, part) in enumerate(zip(fresh.tolist(), b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)):
                if new:
                    if key is not None:
                        keyed.append(key)
                        streams.append(assemble(held))
                    key, held = [b.column(c).slice(k, 1) for c in range(n)], []
                if at is not None:
                    held.append((at, part or b""))
            if streams:
                yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([x[c] for x in keyed]) for c in range(n)), pa.array(streams, pa.binary())], [*keys, "stream"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([*key, pa.array([assemble(held)], pa.binary())], [*keys, "stream"])

    return segments.repartition(*keys).sortWithinPartitions(*keys, seq).select(*keys, F.col(offset).cast("bigint"), F.col(data).cast("binary")).mapInArrow(run, schema)


def interim_reports(packets: DataFrame, keys: list[str], every: int = 30) -> DataFrame:
    """Bytes of an open flow, reported at most once in `every` seconds; the last row has what was not yet reported."""
    placed = windows.greedy_anchors(packets.select(*keys, "ts_sec", "seq", "frame_len"), keys, every)
    return placed.groupBy(*keys, "anchor_sec").agg(F.sum("frame_len").cast("bigint").alias("bytes"), F.count("*").alias("packets"))


def is_reply(packets: DataFrame, a: str = "src", b: str = "dst", within: int = 60, extra: tuple[str, ...] = (), sec: str = "ts_sec", seq: str = "seq") -> DataFrame:
    """Adds reply: whether the other endpoint sent one to this one in the `within` seconds before.

    Both directions share a key, so this is one window, no self-join; the caller's columns stay as they are.
    """
    up = F.col(a) == F.least(a, b)
    w = Window.partitionBy(F.least(a, b), F.greatest(a, b), *extra).orderBy(sec, seq).rowsBetween(Window.unboundedPreceding, -1)
    other = F.when(up, F.max(F.when(~up, F.col(sec))).over(w)).otherwise(F.max(F.when(up, F.col(sec))).over(w))
    return packets.withColumn("reply", F.coalesce(F.col(sec) - other < within, F.lit(False)))


def is_attempt(packets: DataFrame, **given) -> DataFrame:
    """Adds attempt: a TCP packet with SYN and no ACK, or a datagram that answers none, to a port other than 0.

    `given` goes to is_reply(); protocol, tcp_flags and dst_port are read.
    """
    flags = F.coalesce(F.col("tcp_flags"), F.lit(0))
    opens = (flags.bitwiseAND(F.lit(SYN)) != 0) & (flags.bitwiseAND(F.lit(ACK)) == 0)
    asks = F.when(F.col("protocol") == 6, opens).when(F.col("protocol") == 17, ~F.col("reply")).otherwise(False)
    return is_reply(packets, **given).withColumn("attempt", F.coalesce(asks & (F.col("dst_port") != 0), F.lit(False))).drop("reply")
