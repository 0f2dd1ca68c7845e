"""Logins seen on the wire as observations: attempts of clients, refusals of servers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netlume.parse import auth

ENDS = ("src", "dst", "src_port", "dst_port")


def logins(segments: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, src, dst, dst_port, service and kind (attempt or refusal) of segments (src, dst, src_port, dst_port, direction, payload).

    src and dst of the result are client and server: a refusal travels to the client, so its ends are swapped.
    """
    kinds = dict(segments.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, services, names = [], [], []
            for k, (port, down, data) in enumerate(zip(*(b.column(len(keep) + 3 + n).to_pylist() for n in range(3)), strict=True)):
                if data is None or port is None:
                    continue
                found = [(s, "refusal") for s in auth.refusals(data, port)] if down else []
                if one := auth.attempt(data, port):
                    found.append((one, "attempt"))
                at += [k] * len(found)
                services += [s for s, _ in found]
                names += [n for _, n in found]
            place = pa.array(at, pa.int64())
            # an attempt is the sender's, whatever the direction; its ends were put in order before
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(place) for k in range(len(keep) + 3)), pa.array(services, pa.string()), pa.array(names, pa.string())], [*keep, "src", "dst", "dst_port", "service", "kind"])

    down = F.col("direction") == "to_client"
    client, server, port = F.when(down, F.col("dst")).otherwise(F.col("src")), F.when(down, F.col("src")).otherwise(F.col("dst")), F.when(down, F.col("src_port")).otherwise(F.col("dst_port")).cast("int")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keep, "src", "dst"]) + ", dst_port int, service string, kind string"
    rows = segments.select(*keep, client.alias("src"), server.alias("dst"), port.alias("dst_port"), port.alias("gate"), down.alias("down"), F.col("payload").cast("binary").alias("payload"))
    return rows.mapInArrow(run, schema)
