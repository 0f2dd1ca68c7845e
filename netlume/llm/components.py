"""Connected components of a graph of bigint nodes, by contraction; nothing but one count a round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import workspace


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); the component is its smallest node.

    Each round every node moves to its smallest neighbour, and on with it where that one moves too; edges are rewritten
    and loops dropped, so at least half of the nodes that still have edges vanish.  The moves of all rounds are then
    applied one after the other.
    """
    spark = edges.sparkSession
    with workspace.Tables(spark) as keep:
        left = keep.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        moves: list[DataFrame] = []
        while not left.isEmpty():
            # of the larger end's neighbours only the smaller ones matter; a smallest end stays where it is
            move = keep.written(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")), "moves")
            while not (further := move.join(move.select(F.col("node").alias("to"), F.col("to").alias("next")), "to")).isEmpty():
                stay = move.join(further.select("node"), "node", "left_anti")
                move = keep.written(further.select("node", F.col("next").alias("to")).unionByName(stay), "moves")
            moves.append(move)
            moved = left.join(move.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("x"), F.col("b").alias("y")).filter("x <> y").distinct()
            moved = moved.join(move.select(F.col("node").alias("y"), F.col("to").alias("z")), "y", "left").select("x", F.coalesce("z", "y").alias("y")).filter("x <> y")
            left = keep.written(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        if not moves:
            return spark.createDataFrame([], "node bigint, component bigint")
        out = moves[-1].select("node", F.col("to").alias("component"))
        for move in reversed(moves[:-1]):
            follow = move.join(out.select(F.col("node").alias("to"), "component"), "to", "left").select("node", F.coalesce("component", "to").alias("component"))
            out = follow.unionByName(out.join(move.select("node"), "node", "left_anti"))
        found = workspace.written(out, "components")
    # a component's smallest node has no move of its own
    roots = found.select(F.col("component").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
    return found.unionByName(roots.select("node", F.col("node").alias("component")))
