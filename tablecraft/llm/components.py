"""Connected components by repeated random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node that has an edge.

    ``edges`` has long columns ``a`` and ``b``; loops and repeated edges are
    harmless and rows with a null end are ignored. Returns ``node, root``: all
    nodes of a component share one root, itself one of them. No edges give an
    empty result.

    Each round merges every node into the neighbour with the smallest hash of
    the round, so the graph shrinks by a constant factor whatever its shape.
    Neighbour minima combine before the shuffle, so a hub is no hot group, and
    rounds are cut by files in the shared folder.
    """
    ordered = edges.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    edges = materialize(ordered.distinct(), "edges")
    labels = None
    turn = 0
    while turn == 0 or not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        rank = F.struct(F.xxhash64("other", F.lit(turn)).alias("hash"), F.col("other").alias("to"))
        own = F.struct(F.xxhash64("node", F.lit(turn)).alias("hash"), F.col("node").alias("to"))
        moves = (
            ends.groupBy("node")
            .agg(F.min(rank).alias("best"))
            .select("node", F.least("best", own)["to"].alias("to"))
        )
        moves = materialize(moves, "moves")
        if labels is None:
            labels = moves.select("node", F.col("to").alias("root"))
        else:
            step = moves.select(F.col("node").alias("root"), "to")
            labels = labels.join(step, "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")
            )
        first = moves.select(F.col("node").alias("a"), F.col("to").alias("first"))
        second = moves.select(F.col("node").alias("b"), F.col("to").alias("second"))
        contracted = (
            edges.join(first, "a")
            .join(second, "b")
            .where(F.col("first") != F.col("second"))
            .select(F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b"))
        )
        edges = materialize(contracted.distinct(), "edges")
        labels = materialize(labels, "labels")
        turn += 1
    return labels
