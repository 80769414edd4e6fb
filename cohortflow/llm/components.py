"""Connected components of an edge table by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import checkpoint


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long); nodes have equal
    roots exactly if a path joins them.

    In each round a node moves to the member of its closed neighbourhood with the
    least hash (another hash each round), and the edges follow; the node of least
    hash in a component keeps still, so every round shrinks every component, by
    a constant share on average. Minima are combined before the shuffle and
    nothing but row counts reaches the driver. Null ends and loops are ignored.
    """
    edges = checkpoint(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda c: F.xxhash64(F.lit(len(moves)), F.col(c))  # noqa: B023, E731
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.min_by("v", rank("v")).alias("to_"))
        move = checkpoint(nearest.select(F.col("u").alias("node"), F.when(rank("to_") < rank("u"), F.col("to_")).otherwise(F.col("u")).alias("to")))
        moved = (edges.join(move.toDF("u", "u_to"), "u").join(move.toDF("v", "v_to"), "v")
                 .where("u_to != v_to").select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v")).distinct())
        edges = checkpoint(moved)
        moves.append(move)
    if not moves:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = moves[0].toDF("node", "root")
    for move in moves[1:]:
        out = out.join(move.toDF("root", "next_"), "root", "left").select("node", F.coalesce("next_", "root").alias("root"))
    return out
