"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import materialise


def connected_components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, component) for edges (a, b) of longs; component is the least node reachable.

    Each round contracts the graph: every node moves to the neighbour (itself included) of the least hash, edges between
    nodes that moved together drop out, and equal edges become one. A clique or a star is one node after one round, a path
    halves, so the edge table shrinks by a factor a round. The moves of the rounds are chained backwards, from the smallest
    table to the largest. Tables are written in the shared folder; the joins are equi-joins on a node, which AQE can split.
    """
    left = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), folder, f"{name}_edges_0")
    moves: list[DataFrame] = []
    while not left.isEmpty():
        i = len(moves)
        sides = left.select("a", "b").union(left.select("b", "a")).toDF("node", "to")
        nearest = sides.groupBy("node").agg(F.min_by("to", F.xxhash64("to")).alias("to"))
        moves.append(materialise(nearest.select("node", F.when(F.xxhash64("node") <= F.xxhash64("to"), F.col("node")).otherwise(F.col("to")).alias("to")), folder, f"{name}_moves_{i}"))
        a, b = moves[-1].toDF("a", "x"), moves[-1].toDF("b", "y")
        moved = left.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where("x <> y")
        left = materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), folder, f"{name}_edges_{i + 1}")
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    ends = moves.pop()
    while moves:
        chained = moves.pop().join(ends.toDF("to", "end").hint("merge"), "to", "left").select("node", F.coalesce("end", "to").alias("to"))
        ends = materialise(chained, folder, f"{name}_ends_{len(moves)}")
    # written first: its rows are summed up before they are dealt out, and AQE can then split what joins them on a large component
    least = materialise(ends.groupBy("to").agg(F.min("node").alias("component")), folder, f"{name}_least")
    return materialise(ends.join(least.hint("merge"), "to").select("node", "component"), folder, f"{name}_components")
