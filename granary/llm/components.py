"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import discard, stored


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least one around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the least of them. Edges go from the greater node."""
    least = _least(edges)
    below = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return below.unionByName(own).filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node with an edge (a, b), a <> b; each round is written to the shared folder."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    before: list[DataFrame] = []
    while True:
        down = stored(_small_star(_large_star(down)), "stars")
        discard(*before)
        before = [down]
        # Done when no node that others hang on hangs on another one itself.
        if down.select("b").distinct().join(down.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and _one_parent(down):
            break
    roots = down.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return down.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _one_parent(down: DataFrame) -> bool:
    return down.groupBy("a").count().filter("count > 1").isEmpty()
