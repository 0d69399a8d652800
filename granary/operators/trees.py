"""Trees kept as dotted paths or as parent links. Subtree joins expand paths into their prefixes and join on equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.scratch import scratch_path


def prefixes(path: Column | str) -> Column:
    """All prefixes of a dotted path, shortest first, the path itself last."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def within(rows: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """Rows whose path is a root or lies below one, once each."""
    marked = rows.withColumn("_at", prefixes(path))
    ids = marked.select(path, F.explode("_at").alias("_p")).join(roots.select(F.col(root).alias("_p")).distinct(), "_p", "left_semi").select(path).distinct()
    return rows.join(ids, path, "left_semi")


def ancestors(nodes: DataFrame, path: str, of: DataFrame, of_path: str) -> DataFrame:
    """For each path of `of` the nodes above it and itself, with their level (1: the root)."""
    up = of.select(F.col(of_path).alias("of"), F.posexplode(prefixes(of_path)).alias("level", path))
    return up.join(nodes, path).withColumn("level", F.col("level") + 1)


def moved(path: Column, old: str, new: str) -> Column:
    """A path after its subtree moved from old to new."""
    below = (path == old) | path.startswith(f"{old}.")
    return F.when(below, F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def level(path: Column) -> Column:
    return F.size(F.split(path, r"\."))


def closure(links: DataFrame, child: str, parent: str) -> DataFrame:
    """Every (node, ancestor, distance) of parent links, in steps that double the distance, until nothing is added.

    The distance is that of the shortest way. In a cycle each node is an ancestor of all, itself included.
    """
    step = links.filter(F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("distance"))
    reached, done = _written(step.distinct()), 1
    # All pairs up to `done` are known. A pair further apart passes through one that is exactly so far apart.
    while not (ends := reached.filter(F.col("distance") == done)).isEmpty():
        further = ends.alias("a").join(reached.alias("b"), F.col("a.ancestor") == F.col("b.node")).select(F.col("a.node"), F.col("b.ancestor"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        reached = _written(reached.unionByName(further).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        done *= 2
    return reached


def _written(pairs: DataFrame) -> DataFrame:
    """The pairs from a scratch table, so that a round doesn't repeat those before it."""
    path = scratch_path(pairs.sparkSession, "closure")
    pairs.write.parquet(path)
    return pairs.sparkSession.read.schema(pairs.schema).parquet(path)
