"""Changes between versions of keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.filters import every


def changes(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, the new (or deleted) values, and action: insert, update, delete or keep."""
    a = old.select(*keys, F.struct(*values).alias("_a"))
    b = new.select(*keys, F.struct(*values).alias("_b"))
    action = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(F.col("_a").eqNullSafe(F.col("_b")), "keep").otherwise("update")
    both = a.join(b, keys, "full").withColumn("action", action).withColumn("_v", F.coalesce("_b", "_a"))
    return both.select(*keys, "_v.*", "action")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, and all new rows. New rows must be unique by key."""
    return old.join(new, keys, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the given order."""
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return picked.select("_r.*")


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return every([a[c].eqNullSafe(b[c]) for c in columns])


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Writes rows in place of all earlier ones of the same `by`; other partitions stay."""
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
