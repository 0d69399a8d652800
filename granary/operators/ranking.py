"""Numbering rows in order without gathering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.scratch import scratch_path


def numbered(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """rows with their number from 1 in an ascending order of columns or expressions, in a column `name`.

    Rows are dealt out by ranges of the order and written; the ranges' counts, of which there are as many as partitions, tell with
    which number each begins. Rows that are equal in the order are numbered in any way."""
    spark = rows.sparkSession
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    path = scratch_path(spark, "numbered")
    keys = [f"_o{i}" for i in range(len(columns))]
    dealt = rows.withColumns(dict(zip(keys, columns, strict=True))).repartitionByRange(*keys)
    dealt.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    written = spark.read.schema(dealt.withColumn("_part", F.lit(0)).schema).parquet(path)
    counts = sorted(written.groupBy("_part").count().collect())
    begins, so_far = [], 0
    for part, n in counts:
        begins += [F.lit(part), F.lit(so_far).cast("long")]
        so_far += n
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)).cast("long")
    offset = F.create_map(*begins)[F.col("_part")] if begins else F.lit(0).cast("long")
    return written.withColumn(name, place + offset).drop("_part", *keys)
