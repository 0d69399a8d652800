"""All registered queries of the engine, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.plans import registry


def queries() -> dict:
    return registry.collect()[0]


def oracle_sql() -> dict[str, str]:
    return registry.collect()[1]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["list_orders_page"](spark, sf_dir)
