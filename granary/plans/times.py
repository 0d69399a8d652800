"""Schedules, ages and time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import scoring
from granary.plans.registry import query
from granary.sources.tables import table


@query(
    """SELECT event_id, CASE event_type WHEN 'view' THEN CASE WHEN date_trunc('day', ts) + INTERVAL 510 MINUTE > ts THEN date_trunc('day', ts) + INTERVAL 510 MINUTE ELSE date_trunc('day', ts) + INTERVAL 1950 MINUTE END
      WHEN 'click' THEN ts + INTERVAL 90 MINUTE ELSE NULL END AS next_at FROM events"""
)
def next_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each event's schedule fires next: daily at 8:30, every 90 minutes, or never."""
    kind = F.when(F.col("event_type") == "view", "daily").when(F.col("event_type") == "click", "interval").otherwise("manual")
    at = scoring.next_trigger(kind, F.col("ts"), F.col("ts"), F.lit(90), F.lit("minute"), F.lit("08:30"), F.lit(1), F.lit(1))
    return table(spark, sf_dir, "events").select("event_id", at.alias("next_at"))


@query("WITH m AS (SELECT o_orderkey, o_orderdate, date_trunc('month', o_orderdate) AS first FROM orders) SELECT o_orderkey, CASE WHEN first + INTERVAL 14 DAY + INTERVAL 6 HOUR > o_orderdate THEN first ELSE first + INTERVAL 1 MONTH END + INTERVAL 14 DAY + INTERVAL 6 HOUR AS next_at FROM m")
def monthly_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next fifteenth at six: this month's where it is still to come."""
    at = scoring.next_trigger(F.lit("monthly"), F.col("o_orderdate"), F.col("o_orderdate"), F.lit(1), F.lit("day"), F.lit("06:00"), F.lit(1), F.lit(15))
    return table(spark, sf_dir, "orders").select("o_orderkey", at.alias("next_at"))


@query("SELECT event_id FROM events e WHERE event_type IN ('view', 'click') AND date_diff('minute', ts, (SELECT max(ts) FROM events)) > 30 AND NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = e.event_id)")
def zombie_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks in flight for over thirty minutes that nothing holds a lock on."""
    events = table(spark, sf_dir, "events")
    now = F.date_trunc("minute", events.agg(F.max("ts")).scalar())
    # More than thirty minutes apart, minutes begun counted whole: the bound reaches the scan.
    old = events.filter(F.col("event_type").isin("view", "click") & (F.col("ts") < now - F.expr("INTERVAL 30 MINUTES")))
    locks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("event_id"))
    return old.join(locks, "event_id", "left_anti").select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 700 DAY AND o_orderstatus = 'F'")
def cleanup_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderdate")).scalar()
    return orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < last - F.expr("INTERVAL 700 DAYS"))).select("o_orderkey")


@query("SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def events_minute_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run for each user and minute."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT 'y' || year(o_orderdate) || '/' || o_custkey || '/f' || o_orderkey AS key, year(o_orderdate)::INT AS y, o_custkey AS owner, date_diff('day', o_orderdate::DATE, DATE '1998-01-01') > 365 AS old FROM orders")
def storage_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read out of storage keys, and whether a file is old enough to go."""
    from granary.sources.files import path_fields

    keys = table(spark, sf_dir, "orders").select(F.concat(F.lit("y"), F.year("o_orderdate"), F.lit("/"), "o_custkey", F.lit("/f"), "o_orderkey").alias("key"), "o_orderdate")
    fields = path_fields(F.col("key"))
    return keys.select("key", F.substring(fields["root"], 2, 10).cast("int").alias("y"), fields["owner"].cast("long").alias("owner"), (F.datediff(F.lit("1998-01-01").cast("date"), F.to_date("o_orderdate")) > 365).alias("old"))
