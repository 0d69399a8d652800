"""Versions, positions and break detection over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators import layout
from granary.plans.registry import query
from granary.sources.tables import table


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def latest_5_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).filter("n <= 5").select("user_id", "event_id", "ts")


RETAIN = "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n, o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY AS recent FROM orders)"


def _kept(orders: DataFrame) -> DataFrame:
    """The newest three of each key, limited before they are shuffled, and whatever is recent; no key is gathered whole."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    newest = orders.withColumn("n", F.row_number().over(w)).filter("n <= 3").select("o_custkey", "o_orderkey")
    recent = orders.filter(F.col("o_orderdate") > orders.agg(F.max("o_orderdate")).scalar() - F.expr("INTERVAL 365 DAYS")).select("o_custkey", "o_orderkey")
    return newest.unionByName(recent).distinct()


@query(f"{RETAIN} SELECT o_custkey, o_orderkey FROM r WHERE n <= 3 OR recent")
def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three versions and all of the last year."""
    return _kept(table(spark, sf_dir, "orders"))


@query(f"{RETAIN} SELECT o_custkey, o_orderkey FROM r WHERE NOT (n <= 3 OR recent)")
def retention_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_custkey", "o_orderkey").join(_kept(orders), ["o_custkey", "o_orderkey"], "left_anti")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) - 1 AS position FROM lineitem")
def renumber_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).alias("position"))


@query("SELECT c_custkey, coalesce(max(l_linenumber), 0) + 1 AS next_index FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def next_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("l_linenumber").alias("m"))
    return table(spark, sf_dir, "customer").join(used, "c_custkey", "left").select("c_custkey", (F.coalesce("m", F.lit(0)) + 1).alias("next_index"))


@query(
    """WITH pinned AS (SELECT l_orderkey AS g, l_linenumber AS item, (l_linenumber * 2) % 3 AS slot FROM lineitem WHERE l_linenumber = 2),
    free AS (SELECT s.g, s.slot, row_number() OVER (PARTITION BY s.g ORDER BY s.slot) AS n FROM (SELECT l_orderkey AS g, unnest(range(count(*))) AS slot FROM lineitem GROUP BY 1) s ANTI JOIN pinned p ON p.g = s.g AND p.slot = s.slot),
    rest AS (SELECT l_orderkey AS g, l_linenumber AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem WHERE l_linenumber <> 2)
    SELECT g, item, slot FROM pinned UNION ALL SELECT r.g, r.item, f.slot FROM rest r JOIN free f ON f.g = r.g AND f.n = r.n"""
)
def reorder_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given items go to given slots; the others fill the free slots in their old order."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("item"))
    pinned = rows.filter("item = 2").withColumn("slot", (F.col("item") * 2 % 3).cast("long"))
    slots = rows.groupBy("g").agg(F.count("*").alias("n")).select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"))
    free = slots.join(pinned, ["g", "slot"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("slot")))
    rest = rows.filter("item <> 2").withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("item")))
    return pinned.unionByName(rest.join(free, ["g", "n"]).select("g", "item", "slot"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS hits FROM events")
def repeated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits of the same scope a group has had so far."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("hits"))


@query(
    """WITH p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    b AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS paragraph FROM p)
    SELECT user_id, paragraph::BIGINT AS paragraph, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM b GROUP BY 1, 2"""
)
def gap_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring rows joined while the gap stays small."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(w))
    new = F.when(F.col("before").isNull() | (F.timestamp_diff("MICROSECOND", F.col("before"), F.col("ts")) > 6 * 3600 * 1_000_000), 1).otherwise(0)
    rows = rows.withColumn("new", new).withColumn("paragraph", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "paragraph").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT *, max(l_quantity) OVER w - min(l_quantity) OVER w AS spread, (max(l_quantity) OVER w + min(l_quantity) OVER w) / 2 AS mid FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
    SELECT l_orderkey, l_linenumber, CASE WHEN spread > 10 AND l_quantity >= mid THEN 2 ELSE 1 END AS col,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN spread > 10 AND l_quantity >= mid THEN 2 ELSE 1 END, l_shipdate, l_linenumber) AS reading_order FROM s"""
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a page split into two columns where they spread widely, and read column by column."""
    rows = layout.two_columns(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", ["l_shipdate", "l_linenumber"], 10.0)
    return rows.select("l_orderkey", "l_linenumber", "col", "reading_order")


@query(
    """WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM f)
    SELECT user_id, island::BIGINT AS island, any_value(event_type) AS header, count(*) AS n_rows, min(event_id) AS first_row FROM i GROUP BY 1, 2"""
)
def merged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive parts with one header drawn together."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").withColumn("new", (~F.lag("event_type").over(w).eqNullSafe(F.col("event_type"))).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "island").agg(F.first("event_type").alias("header"), F.count("*").alias("n_rows"), F.min("event_id").alias("first_row"))
