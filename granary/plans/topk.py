"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.plans.registry import query
from granary.sources.tables import table


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey NOT IN (1, 2, 3) AND c_name ILIKE '%1%' ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 30")
def picker_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").filter(~F.col("c_custkey").isin(1, 2, 3) & F.col("c_name").ilike("%1%"))
    return rows.select("c_custkey", "c_mktsegment", "c_acctbal").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey").limit(30)


@query(
    """WITH b AS (SELECT event_type, user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events)
    SELECT user_id, event_id, value FROM b WHERE n = 1 ORDER BY value DESC, event_id LIMIT 12"""
)
def upgraded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest candidate of each target, the surest twelve of all."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    best = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).filter("n = 1")
    return best.select("user_id", "event_id", "value").orderBy(F.desc("value"), "event_id").limit(12)


@query(
    """WITH e AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
    SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS context FROM e WHERE n <= 6 GROUP BY 1"""
)
def rewrite_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest six messages of each conversation, oldest first."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    few = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w)).filter("n <= 6")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    return few.groupBy("conv_id").agg(F.array_join(parts, "|").alias("context"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def latest_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY CASE WHEN p_size > 25 THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey LIMIT 40 OFFSET 10")
def case_sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return rows.orderBy(F.when(F.col("p_size") > 25, 0).otherwise(1), F.desc("p_retailprice"), "p_partkey").offset(10).limit(40)


@query("SELECT lower(text_key) AS term, min(doc) AS doc FROM (SELECT p_name AS text_key, p_partkey AS doc FROM part) GROUP BY 1")
def first_of_each_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for each spelling without regard to case, the first."""
    return table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("term")).agg(F.min("p_partkey").alias("doc"))


DIFF = """WITH a AS (SELECT o_custkey AS id, max(o_orderkey) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), b AS (SELECT o_custkey AS id, max(o_orderkey) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1)"""


@query(f"{DIFF} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'delete' WHEN a.v <> b.v THEN 'update' ELSE 'keep' END AS action FROM a FULL JOIN b ON a.id = b.id")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What turns one set of rows into another: insert, update, delete or keep."""
    from granary.operators.upserts import changes

    orders = table(spark, sf_dir, "orders")
    side = lambda when: orders.filter(when).groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("v"))
    old, new = side(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")), side(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp"))
    return changes(old, new, ["id"], ["v"]).select("id", "action")


@query(f"{DIFF} SELECT coalesce(b.id, a.id) AS id, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.id = b.id")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows with new ones put over them by key."""
    from granary.operators.upserts import upsert

    orders = table(spark, sf_dir, "orders")
    side = lambda when: orders.filter(when).groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("v"))
    return upsert(side(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")), side(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")), ["id"])


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)")
def projections_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows left when the rows of some chunks are deleted."""
    gone = table(spark, sf_dir, "labels").filter("quality = 0 and doc_id is not null").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").join(gone, "vec_id", "left_anti").select("vec_id")


@query("(SELECT l_partkey AS id, 'revoke' AS action FROM lineitem WHERE l_suppkey = 1 EXCEPT SELECT l_partkey, 'revoke' FROM lineitem WHERE l_suppkey = 2) UNION ALL (SELECT l_partkey, 'grant' FROM lineitem WHERE l_suppkey = 2 EXCEPT SELECT l_partkey, 'grant' FROM lineitem WHERE l_suppkey = 1)")
def replace_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to revoke and grant when one set replaces another."""
    items = table(spark, sf_dir, "lineitem")
    of = lambda s: items.filter(F.col("l_suppkey") == s).select(F.col("l_partkey").alias("id")).distinct()
    return of(1).join(of(2), "id", "left_anti").withColumn("action", F.lit("revoke")).unionByName(of(2).join(of(1), "id", "left_anti").withColumn("action", F.lit("grant")))
