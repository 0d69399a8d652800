"""The generic list query and its operators, one query each."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.filters import ListRequest, matching, page, total
from granary.plans.registry import query
from granary.sources.tables import table

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query(
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders
    WHERE o_orderstatus = 'O' AND o_orderpriority ILIKE '%urgent%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40"""
)
def list_orders_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third page of twenty of the open urgent orders, newest first."""
    request = ListRequest(equal=(("o_orderstatus", "O"),), search="urgent", search_columns=("o_orderpriority",), sort=(("o_orderdate", True),), tie="o_orderkey", page=3)
    return page(table(spark, sf_dir, "orders"), request).select(*ORDER_COLUMNS)


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority ILIKE '%urgent%'")
def list_orders_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return total(table(spark, sf_dir, "orders"), ListRequest(equal=(("o_orderstatus", "O"),), search="urgent", search_columns=("o_orderpriority",)))


DAY = datetime.datetime(1995, 6, 1)
OPERATORS = {
    "eq": ("o_orderstatus", "F", "o_orderstatus = 'F'"),
    "ne": ("o_orderstatus", "F", "o_orderstatus <> 'F'"),
    "gt": ("o_totalprice", 250000.0, "o_totalprice > 250000.0"),
    "gte": ("o_orderdate", DAY, "o_orderdate >= TIMESTAMP '1995-06-01'"),
    "lt": ("o_totalprice", 20000.0, "o_totalprice < 20000.0"),
    "lte": ("o_orderdate", DAY, "o_orderdate <= TIMESTAMP '1995-06-01'"),
    "like": ("o_orderpriority", "spec", "o_orderpriority ILIKE '%spec%'"),
    "in": ("o_orderpriority", ["1-URGENT", "2-HIGH"], "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "not_in": ("o_orderpriority", ["1-URGENT", "2-HIGH"], "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    "is_null": ("done", None, "o_orderstatus <> 'F'"),
    "is_not_null": ("done", None, "o_orderstatus = 'F'"),
}


def _advanced(op: str, column: str, value, sql: str) -> None:
    @query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE {sql}", name=f"list_op_{op}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "orders").withColumn("done", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))  # null where it is open
        return matching(rows, ListRequest(advanced=((column, op, value),))).select("o_orderkey", "o_totalprice")


for _op, _case in OPERATORS.items():
    _advanced(_op, *_case)


@query(
    """SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE c_name ILIKE '%7%' OR n_name ILIKE '%7%' OR r_name ILIKE '%7%' ORDER BY c_acctbal DESC, c_custkey LIMIT 50"""
)
def list_joined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over columns of three joined tables, best balance first."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    request = ListRequest(search="7", search_columns=("c_name", "n_name", "r_name"), sort=(("c_acctbal", True),), tie="c_custkey", page_size=50)
    return page(rows, request).select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT event_id, user_id, event_type, ts FROM events WHERE event_type = 'click' AND ts BETWEEN (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND (SELECT min(ts) + INTERVAL 3 DAY FROM events)")
def audit_log_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality and a closed time range."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("ts")).scalar()  # a subquery's value: the range reaches the scan
    inside = F.col("ts").between(first + F.expr("INTERVAL 1 DAY"), first + F.expr("INTERVAL 3 DAYS"))
    return events.filter((F.col("event_type") == "click") & inside).select("event_id", "user_id", "event_type", "ts")


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a column with their number, for faceted lists."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("value")).agg(F.count("*").alias("n"))
