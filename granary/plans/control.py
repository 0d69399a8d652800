"""Permissions, bindings, usage, sessions and caches; here customers form a tree and orders bind them to segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import models
from granary.operators import control
from granary.plans.registry import query
from granary.sources.tables import table


@query("SELECT p_partkey FROM part WHERE p_size > 5 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey IN (3, 5))")
def role_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different enabled permissions of two roles."""
    grants = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("role_id"), F.col("l_partkey").alias("permission_id"))
    permissions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("permission_id"), (F.col("p_size") > 5).alias("enabled"))
    return control.granted(grants.select("role_id").distinct().filter(F.col("role_id").isin(3, 5)), grants, permissions).select(F.col("permission_id").alias("p_partkey"))


TREE = "n AS (SELECT c_custkey AS id, CASE WHEN c_custkey >= 3 THEN c_custkey // 3 END AS parent, (c_acctbal * 100)::BIGINT AS ord FROM customer WHERE c_custkey > 0 AND c_custkey % 11 <> 4)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").filter((key > 0) & (key % 11 != 4))
    return rows.select(key.alias("id"), F.when(key >= 3, F.floor(key / 3)).alias("parent"), (F.col("c_acctbal") * 100).cast("long").alias("ord"))


@query(
    f"""WITH RECURSIVE {TREE}, r AS (SELECT id, ord, 0 AS depth, id::VARCHAR AS path FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, n.ord, depth + 1, path || '/' || n.id FROM n JOIN r ON n.parent = r.id)
    SELECT id, depth, path FROM r"""
)
def menu_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree laid out by the paths of its nodes; nodes whose parent is gone are roots."""
    out = control.nested(_tree(spark, sf_dir), "id", "parent", "ord")
    return out.select("id", "depth", F.array_join(F.transform("path", lambda p: p["id"].cast("string")), "/").alias("path"))


@query(
    f"""WITH RECURSIVE {TREE}, u AS (SELECT id AS node, parent AS up FROM n WHERE parent IS NOT NULL UNION SELECT u.node, n.parent FROM u JOIN n ON n.id = u.up WHERE n.parent IS NOT NULL),
    m AS (SELECT c_custkey // 9 AS id, c_custkey AS new_parent FROM customer WHERE c_custkey >= 9)
    SELECT id, new_parent, id = new_parent OR EXISTS (SELECT 1 FROM u WHERE u.node = new_parent AND u.up = m.id) AS circular FROM m"""
)
def circular_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves below an own descendant are refused."""
    key = F.col("c_custkey")
    moves = table(spark, sf_dir, "customer").filter(key >= 9).select(F.floor(key / 9).alias("id"), key.alias("new_parent"))
    return control.circular(moves, _tree(spark, sf_dir).select("id", "parent"), "id", "parent")


@query(
    """WITH s AS (SELECT o_custkey AS session_id, o_orderkey % 25 AS kb_id, 'saved' AS role, o_orderstatus <> 'P' AS enabled, o_orderkey AS priority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 25 ORDER BY o_orderkey) = 1),
    d AS (SELECT user_id AS session_id, event_id % 30 AS kb_id, CASE WHEN event_type = 'view' THEN 'drafted' END AS role, value > 20 AS enabled, CASE WHEN event_id % 4 = 0 THEN 7 END AS priority, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position FROM events),
    o AS (SELECT session_id, kb_id, coalesce(role, CASE WHEN position = 0 THEN 'primary' ELSE 'secondary' END) AS role, enabled, coalesce(priority, 100 + position) AS priority FROM d QUALIFY row_number() OVER (PARTITION BY session_id, kb_id ORDER BY position) = 1),
    b AS (SELECT * FROM o UNION ALL SELECT * FROM s WHERE session_id NOT IN (SELECT session_id FROM d))
    SELECT session_id, kb_id, role, row_number() OVER (PARTITION BY session_id ORDER BY priority, kb_id::VARCHAR)::INT AS place FROM b JOIN nation ON n_nationkey = kb_id WHERE enabled"""
)
def bound_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections of sessions, drafts before what is saved."""
    once = F.row_number().over(Window.partitionBy("o_custkey", F.col("o_orderkey") % 25).orderBy("o_orderkey"))
    saved = table(spark, sf_dir, "orders").withColumn("n", once).filter("n = 1")
    saved = saved.select(F.col("o_custkey").alias("session_id"), (F.col("o_orderkey") % 25).alias("kb_id"), F.lit("saved").alias("role"), (F.col("o_orderstatus") != "P").alias("enabled"), F.col("o_orderkey").alias("priority"))
    drafts = table(spark, sf_dir, "events")
    position = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    drafts = drafts.select(F.col("user_id").alias("session_id"), (F.col("event_id") % 30).alias("kb_id"), F.when(F.col("event_type") == "view", "drafted").alias("role"), (F.col("value") > 20).alias("enabled"), F.when(F.col("event_id") % 4 == 0, F.lit(7).cast("long")).alias("priority"), position.alias("position"))
    collections = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("kb_id"))
    return control.bound_collections(saved, drafts, collections).select("session_id", "kb_id", "role", "place")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 49) AND s_suppkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def deletable_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that no binding of two kinds uses."""
    tags = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tag_id"))
    used = table(spark, sf_dir, "lineitem").filter("l_linenumber = 7 AND l_quantity > 49").select(F.col("l_suppkey").alias("tag_id"))
    more = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("tag_id"))
    return control.deletable(tags, used, more).select(F.col("tag_id").alias("s_suppkey"))


@query(
    """WITH r AS (SELECT l_orderkey AS chunk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS n, l_returnflag AS f, l_linenumber % 3 AS e, floor(l_quantity / 20)::BIGINT AS q FROM lineitem),
    k AS (SELECT *, CASE f WHEN 'A' THEN CASE WHEN e > 0 THEN 'web_anchor' END WHEN 'R' THEN 'excel_row' ELSE CASE WHEN q > 1 THEN 'pdf_bbox' ELSE 'legacy_element' END END AS ref_type, CASE f WHEN 'A' THEN e::VARCHAR WHEN 'R' THEN q || ',' || e ELSE e || ',' || CASE WHEN q > 1 THEN q ELSE 0 END END AS key FROM r)
    SELECT chunk, n, ref_type FROM k WHERE ref_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk, ref_type, key ORDER BY n) = 1"""
)
def source_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of chunks to pages, sheet rows, boxes and elements, each once."""
    flag, e, q = F.col("l_returnflag"), F.col("l_linenumber") % 3, F.floor(F.col("l_quantity") / 20)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    refs = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chunk"),
        F.row_number().over(w).alias("n"),
        F.when(flag == "A", "Web_Anchor").when(flag == "R", "excel_row").otherwise(None).alias("ref_type"),
        F.when(flag == "A", " http://x ").alias("url"),
        F.lit("").alias("canonical_url"),
        F.when(e > 0, e).alias("dom_index"),
        F.when(flag == "R", "S").alias("sheet_name"),
        q.alias("row_index"),
        F.when(flag == "N", e).alias("page_no"),
        F.when(flag == "N", F.lit(0)).otherwise(e).alias("element_index"),
        F.when((flag == "N") & (q > 1), F.array(*(q.cast("double"),) * 4)).alias("bbox"),
    )
    return control.deduplicated_refs(refs, "chunk", "n").select("chunk", "n", "ref_type")


@query(
    """WITH f AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN value::BIGINT END AS i, CASE WHEN event_type = 'click' AND user_id % 3 > 0 THEN value::BIGINT END AS o, CASE WHEN event_type = 'error' THEN event_id END AS t FROM events)
    SELECT user_id, arg_max(i, event_id) AS input_tokens, arg_max(o, event_id) AS output_tokens, coalesce(arg_max(i, event_id) + arg_max(o, event_id), arg_max(t, event_id)) AS total_tokens FROM f GROUP BY 1"""
)
def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of a stream from its frames."""
    kind, n = F.col("event_type"), F.rint("value").cast("long")
    frames = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(kind == "view", n).alias("input_tokens"), F.when((kind == "click") & (F.col("user_id") % 3 > 0), n).alias("output_tokens"), F.when(kind == "error", F.col("event_id")).alias("total_tokens"))
    return control.usage_so_far(frames, "user_id", "event_id")


@query("SELECT user_id, count(CASE WHEN ts <= TIMESTAMP '2024-01-03' AND ts + INTERVAL 8 HOUR > TIMESTAMP '2024-01-03' THEN 1 END) AS held, count(CASE WHEN ts <= TIMESTAMP '2024-01-03' AND ts + INTERVAL 8 HOUR > TIMESTAMP '2024-01-03' THEN 1 END) < 2 AS free FROM events GROUP BY 1")
def open_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases held at a time, and who may take another."""
    leases = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("taken_at"), (F.col("ts") + F.expr("INTERVAL 8 HOURS")).alias("expires_at"))
    return control.open_leases(leases, "user_id", F.lit("2024-01-03").cast("timestamp"), 2)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refresh sessions without an access token."""
    return control.orphan_sessions(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("SELECT event_id FROM events WHERE user_id % 10 = 0 OR ts + INTERVAL 1 DAY >= TIMESTAMP '2024-01-03'")
def unexpired_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revocations that haven't expired."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 10 != 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
    return control.unexpired(rows, "expires_at", F.lit("2024-01-03").cast("timestamp")).select("event_id")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) > 500")
def evicted_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache entries beyond the 500 last used."""
    return control.evicted(table(spark, sf_dir, "events"), "ts", "event_id", 500).select("event_id")


@query(
    """WITH v AS (SELECT 'sales' AS caller, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'audit', o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 100000 OR o_orderstatus = 'F' UNION ALL SELECT 'root', o_orderstatus, o_orderpriority FROM orders)
    SELECT caller, o_orderstatus AS status, count(*) AS n FROM v WHERE left(o_orderpriority, 1) <> '5' AND caller <> 'root' GROUP BY 1, 2"""
)
def role_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One view as two callers see it, by the permissions of their roles; a caller without any sees nothing."""
    registry = models.Models()
    visible = {"orders:open": "o_orderstatus = 'O'", "orders:large": "o_totalprice > 100000", "orders:closed": "o_orderstatus = 'F'"}
    registry.register("sales_orders", models.Model(table(spark, sf_dir, "orders"), "o_orderkey", hidden=("o_totalprice",), visible=visible))
    permissions = spark.createDataFrame([(1, "orders:open", True), (2, "orders:large", True), (3, "orders:closed", True), (4, "orders:open", False)], "permission_id int, code string, enabled boolean")
    grants = spark.createDataFrame([("s", 1), ("a", 2), ("a", 3), ("a", 4), ("n", 4)], "role_id string, permission_id int")
    seen = None
    for caller, role in (("sales", "s"), ("audit", "a"), ("none", "n")):
        codes = models.permission_codes(spark.createDataFrame([(role,)], "role_id string"), grants, permissions)
        rows = registry.listed("sales_orders", codes).filter("left(o_orderpriority, 1) <> '5'")
        counts = rows.groupBy(F.lit(caller).alias("caller"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
        seen = counts if seen is None else seen.unionByName(counts)
    return seen
