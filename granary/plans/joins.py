"""Semi, anti, prefix, recursive and aggregate joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators import trees
from granary.plans.registry import query
from granary.sources.tables import table

PATHS = "SELECT c_custkey, 'r' || r_regionkey || '.n' || n_nationkey || '.c' || c_custkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def customer_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-level folder tree: region, nation, customer."""
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", F.concat(F.lit("r"), "n_regionkey", F.lit(".n"), "n_nationkey", F.lit(".c"), "c_custkey").alias("path"))


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def used_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(used, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def unused_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(used, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query(f"SELECT c_custkey, path FROM ({PATHS}) WHERE path = 'r1' OR path LIKE 'r1.%' OR path = 'r2.n2' OR path LIKE 'r2.n2.%'")
def subtree_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers below folders that aggregation picked out of the tree itself."""
    paths = customer_paths(spark, sf_dir)
    roots = paths.select(F.explode(trees.prefixes("path")).alias("root")).distinct().filter(F.col("root").isin("r1", "r2.n2"))
    return trees.within(paths, "path", roots, "root")


@query(f"WITH p AS ({PATHS}), f AS (SELECT DISTINCT split_part(path, '.', 1) AS path FROM p UNION SELECT DISTINCT split_part(path, '.', 1) || '.' || split_part(path, '.', 2) FROM p) SELECT p.path AS of, f.path, len(string_split(f.path, '.')) AS level FROM p JOIN f ON p.path LIKE f.path || '.%'")
def ancestors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = customer_paths(spark, sf_dir)
    folders = paths.select(F.explode(trees.prefixes("path")).alias("path")).distinct().filter(trees.level(F.col("path")) <= 2)
    return trees.ancestors(folders, "path", paths, "path")


@query(f"SELECT c_custkey, CASE WHEN path LIKE 'r1.%' THEN 'r4.n0' || substr(path, 3) ELSE path END AS new_path, len(string_split(CASE WHEN path LIKE 'r1.%' THEN 'r4.n0' || substr(path, 3) ELSE path END, '.')) AS level FROM ({PATHS})")
def moved_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and levels after a folder moves below another one."""
    new = trees.moved(F.col("path"), "r1", "r4.n0")
    return customer_paths(spark, sf_dir).select("c_custkey", new.alias("new_path"), trees.level(new).alias("level"))


@query("WITH RECURSIVE l AS (SELECT c_custkey AS node, c_custkey // 3 AS parent FROM customer WHERE c_custkey > 0), r AS (SELECT node, parent AS ancestor, 1 AS distance FROM l UNION ALL SELECT r.node, l.parent, r.distance + 1 FROM r JOIN l ON r.ancestor = l.node) SELECT * FROM r")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors by parent links, however deep."""
    links = table(spark, sf_dir, "customer").filter("c_custkey > 0").select(F.col("c_custkey").alias("node"), F.floor(F.col("c_custkey") / 3).alias("parent"))
    return trees.closure(links, "node", "parent")


@query(
    """SELECT c_custkey, coalesce(n, 0) AS n_orders, round(coalesce(total, 0), 2) AS total, last FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey"""
)
def scalar_stats_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated scalar subqueries as one aggregate and a left join."""
    stats = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_orderdate").alias("last"))
    return table(spark, sf_dir, "customer").join(stats, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"), "last")


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), n_name) AS shown, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def naming_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), "n_name").alias("shown"), "n_name")


@query(
    """SELECT o_orderkey, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS tags FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1"""
)
def tags_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's distinct tag names, sorted; none as an empty text... documents without bindings stay."""
    bound = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("tags"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(bound, "o_orderkey", "left")


@query("SELECT count(DISTINCT d.doc_id) AS documents, count(DISTINCT e.vec_id) AS with_vector, count(DISTINCT l.doc_id) AS with_label FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id")
def projection_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many units have a vector and a label; distinct counts, as a unit may have several."""
    docs, vectors, labels = (table(spark, sf_dir, t).select(F.col(c).alias("id")).distinct() for t, c in (("documents", "doc_id"), ("embeddings", "vec_id"), ("labels", "doc_id")))
    rows = docs.join(vectors.withColumn("v", F.lit(1)), "id", "left").join(labels.withColumn("l", F.lit(1)), "id", "left")
    return rows.agg(F.count("*").alias("documents"), F.count("v").alias("with_vector"), F.count("l").alias("with_label"))


@query(
    """WITH v AS (SELECT p_type AS variant, p_brand AS term, p_size AS priority, p_partkey AS id FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY priority DESC, id) AS n FROM v) SELECT variant, term FROM r WHERE n = 1"""
)
def synonym_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each variant the term of highest priority."""
    parts = table(spark, sf_dir, "part")
    first = F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_size"), "p_partkey"))
    return parts.withColumn("n", first).filter("n = 1").select(F.col("p_type").alias("variant"), F.col("p_brand").alias("term"))


@query(
    """SELECT conv_id, turn, text, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ' | ') AS previous,
    array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ' | ') AS next FROM conversations"""
)
def neighbor_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message with the two before and after it."""
    from granary.operators.retrieval import neighbours

    rows = neighbours(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 2)
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, " | "))
    return rows.select("conv_id", "turn", "text", joined("previous").alias("previous"), joined("next").alias("next"))


@query("SELECT c_custkey AS user_id, count(*) AS n_orders FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c_custkey AND e.event_type = 'purchase') GROUP BY 1")
def due_without_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined work that is due and has nothing in flight."""
    running = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id")
    due = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return due.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n_orders")).join(running, "user_id", "left_anti")
