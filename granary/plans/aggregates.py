"""Grouped counts, votes, merges and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text
from granary.operators import layout
from granary.plans.registry import query
from granary.sources.tables import table


@query(
    """SELECT l_shipmode_tag AS tag, count(DISTINCT CASE WHEN kind = 'R' THEN target END) AS returned, count(DISTINCT CASE WHEN kind = 'A' THEN target END) AS accepted, count(DISTINCT CASE WHEN kind = 'N' THEN target END) AS new
    FROM (SELECT l_linenumber AS l_shipmode_tag, l_returnflag AS kind, l_orderkey AS target FROM lineitem) GROUP BY 1"""
)
def tag_usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct targets of each tag by target type, in one pass."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("tag"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("target")).distinct()
    of = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return rows.groupBy("tag").agg(of("R").alias("returned"), of("A").alias("accepted"), of("N").alias("new"))


@query(
    """WITH s AS (SELECT DISTINCT l_linenumber AS tag, l_orderkey AS target FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY target) AS n FROM s)
    SELECT tag, array_to_string(list(target ORDER BY target), ',') AS samples FROM r WHERE n <= 3 GROUP BY 1"""
)
def tag_usage_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three targets of each tag."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("tag"), F.col("l_orderkey").alias("target")).distinct()
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("tag").orderBy("target"))).filter("n <= 3")
    return few.groupBy("tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list("target")), lambda x: x.cast("string")), ",").alias("samples"))


@query("SELECT DISTINCT p_brand AS facet, 'brand' AS kind FROM part UNION ALL SELECT DISTINCT unnest(string_split(p_type, ' ')), 'word' FROM part")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct categories, and distinct tags out of lists."""
    part = table(spark, sf_dir, "part")
    brands = part.select(F.col("p_brand").alias("facet"), F.lit("brand").alias("kind")).distinct()
    return brands.unionByName(part.select(F.explode(F.split("p_type", " ")).alias("facet"), F.lit("word").alias("kind")).distinct())


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag FROM part ORDER BY tag LIMIT 25")
def distinct_tags_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).distinct().orderBy("tag").limit(25)


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 4) AS high_rate, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS high FROM events GROUP BY 1"""
)
def candidate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, means and rates by type."""
    high = F.when(F.col("value") > 50, 1).otherwise(0)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.avg(high.cast("double")), 4).alias("high_rate"), F.sum(high).alias("high"))


@query(
    """SELECT user_id, count(*) AS hits, round(avg(value), 4) AS mean_score, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS names, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1"""
)
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, mean score, names and the last event of each user."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("hits"), F.round(F.avg("value"), 4).alias("mean_score"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("names"), F.max("ts").alias("last_ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type")
    )


@query(
    """SELECT l_orderkey AS page, min(l_linenumber) AS x0, min(l_quantity) AS y0, max(l_linenumber) AS x1, max(l_quantity) AS y1 FROM lineitem GROUP BY 1"""
)
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around all elements of a page."""
    q = F.col("l_quantity")
    elements = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("x0"), q.alias("y0"), F.col("l_linenumber").alias("x1"), q.alias("y1"))
    return layout.boxes(elements, "page")


VOTE_SQL = """
WITH v AS (SELECT 'c_name' AS col, c_name AS x FROM customer UNION ALL SELECT 'c_custkey', c_custkey::VARCHAR FROM customer UNION ALL SELECT 'c_acctbal', (round(c_acctbal, 2)::DECIMAL(18,2))::VARCHAR FROM customer UNION ALL SELECT 'date', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 'flag', CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END FROM customer),
t AS (SELECT col, CASE WHEN lower(x) IN ('true','false','yes','no','1','0','是','否') THEN 'bool' WHEN regexp_matches(x, '^\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}$') THEN 'datetime' WHEN regexp_matches(x, '^[+-]?\\d+$') THEN 'int' WHEN regexp_matches(x, '^[+-]?\\d+\\.\\d*$') THEN 'float' ELSE 'text' END AS kind FROM v),
c AS (SELECT col, count(*) AS n, sum((kind = 'text')::INT) AS texts, sum((kind = 'bool')::INT) AS bools, sum((kind = 'datetime')::INT) AS dates, sum((kind = 'int')::INT) AS ints FROM t GROUP BY 1)
SELECT col, CASE WHEN texts > 0.3 * n THEN 'text' WHEN bools > 0 THEN 'bool' WHEN dates > 0 THEN 'datetime' WHEN ints > 0 THEN 'int' ELSE 'float' END AS voted FROM c
""".replace("\\\\", "\\")


@query(VOTE_SQL)
def type_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column types by vote: text where three in ten values are text, else the first type present of bool, datetime, int, float."""
    c = table(spark, sf_dir, "customer")
    one = lambda df, name, x: df.select(F.lit(name).alias("col"), x.alias("x"))
    values = one(c, "c_name", F.col("c_name")).unionByName(one(c, "c_custkey", F.col("c_custkey").cast("string"))).unionByName(one(c, "c_acctbal", F.round("c_acctbal", 2).cast("decimal(18,2)").cast("string")))
    values = values.unionByName(one(table(spark, sf_dir, "orders"), "date", F.date_format("o_orderdate", "yyyy-MM-dd"))).unionByName(one(c, "flag", F.when(F.col("c_custkey") % 2 == 0, "yes").otherwise("no")))
    kind = text.value_type("x")
    counts = values.groupBy("col").agg(F.count("*").alias("n"), *(F.count(F.when(kind == k, 1)).alias(k) for k in ("text", "bool", "datetime", "int")))
    voted = F.when(F.col("text") > 0.3 * F.col("n"), "text").when(F.col("bool") > 0, "bool").when(F.col("datetime") > 0, "datetime").when(F.col("int") > 0, "int").otherwise("float")
    return counts.select("col", voted.alias("voted"))


@query(
    """SELECT bucket, arg_max(event_id, (conf, event_id)) AS event_id, max(conf) AS conf FROM (SELECT floor(value / 5)::BIGINT AS bucket, event_id, value + CASE WHEN event_type = 'view' THEN 3 ELSE 0 END AS conf FROM events) GROUP BY 1"""
)
def fused_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of readings that fall into one bucket the one of best confidence, originals favoured."""
    conf = F.col("value") + F.when(F.col("event_type") == "view", 3).otherwise(0)
    return layout.best_readings(table(spark, sf_dir, "events").withColumn("bucket", F.floor(F.col("value") / 5)), ["bucket"], "event_id", conf)


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_suppkey, count(*) OVER (PARTITION BY l_suppkey, round(l_quantity / 5)) AS n, count(*) OVER (PARTITION BY l_suppkey) AS pages FROM lineitem)
    SELECT l_orderkey, l_linenumber FROM s WHERE NOT (pages >= 3 AND n >= floor(0.15 * pages))"""
)
def repeated_signatures_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without those whose signature recurs on a large share of the pages, as headers and footers do."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return layout.without_repeated(rows, "l_suppkey", F.round(F.col("l_quantity") / 5)).select("l_orderkey", "l_linenumber")


@query(
    """WITH h AS (SELECT l_suppkey AS doc, round(l_quantity, 0) AS size, sum(l_linenumber) AS chars FROM lineitem GROUP BY 1, 2)
    SELECT doc, arg_max(size, (chars, -size)) AS body_size, max(chars)::BIGINT AS chars FROM h GROUP BY 1"""
)
def weighted_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest size of each document, weighted by characters."""
    spans = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "doc")
    return layout.body_size(spans, "doc", "l_quantity", "l_linenumber")


@query("SELECT lower(trim(p_name)) AS question, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that more than one row has, without regard to case and blanks at the ends; here part names."""
    return table(spark, sf_dir, "part").groupBy(F.lower(F.trim("p_name")).alias("question")).agg(F.count("*").alias("n")).filter("n > 1")


@query(
    """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body, min(turn) AS anchor, count(*) AS n_parts FROM conversations GROUP BY 1"""
)
def row_group_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of one group as one ordered text, anchored at the first."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(parts, "\n").alias("body"), F.min("turn").alias("anchor"), F.count("*").alias("n_parts"))


@query(
    """SELECT conv_id, count(*) AS messages, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END)::BIGINT AS prompt, sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END)::BIGINT AS completion, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1"""
)
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counters of a session, and what came last."""
    n = F.length("text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.sum(F.when(F.col("role") == "user", n).otherwise(0)).alias("prompt"), F.sum(F.when(F.col("role") != "user", n).otherwise(0)).alias("completion"), F.max_by("role", "turn").alias("last_role")
    )


@query("SELECT source, lang, count(*) AS n_docs, sum(length(text))::BIGINT AS chars, count(CASE WHEN length(text) > 2000 THEN 1 END) AS long_docs FROM documents GROUP BY 1, 2")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum(n).alias("chars"), F.count(F.when(n > 2000, 1)).alias("long_docs"))
