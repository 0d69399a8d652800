"""Markdown elements, splitting, and rule chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import markdown, rules, sections
from granary.operators.chunking import heading_sections
from granary.plans.registry import query
from granary.sources.tables import table


def _order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipe table for each order, out of its lines."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"), F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("r")))), lambda x: x["r"])
    body = F.concat(F.lit("| no | part | flag | status |\n| --- | --- | --- | --- |\n"), F.array_join(rows, "\n"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(body.alias("body"), F.count("*").alias("n"))


ROW = "'| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag || ' | ' || l_linestatus || ' |'"
HEAD = "'| no | part | flag | status |' || chr(10) || '| --- | --- | --- | --- |'"


@query(
    f"""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, {ROW}) - 1 AS i, {ROW} AS r FROM lineitem)
    SELECT l_orderkey, (i // 4)::INT AS part, {HEAD} || chr(10) || string_agg(r, chr(10) ORDER BY i) AS content FROM r GROUP BY 1, 2"""
)
def split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables split with their headers repeated: a row has nine units, so that four are in each part."""
    return _order_tables(spark, sf_dir).select("l_orderkey", F.posexplode(markdown.split_table(F.col("body"), 40)).alias("part", "content"))


@query(
    f"""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, {ROW}) AS i, l_linenumber AS no, l_partkey AS part, l_returnflag AS flag, l_linestatus AS status FROM lineitem)
    SELECT l_orderkey, 0 AS part, '| no | part | flag |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || no || ' | ' || part || ' | ' || flag || ' |', chr(10) ORDER BY i) AS content FROM r GROUP BY 1
    UNION ALL SELECT l_orderkey, 1, '| no | status |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || no || ' | ' || status || ' |', chr(10) ORDER BY i) FROM r GROUP BY 1"""
)
def split_wide_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four columns in groups of three that keep the first."""
    return _order_tables(spark, sf_dir).select("l_orderkey", F.posexplode(markdown.split_wide_table(F.col("body"), 3)).alias("part", "content"))


@query(
    """WITH l AS (SELECT l_orderkey, string_agg('- part ' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey) AS items, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT l_orderkey, 'plain' AS kind, 0 AS first_line, '# Order' || chr(10) || 'text' AS content FROM l UNION ALL SELECT l_orderkey, 'list', 2, items FROM l
    UNION ALL SELECT l_orderkey, 'code', (2 + n)::INT, '```' || chr(10) || '- not an item' || chr(10) || '```' FROM l UNION ALL SELECT l_orderkey, 'quote', (5 + n)::INT, '> quoted' FROM l"""
)
def markdown_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain lines, lists, code and quotes of a text, in order."""
    # What is sent are numbers; items are written where they have met.
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    items = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- part "), x["l_partkey"])), "\n")
    docs = lines.select("l_orderkey", F.concat(F.lit("# Order\ntext\n"), items, F.lit("\n```\n- not an item\n```\n> quoted")).alias("body"))
    return markdown.elements(docs, "l_orderkey", "body").select("l_orderkey", "kind", "first_line", "content")


@query()
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents (each first line a heading) as section, child, part and parent chunks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Document "), "doc_id", F.lit("\n"), F.col("text")).alias("body"))
    return sections.section_tree(heading_sections(docs, "doc_id", "body"), "doc_id", 120, 480)


UNITS = "coalesce(list_sum(list_transform(regexp_extract_all(body, '[一-鿿㐀-䶿　-〿＀-￯]|[\\p{L}\\p{N}_]+|[^\\s]'), lambda p: CASE WHEN length(p) > 8 THEN (length(p) + 3) // 4 ELSE 1 END)), 0)".replace("\\\\", "\\")


@query(
    rf"""WITH d AS (SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN repeat('1 2 3 ', 20) WHEN 1 THEN left(text, 60) WHEN 2 THEN ' ' ELSE text END AS body FROM documents), u AS (SELECT *, {UNITS} AS units FROM d)
    SELECT doc_id, CASE WHEN doc_id % 13 = 12 THEN 'not_leaf' WHEN trim(body, E' \n\t') = '' THEN 'empty' WHEN lang = 'fr' THEN 'table' WHEN units < 40 THEN 'short' WHEN units > 600 THEN 'long'
      WHEN length(regexp_replace(body, '[^0-9]', '', 'g')) / length(regexp_replace(body, '\s', '', 'g'))::DOUBLE > 0.45 THEN 'numeric' ELSE 'ok' END AS reason FROM u"""
)
def enhancement_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that keeps a chunk from being enhanced."""
    key = F.col("doc_id")
    body = F.when(key % 5 == 0, "1 2 3 " * 20).when(key % 5 == 1, F.substring("text", 1, 60)).when(key % 5 == 2, " ").otherwise(F.col("text"))
    kind = F.when(F.col("lang") == "fr", "table").otherwise("text")
    return table(spark, sf_dir, "documents").select("doc_id", rules.enhancement(body, kind, key % 13 != 12, most=600)["reason"].alias("reason"))


@query(
    """SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'invalid_value' WHEN user_id % 5 = 0 THEN 'conflict' WHEN value < 30 THEN 'low_confidence' ELSE 'accepted' END AS status FROM events"""
)
def candidate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How filter candidates of a query are judged."""
    allowed = F.col("event_type").isin("view", "click", "purchase")
    status = rules.candidate_status(F.col("value"), F.col("event_type"), F.col("user_id") % 5 == 0, allowed, 30.0)
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"))


@query("SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id FROM events WHERE value >= 100 GROUP BY 1 ORDER BY max(value) DESC, event_id LIMIT 8")
def upgraded_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.upgraded(table(spark, sf_dir, "events"), "user_id", "value", "event_id", 100.0, 8).select("user_id", "event_id")
