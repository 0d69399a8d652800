"""Filling hits: here turns are chunks, their conversation the document, its first turn their parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import hydration
from granary.operators.ranking import numbered
from granary.plans.registry import query
from granary.sources.tables import table

CHUNKS = r"""c AS (SELECT conv_id * 100 + turn AS chunk_id, CASE WHEN turn > 0 AND turn % 3 <> 0 THEN conv_id * 100 END AS parent_id, conv_id, turn, trim(text, E' \n\t') AS content, CASE WHEN turn % 4 = 1 THEN 'sum ' || conv_id ELSE '' END AS summary,
  CASE WHEN turn % 5 = 1 THEN 'qa_answer_fragment' WHEN turn % 5 = 4 THEN 'excel_row' ELSE 'leaf' END AS role, conv_id % 6 = 5 AS is_table, coalesce(nullif(CASE WHEN turn % 4 = 1 THEN 'sum ' || conv_id ELSE '' END, ''), trim(text, E' \n\t')) AS said FROM conversations),
n AS (SELECT *, lag(said) OVER w AS before, lead(said) OVER w AS after FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT conv_id * 100 + turn AS anchor, conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS k FROM conversations WHERE (conv_id + turn) % 3 = 0),
t AS (SELECT doc_id AS conv_id, list_sort(list(DISTINCT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END)) AS tags FROM labels GROUP BY 1)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, conv = F.col("turn"), F.col("conv_id")
    return table(spark, sf_dir, "conversations").select(
        (conv * 100 + turn).alias("chunk_id"),
        F.when((turn > 0) & (turn % 3 != 0), conv * 100).alias("parent_id"),
        conv.alias("kb_doc_id"),
        turn.alias("position"),
        F.col("text").alias("content"),
        F.when(turn % 4 == 1, F.concat(F.lit("sum "), conv)).alias("summary"),
        F.when(turn % 5 == 1, "qa_answer_fragment").when(turn % 5 == 4, "excel_row").otherwise("leaf").alias("role"),
        F.when(conv % 6 == 5, "table").otherwise("text").alias("source_type"),
        F.when(turn % 10 == 1, F.concat(F.lit("Why "), conv)).alias("question"),
        F.lit("S").alias("sheet"),
        F.concat(F.lit("row "), turn).alias("place"),
        F.array(F.lit("a"), F.lit(" "), F.lit("b")).alias("fields"),
        F.lit(None).cast("string").alias("extra"),
    )


@query(
    f"""WITH {CHUNKS}, x AS (SELECT g.k, g.anchor, g.conv_id, h.*, p.chunk_id AS up_id, p.content AS up_content, coalesce(nullif(p.summary, ''), p.content) AS up_said, p.is_table AS up_table,
      p.chunk_id IS NOT NULL AND (h.is_table OR h.role <> 'leaf') AS up FROM g JOIN n h ON h.chunk_id = g.anchor LEFT JOIN c p ON p.chunk_id = h.parent_id WHERE g.conv_id % 4 <> 3),
    y AS (SELECT *, CASE WHEN is_table THEN '工作表: S' || chr(10) || '定位: row ' || turn || chr(10) || '字段: a、b' || chr(10) || content ELSE content END AS child FROM x),
    z AS (SELECT *, CASE WHEN up THEN CASE WHEN up_table THEN '工作表: S' || chr(10) || '定位: row 0' || chr(10) || '字段: a、b' || chr(10) || up_content ELSE up_content END ELSE concat_ws(chr(10), '[前文邻近块]' || chr(10) || before,
      CASE WHEN role = 'qa_answer_fragment' AND turn % 10 = 1 THEN '[问题] Why ' || conv_id || chr(10) || CASE WHEN up_id IS NULL THEN '[命中答案片段] ' || child ELSE '[完整答案] ' || up_said END WHEN up_id IS NOT NULL THEN '[父块上下文] ' || up_said || chr(10) || '[命中子块] ' || child ELSE child END, '[后文邻近块]' || chr(10) || after) END AS context FROM y)
    SELECT k AS group_key, row_number() OVER (ORDER BY k) AS rank, CASE WHEN up THEN up_id ELSE chunk_id END AS shown, CASE WHEN up THEN 'complete_unit' ELSE 'leaf' END AS unit_kind, CASE WHEN up THEN up_content ELSE content END AS content, context, coalesce(array_to_string(tags, ','), '') AS tags FROM z LEFT JOIN t ON t.conv_id = z.conv_id"""
)
def hydrated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the unit shown, parent, question and neighbours in the context, and tags; some documents are gone."""
    turns = table(spark, sf_dir, "conversations")
    chunks = _chunks(spark, sf_dir)
    order = F.col("conv_id") * 1000 + F.col("turn")
    groups = turns.filter((F.col("conv_id") + F.col("turn")) % 3 == 0).select(order.alias("order"), F.lit(1.0).alias("score"), (F.col("conv_id") * 100 + F.col("turn")).alias("anchor"), F.lit("default").alias("scope"), F.col("conv_id").alias("kb_doc_id"))
    groups = numbered(groups, "group_key", "order")
    documents = turns.filter("conv_id % 4 <> 3").select(F.col("conv_id").alias("kb_doc_id"), F.concat(F.lit("c"), "conv_id").alias("title"), F.lit("").alias("doc_summary")).distinct()
    tags = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("kb_doc_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("tag"))
    out = hydration.hydrated(groups, chunks, documents, tags, "general", window=1)
    return out.select("group_key", "rank", "shown", "unit_kind", "content", "context", F.array_join("tags", ",").alias("tags"))


@query(
    """WITH h AS (SELECT user_id AS group_key, event_id AS seq, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS sheet, CASE WHEN value > 50 THEN 'p' || event_id END AS place, CASE WHEN event_id % 3 = 0 THEN ['f' || event_id % 7, ' '] END AS fields, event_type AS scope FROM events),
    f AS (SELECT group_key, name, min(seq) AS first FROM (SELECT group_key, seq, trim(unnest(fields)) AS name FROM h) WHERE name <> '' GROUP BY ALL)
    SELECT h.group_key, arg_min(sheet, seq) FILTER (WHERE sheet <> '') AS sheet, arg_min(place, seq) FILTER (WHERE place IS NOT NULL) AS place, array_to_string(list_sort(list(DISTINCT scope)), ',') AS scopes, (SELECT string_agg(name, ',' ORDER BY first) FROM f WHERE f.group_key = h.group_key) AS fields,
      arg_min('v' || seq, seq) FILTER (WHERE seq % 2 = 0) AS even FROM h GROUP BY 1"""
)
def group_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the hits of a group say of it: first texts, field names in order, first filter values."""
    key = F.col("event_id")
    none = F.lit(None).cast("string")
    hits = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("group_key"),
        key.alias("seq"),
        F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("sheet"),
        F.when(F.col("value") > 50, F.concat(F.lit("p"), key)).alias("place"),
        none.alias("context"),
        none.alias("question"),
        F.when(key % 3 == 0, F.array(F.concat(F.lit("f"), key % 7), F.lit(" "))).alias("fields"),
        F.when(key % 2 == 0, F.create_map(F.lit("even"), F.concat(F.lit("v"), key))).alias("filter_fields"),
        F.col("event_type").alias("scope"),
        F.lit("vector").alias("backend"),
    )
    out = hydration.group_metadata(hits)
    return out.select("group_key", "sheet", "place", F.array_join("scopes", ",").alias("scopes"), F.array_join("fields", ",").alias("fields"), F.col("filter_fields")["even"].alias("even"))


@query(
    """SELECT 'all' AS scope, count(*) AS items, count(DISTINCT user_id) AS documents, count(CASE WHEN value > 50 THEN 1 END) AS with_bonus FROM events
    UNION ALL SELECT event_type, count(*), NULL, NULL FROM events GROUP BY 1 UNION ALL SELECT 'odd', count(*), NULL, NULL FROM events WHERE event_id % 2 = 1"""
)
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of results, their documents, bonuses, and scopes."""
    scopes = F.when(F.col("event_id") % 2 == 1, F.array("event_type", F.lit("odd"))).otherwise(F.array("event_type"))
    items = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("kb_doc_id"), scopes.alias("scopes"), F.greatest(F.col("value") - 50, F.lit(0.0)).alias("bonus"), F.lit(None).cast("double").alias("boost"))
    whole, by_scope = hydration.result_summary(items)
    return whole.select(F.lit("all").alias("scope"), "items", "documents", "with_bonus").unionByName(by_scope, allowMissingColumns=True)
