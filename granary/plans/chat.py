"""Chats: here conversations are sessions, two turns a question and its answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import chat
from granary.plans.registry import query
from granary.sources.tables import table


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, conv = F.col("turn"), F.col("conv_id")
    status = F.when(turn % 7 == 3, "failed").when(turn % 2 == 1, "streaming").otherwise("completed")
    return table(spark, sf_dir, "conversations").select(
        conv.alias("session_id"), (conv * 100 + turn).alias("message_id"), F.floor(turn / 2).alias("turn_id"), "role", F.when(turn % 5 != 4, F.col("text")).otherwise(" ").alias("content"), status.alias("status"), (turn % 11 != 6).alias("visible"), turn.alias("created")
    )


@query(
    r"""WITH m AS (SELECT conv_id, turn, role, CASE WHEN turn % 5 <> 4 THEN trim(text, E' \n\t\r') ELSE '' END AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant') AND turn % 7 <> 3 AND turn % 11 <> 6 AND turn // 2 <> 0),
    g AS (SELECT doc_id AS conv_id, 0 AS part, k AS place, CASE WHEN k % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, 'said ' || k AS content FROM (SELECT doc_id, unnest(range(9)) AS k FROM labels WHERE quality = 1) WHERE k <> 4),
    b AS (SELECT * FROM g UNION ALL SELECT conv_id, 1, -n, role, content FROM m WHERE n <= 6 AND content <> ''),
    l AS (SELECT conv_id, list(role || ': ' || content ORDER BY part, place) AS items FROM b GROUP BY 1)
    SELECT conv_id AS session_id, array_to_string(items[greatest(1, len(items) - 11):], chr(10)) AS context FROM l"""
)
def query_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query's rewriting sees: given messages, then the latest six, twelve in all."""
    given = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("session_id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("place"))
    role = F.when(F.col("place") == 4, "system").when(F.col("place") % 2 == 0, " User").otherwise("assistant")
    given = given.select("session_id", "place", role.alias("role"), F.concat(F.lit(" said "), "place").alias("content"))
    out = chat.rewrite_context(_messages(spark, sf_dir), given, F.lit(0))
    return out.select("session_id", F.array_join(F.transform("context", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("context"))


@query(
    """WITH c AS (SELECT user_id * 100 + event_id % 6 AS message_id, string_agg(event_type || event_id, ',' ORDER BY event_id) AS citations FROM events GROUP BY 1)
    SELECT conv_id AS session_id, conv_id * 100 + turn AS message_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, turn // 2, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END)::INT AS place, coalesce(citations, '') AS citations FROM conversations LEFT JOIN c ON message_id = conv_id * 100 + turn"""
)
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of sessions in order, with what they cite."""
    cited = table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.col("event_id") % 6).alias("message_id"), F.col("event_id").alias("place"), F.concat("event_type", "event_id").alias("title"))
    return chat.listed_messages(_messages(spark, sf_dir), cited).select("session_id", "message_id", "place", F.array_join("citations", ",").alias("citations"))


RULES = "r AS (SELECT s_suppkey AS synonym_id, 'term ' || s_suppkey % 40 AS professional_term, s_suppkey % 3 = 0 AS own, s_suppkey * 10 + k AS variant_id, 'w' || (s_suppkey * 7 + k) % 60 AS user_term, s_suppkey % 5 AS priority FROM (SELECT s_suppkey, unnest(range(8)) AS k FROM supplier))"


@query(
    f"""WITH {RULES}, e AS (SELECT synonym_id, array_to_string(list_prepend(any_value(professional_term), list(user_term ORDER BY variant_id))[:6], ',') AS expansions FROM r GROUP BY 1),
    o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_term ORDER BY own DESC, priority DESC, synonym_id, variant_id) = 1)
    SELECT user_term, professional_term, CASE WHEN own THEN 'kb' ELSE 'tenant' END AS scope, expansions FROM o JOIN e USING (synonym_id)"""
)
def synonym_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule speaks for each user term, and its expansions."""
    return chat.synonym_map(_rules(spark, sf_dir)).withColumn("expansions", F.array_join("expansions", ","))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    return rows.select(key.alias("synonym_id"), F.concat(F.lit(" term  "), key % 40).alias("professional_term"), (key % 3 == 0).alias("own"), (key * 10 + F.col("k")).alias("variant_id"), F.concat(F.lit("w"), (key * 7 + F.col("k")) % 60).alias("user_term"), (key % 5).alias("priority"))


@query(
    f"""WITH {RULES}, o AS (SELECT user_term, professional_term FROM r QUALIFY row_number() OVER (PARTITION BY user_term ORDER BY own DESC, priority DESC, synonym_id, variant_id) = 1)
    SELECT p_partkey, 'show ' || coalesce(o.professional_term, 'w' || p_size) || ' of ' || p_name AS rewritten FROM part LEFT JOIN o ON user_term = 'w' || p_size"""
)
def rewritten_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User terms in queries replaced, the longest at each place."""
    queries = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("show w"), "p_size", F.lit(" of "), "p_name").alias("query"))
    return chat.rewritten(queries, "p_partkey", "query", chat.synonym_map(_rules(spark, sf_dir))).select("p_partkey", "rewritten")
