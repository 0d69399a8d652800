"""Functions from the registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text, udfs
from granary.operators import settings
from granary.plans.registry import query
from granary.sources.tables import table


@query("SELECT p_partkey, replace(replace(replace(p_type, 'STANDARD', '@1'), 'PROMO', '@2'), '@', '#') AS rewritten FROM part")
def synonym_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary terms replaced in one pass."""
    return table(spark, sf_dir, "part").select("p_partkey", udfs.replace_longest(F.col("p_type"), {"STANDARD": "#1", "PROMO": "#2"}).alias("rewritten"))


@query("SELECT doc_id, len(regexp_extract_all(text, 'the |de |der '))::INT AS hits FROM documents")
def stopword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(udfs.stopword_hits(F.col("text"), ["de ", "der ", "the "], 1_000_000)).alias("hits"))


@query("SELECT conv_id, turn, (i // 40)::INT AS position, substr(text, i + 1, 50) AS content FROM (SELECT conv_id, turn, text, unnest(range(0, length(text), 40)) AS i FROM conversations)")
def sql_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the registered table function, in SQL."""
    udfs.register_all(spark)
    table(spark, sf_dir, "conversations").createOrReplaceTempView("granary_conversations")
    return spark.sql("SELECT conv_id, turn, c.position, c.content FROM granary_conversations, LATERAL fixed_chunks(text, 50, 10) c")


@query("SELECT doc_id, (i // 450)::INT AS position, substr(text, i + 1, 500) AS content FROM (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS i FROM documents)")
def registered_chunker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udfs.chunked(table(spark, sf_dir, "documents"), "text", "fixed", size=500, overlap=50).select("doc_id", "position", "content")


@query()
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the stand-in model's vectors."""
    return udfs.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "vector")


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('minute', ts) + INTERVAL 1 MINUTE * (15 - minute(ts) % 15) WHEN 1 THEN CASE WHEN ts < date_trunc('day', ts) + INTERVAL 510 MINUTE THEN date_trunc('day', ts) + INTERVAL 510 MINUTE ELSE date_trunc('day', ts) + INTERVAL 1950 MINUTE END
      WHEN 2 THEN date_trunc('month', ts) + INTERVAL 1 MONTH END AS next_at FROM events"""
)
def cron_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When cron expressions fire next: every quarter of an hour, daily, on the first of the month, never."""
    key = F.col("event_id") % 4
    expression = F.when(key == 0, "*/15 * * * *").when(key == 1, "30 8 * * *").when(key == 2, "0 0 1 * *")
    return table(spark, sf_dir, "events").select("event_id", udfs.next_cron_trigger(expression, F.col("ts")).alias("next_at"))


@query("""SELECT c_custkey, sha256('{"a":"' || c_name || '","b":' || c_nationkey || ',"c":' || CASE WHEN c_custkey % 2 = 0 THEN '["' || c_mktsegment || '"]' ELSE 'null' END || '}') AS hash FROM customer""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of structured rows, whatever the order in which fields are named."""
    fields = {"c": F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment")), "a": F.col("c_name"), "b": F.col("c_nationkey")}
    return table(spark, sf_dir, "customer").select("c_custkey", text.content_hash(fields).alias("hash"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'vector ' || p_name ELSE p_type END AS body FROM part")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What vectors are made of."""
    own = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" vector "), "p_name")).when(F.col("p_size") % 4 == 1, " ")
    return table(spark, sf_dir, "part").select("p_partkey", text.embedding_text(own, F.col("p_type")).alias("body"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 3 THEN NULL ELSE '{"a": {"b": "' || p_name || '"}}' END AS json FROM part""")
def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects in answers: bare, fenced, between words; and what is none."""
    body = F.concat(F.lit('{"a": {"b": "'), "p_name", F.lit('"}}'))
    n = F.col("p_size") % 5
    answer = F.when(n == 0, body).when(n == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).when(n == 3, F.concat(F.lit("{broken: "), "p_name")).otherwise(F.concat(F.lit("  "), body))
    return table(spark, sf_dir, "part").select("p_partkey", text.lenient_json(answer).alias("json")).withColumn("json", F.trim("json"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_returnflag = 'A' THEN 'row_fragment' ELSE 'row' END WHEN l_returnflag = 'N' THEN 'page_body' ELSE 'default' END AS scope FROM lineitem")
def default_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope of a chunk's own text."""
    source = F.when(F.col("l_linestatus") == "O", "table").when(F.col("l_returnflag") == "N", "web")
    role = F.when(F.col("l_returnflag") == "A", " excel_row_fragment ")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", settings.default_scope(F.coalesce(source, F.lit("text")), role, "general").alias("scope"))
