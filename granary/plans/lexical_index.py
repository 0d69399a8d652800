"""The kept lexical index: built, changed, deleted from, searched in one go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text
from granary.operators.lexical_index import LexicalIndex, query_plans
from granary.plans.registry import query
from granary.sources.scratch import scratch_path
from granary.sources.tables import table

_MARKS = text.LEXICAL_PUNCTUATION.replace("'", "''")
_BLANKS = " " * len(text.LEXICAL_PUNCTUATION)


def words_sql(c: str) -> str:
    """The different normalised words of a text, in SQL."""
    return f"list_filter(list_distinct(regexp_split_to_array(translate(lower({c}), '{_MARKS}', '{_BLANKS}'), '[\\s　]+')), lambda w: w <> '')"


def counts_sql(body: str, rows: str) -> str:
    return f"SELECT token, count(*) AS units, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, unnest({words_sql(body)}) AS token FROM {rows}) GROUP BY token"


def _units(spark: SparkSession, sf_dir: str, changed: Column | None = None) -> DataFrame:
    body = F.col("text") if changed is None else F.when(changed, F.concat(F.coalesce("text", F.lit("")), F.lit(" Changed zebra"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), F.coalesce("source", F.lit("none")).alias("scope"), body.alias("text"))


def _built(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    index = LexicalIndex(spark, scratch_path(spark, "lexical-index"), 32)
    index.upsert(_units(spark, sf_dir))
    return index


def _counts(index: LexicalIndex) -> DataFrame:
    return index.postings().groupBy("token").agg(F.count("*").alias("units"), F.min("unit_id").alias("first"), F.max("unit_id").alias("last"))


@query(counts_sql("coalesce(text, '')", "documents"))
def index_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many units hold each token, from the index on disk."""
    return _counts(_built(spark, sf_dir))


@query(counts_sql("body", "(SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN coalesce(text, '') || ' Changed zebra' ELSE coalesce(text, '') END AS body FROM documents)"))
def index_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after every unit came again, of which a seventh had changed: only these are written."""
    index = _built(spark, sf_dir)
    index.upsert(_units(spark, sf_dir, F.col("doc_id") % 7 == 3))
    return _counts(index)


@query(
    counts_sql("body", "(SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN coalesce(text, '') || ' Changed zebra' ELSE coalesce(text, '') END AS body FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 15 = 6)")
)
def index_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a third of the units was taken out and a fifth came again in another form, drawn into one generation."""
    index = _built(spark, sf_dir)
    index.delete(_units(spark, sf_dir).filter("unit_id % 3 = 0"))
    index.upsert(_units(spark, sf_dir, F.lit(True)).filter("unit_id % 5 = 1"))
    index.compacted()
    index.cleaned()
    return _counts(index)


@query(
    f"""WITH d AS (SELECT doc_id, coalesce(source, 'none') AS scope, lower(trim(coalesce(text, ''))) AS body, {words_sql("coalesce(text, '')")} AS tokens FROM documents),
    q AS (SELECT item_id AS query_id, array_to_string(list_filter(string_split(trim(regexp_replace(translate(lower(array_to_string(string_split(text, ' ')[1:6], ' ')), '{_MARKS}', '{_BLANKS}'), '[\\s　]+', ' ', 'g')), ' '), lambda w: w NOT IN ('the', 'of')), ' ') AS whole FROM benchmark),
    w AS (SELECT query_id, whole, list_distinct(string_split(whole, ' ')) AS words FROM q WHERE whole <> ''),
    h AS (SELECT query_id, doc_id, scope, body, whole, words, len(list_intersect(tokens, words)) AS found FROM w, d WHERE list_has_any(tokens, words)),
    r AS (SELECT query_id, doc_id AS unit_id, scope, CASE WHEN found = len(words) THEN 0.72 ELSE 0 END + found / len(words)::DOUBLE * 0.28 + CASE WHEN contains(body, whole) THEN 0.9 ELSE 0 END AS raw FROM h),
    s AS (SELECT query_id, unit_id, scope, round(round(raw / (raw + 0.8), 4), 4) AS score FROM r)
    SELECT query_id, unit_id, scope, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id, scope) AS rank FROM s QUALIFY rank <= 20"""
)
def index_batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of every benchmark passage sought at once."""
    opening = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), opening.alias("text"))
    return _built(spark, sf_dir).search(query_plans(queries, ["the", "of"]), 20)
