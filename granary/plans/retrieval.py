"""Recall, fusion, reranking and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import scoring, text
from granary.operators import retrieval
from granary.operators.retrieval import Search
from granary.plans.registry import query
from granary.sources.tables import table


def _query_vector(embeddings: DataFrame) -> list[float]:
    return [float(x) for x in embeddings.orderBy("vec_id").select("embedding").first()[0]]


COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
FIRST = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q"


@query(f"SELECT vec_id, {COSINE} AS score FROM embeddings e, {FIRST} ORDER BY score DESC, vec_id LIMIT 25")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return retrieval.vector_recall(embeddings, _query_vector(embeddings), 25).select("vec_id", "score")


@query(f"SELECT label, vec_id, {COSINE} AS score, row_number() OVER (PARTITION BY label ORDER BY {COSINE} DESC, vec_id) AS rank FROM embeddings e, {FIRST} QUALIFY rank <= 5")
def vector_topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of each collection, scored in one job."""
    embeddings = table(spark, sf_dir, "embeddings")
    q = F.array(*map(F.lit, _query_vector(embeddings)))
    scored = embeddings.withColumn("score", F.round(scoring.cosine(F.col("embedding"), q), 6))
    return retrieval.best_of_each(scored, "label", 5, [F.desc("score"), F.col("vec_id")]).select("label", "vec_id", "score", "rank")


PUNCT = text.LEXICAL_PUNCTUATION.replace("'", "''")
NORM = f"trim(regexp_replace(translate(lower(text), '{PUNCT}', '{' ' * len(text.LEXICAL_PUNCTUATION)}'), '\\s+', ' ', 'g'))"


@query(
    f"""WITH t AS (SELECT doc_id, text, list_distinct(string_split({NORM}, ' ')) AS tokens FROM documents),
    s AS (SELECT doc_id, CASE WHEN list_has_all(tokens, ['the', 'thing']) THEN 0.72 ELSE 0 END + len(list_intersect(tokens, ['thing', 'license', 'version'])) / 3.0 * 0.28
      + CASE WHEN contains(lower(text), 'apache license') THEN 0.9 ELSE 0 END + CASE WHEN contains(lower(text), 'version') THEN 0.04 ELSE 0 END AS raw FROM t
      WHERE list_has_all(tokens, ['the', 'thing']) OR list_has_any(tokens, ['the', 'thing', 'license', 'version']))
    SELECT doc_id, round(CASE WHEN raw <= 0 THEN 0 ELSE round(raw / (raw + 0.8), 4) END, 4) AS score FROM s ORDER BY score DESC, doc_id LIMIT 40"""
)
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token recall with phrase and term boosts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = retrieval.lexical_recall(docs, ["the", "thing"], ["thing", "license", "version"], [("apache license", 1.0)], [("version", 0.5)], 40)
    return found.select("doc_id", "score")


Q = "thing of the"
GRAMS = "CASE WHEN length({c}) = 0 THEN []::VARCHAR[] WHEN length({c}) = 1 THEN [{c}] ELSE list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2))) END"


@query(
    f"""WITH d AS (SELECT item_id, text AS body FROM benchmark), b AS (SELECT item_id, body, {GRAMS.format(c="lower(trim(regexp_replace('passage ' || body, '\\s+', ' ', 'g')))")} AS g, {GRAMS.format(c=f"'{Q}'")} AS q FROM d)
    SELECT item_id, round(least(1, 0.75 * len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q)))::DOUBLE + 0.25 * (contains(lower('passage ' || body), 'thing')::INT + contains(lower('passage ' || body), 'of')::INT + contains(lower('passage ' || body), 'the')::INT) / 3.0), 6) AS score FROM b ORDER BY score DESC, item_id LIMIT 15"""
)
def summary_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by title and summary."""
    rows = table(spark, sf_dir, "benchmark").withColumn("summary", F.col("text"))
    score = F.round(text.summary_score(F.lit(Q), F.lit("passage"), "summary"), 6)
    return rows.select("item_id", score.alias("score")).orderBy(F.desc("score"), "item_id").limit(15)


FUSE_SQL = """
WITH h AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'vector' ELSE 'lexical' END AS backend, event_id, user_id AS group_key, event_id AS chunk,
  CASE WHEN value < 60 THEN 'answer' WHEN value < 120 THEN 'row_fragment' WHEN value < 160 THEN 'question' ELSE 'other' END AS scope, least(value / 250, 1.0) AS score, (event_id % 10) * 0.01 AS boost, 0.0 AS bonus FROM events),
s AS (SELECT *, row_number() OVER (ORDER BY CASE backend WHEN 'vector' THEN 0 ELSE 1 END, event_id) AS seq FROM h),
k AS (SELECT * FROM s WHERE score >= CASE backend WHEN 'vector' THEN 0.1 ELSE 0.05 END),
r AS (SELECT *, coalesce(max(CASE WHEN backend = 'vector' THEN score END) OVER w, 0) AS v, coalesce(max(CASE WHEN backend = 'lexical' THEN score END) OVER w, 0) AS l,
  len(list_distinct(list(scope) OVER w)) AS scopes, len(list_distinct(list(backend) OVER w)) AS backends, count(*) OVER (PARTITION BY group_key, scope ORDER BY seq) AS n,
  CASE scope WHEN 'answer' THEN 0.94 WHEN 'row_fragment' THEN 0.84 WHEN 'question' THEN 0.96 ELSE 0.82 END AS weight FROM k WINDOW w AS (PARTITION BY group_key ORDER BY seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, v * 0.65 + l * 0.35 AS weighted, CASE scope WHEN 'answer' THEN least(0.08, (n - 1) * 0.02) WHEN 'row_fragment' THEN least(0.05, (n - 1) * 0.015) ELSE 0 END AS rep, greatest(0, least(0.1, boost)) AS cb FROM r),
f AS (SELECT *, round(least(1.0, weighted * weight + least(0.20, least(0.12, (scopes - 1) * 0.03) + CASE WHEN backends >= 2 THEN 0.05 ELSE 0 END + rep + bonus
  + CASE WHEN weighted * weight < 0.20 THEN 0 WHEN weighted * weight < 0.35 THEN round(cb * 0.5, 4) ELSE round(cb, 4) END)), 6) AS fused FROM b),
g AS (SELECT group_key, max(fused) AS score, arg_max(chunk, (fused, seq)) AS anchor, min(seq) AS first_seq, count(*) AS hits FROM f GROUP BY 1 ORDER BY score DESC, first_seq LIMIT 40)
SELECT group_key, score, anchor, hits FROM g WHERE score >= 0.3
"""


@query(FUSE_SQL)
def hybrid_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and lexical hits fused into groups."""
    value = F.col("value")
    scope = F.when(value < 60, "answer").when(value < 120, "row_fragment").when(value < 160, "question").otherwise("other")
    backend = F.when(F.col("event_type").isin("view", "click"), "vector").otherwise("lexical")
    hits = table(spark, sf_dir, "events").select(backend.alias("backend"), "event_id", F.col("user_id").alias("group_key"), F.col("event_id").alias("chunk"), scope.alias("scope"), F.least(value / 250, F.lit(1.0)).alias("score"), (F.col("event_id") % 10 * 0.01).alias("boost"), F.lit(0.0).alias("bonus"))
    # Vector hits before lexical ones, then by id; only the order matters.
    hits = hits.withColumn("seq", F.when(F.col("backend") == "vector", F.lit(0)).otherwise(F.lit(1 << 40)) + F.col("event_id"))
    search = Search(rerank_n=40, vector_threshold=0.1, lexical_threshold=0.05, threshold=0.3).clamped()
    return retrieval.fuse(hits, search).select("group_key", "score", "anchor", "hits")


@query(
    """WITH t AS (SELECT doc_id, text, round(length(text) / 20000.0, 6) AS score FROM documents), c AS (SELECT * FROM t ORDER BY score DESC, doc_id LIMIT 60),
    f AS (SELECT doc_id, round(0.9 * score + 0.1 * (contains(lower(text), 'the')::INT + contains(lower(text), 'license')::INT) / 2.0, 6) AS final FROM c)
    SELECT doc_id, final FROM f WHERE final >= 0.2 ORDER BY final DESC, doc_id LIMIT 20"""
)
def cross_kb_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of several collections merged and rescored by the query's terms."""
    items = table(spark, sf_dir, "documents").select("doc_id", "text", F.round(F.length("text") / 20000.0, 6).alias("score"))
    return retrieval.merge_collections(items, "the license", Search(top_k=20, rerank_n=60), least=0.2).select("doc_id", "final")


@query(
    """WITH c AS (SELECT o_orderkey, round(o_totalprice / 600000, 6) AS rerank_score FROM orders ORDER BY rerank_score DESC, o_orderkey LIMIT 30)
    SELECT o_orderkey, rerank_score, row_number() OVER (ORDER BY rerank_score DESC, o_orderkey) AS rank FROM c"""
)
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rerank(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") / 600000, 30, "o_orderkey").select("o_orderkey", "rerank_score", "rank")


@query(
    """WITH b AS (SELECT DISTINCT l_orderkey AS target, l_suppkey AS tag, l_linenumber - 1 AS distance FROM lineitem), s AS (SELECT s_suppkey AS tag, (s_acctbal + 1000) / 11000 AS confidence, CASE WHEN s_suppkey % 3 = 0 THEN 'llm' WHEN s_suppkey % 3 = 1 THEN 'alias' ELSE 'rule' END AS source FROM supplier),
    g AS (SELECT target, tag, max(0.04 * confidence * CASE source WHEN 'llm' THEN 1.0 WHEN 'alias' THEN 0.9 ELSE 0.95 END * CASE WHEN distance <= 0 THEN 1.0 WHEN distance = 1 THEN 0.75 WHEN distance = 2 THEN 0.55 ELSE greatest(0.3, pow(0.75, distance)) END) AS gain FROM b JOIN s USING (tag) GROUP BY 1, 2)
    SELECT target, round(least(0.1, sum(gain)), 4) AS boost FROM g GROUP BY 1"""
)
def tag_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bindings = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_suppkey").alias("tag"), (F.col("l_linenumber") - 1).alias("distance")).distinct()
    source = F.when(F.col("s_suppkey") % 3 == 0, "llm").when(F.col("s_suppkey") % 3 == 1, "alias").otherwise("rule")
    signals = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tag"), ((F.col("s_acctbal") + 1000) / 11000).alias("confidence"), source.alias("source"))
    return retrieval.tag_boosts(bindings, signals)


@query("SELECT event_id, round(CASE WHEN value <= 0 THEN 0 ELSE round(value / (value + 0.8), 4) END, 4) AS score FROM events")
def lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-ended ranks drawn into 0 to 1."""
    return table(spark, sf_dir, "events").select("event_id", F.round(text.lexical_score(F.col("value")), 4).alias("score"))


@query("SELECT o_orderkey, CASE WHEN NOT p AND NOT c THEN 'root_leaf' WHEN NOT p THEN 'root' WHEN NOT c THEN 'leaf' ELSE 'intermediate' END AS kind FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS p, o_orderkey % 3 = 0 AS c FROM orders)")
def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.topology(key % 2 == 0, key % 3 == 0).alias("kind"))


@query(
    """WITH b AS (SELECT o_orderkey AS target, left(o_orderpriority, 1) AS a, left(o_orderpriority, 1) || '.' || o_orderstatus AS f FROM orders), t AS (SELECT '1' AS folder, 'x' AS tag UNION ALL SELECT '1.F', 'x' UNION ALL SELECT '2', 'y' UNION ALL SELECT '2.O', 'z')
    SELECT target, tag, min(CASE WHEN folder = f THEN 0 ELSE 1 END) AS distance FROM b JOIN t ON folder = a OR folder = f GROUP BY 1, 2"""
)
def ancestor_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of documents' folders and of those above, with their distance."""
    folder = F.concat(F.substring("o_orderpriority", 1, 1), F.lit("."), "o_orderstatus")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target"), folder.alias("folder"))
    tags = spark.createDataFrame([("1", "x"), ("1.F", "x"), ("2", "y"), ("2.O", "z")], "folder string, tag string")
    return retrieval.ancestor_tags(docs, tags)


@query("SELECT min(l_linenumber) + l_orderkey * 10 AS chunk_id, 'doc_summary' AS search_scope, 'A summary of order ' || l_orderkey || ' by clerk and date' AS search_text, 35 AS priority, false AS vectorize FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey")
def summary_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of documents' summaries on their first chunks; summaries that say too little give none."""
    key = F.col("l_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(key.alias("doc"), (key * 10 + F.col("l_linenumber")).alias("chunk_id"))
    said = F.when(F.col("doc") % 2 == 0, F.concat(F.lit("A summary  of order "), "doc", F.lit(" by clerk and date"))).otherwise("none of it")
    return retrieval.summary_units(lines, lines.select("doc").distinct().withColumn("summary", said))
