"""Filters of a retrieval request on documents: here orders are documents, their lines tag bindings and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import candidates, filters, lexical, retrieval
from granary.plans.registry import query
from granary.sources.tables import table

ID = r"\d+"
NOW = "2000-01-01"

DOCS = """d AS (SELECT o_orderkey AS kb_doc_id, o_custkey AS document_id, left(o_orderpriority, 1) || '.' || o_orderstatus AS folder, o_orderdate, o_orderstatus, o_orderpriority, o_totalprice,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS custom_status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_custkey % 7)::VARCHAR END AS info_lane FROM orders WHERE o_orderkey % 10 <> 9),
t AS (SELECT l_orderkey AS kb_doc_id, list(DISTINCT l_linenumber::VARCHAR) AS tags FROM lineitem GROUP BY 1), a AS (SELECT d.*, coalesce(tags, []::VARCHAR[]) AS tags FROM d LEFT JOIN t USING (kb_doc_id))"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    custom = F.to_json(F.struct(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"), F.struct(F.substring("o_orderpriority", 1, 1).alias("rank")).alias("deep")))
    info = F.to_json(F.struct(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 7).alias("lane")))
    return o.select(
        F.col("o_orderkey").alias("kb_doc_id"),
        F.col("o_custkey").alias("document_id"),
        F.concat(F.substring("o_orderpriority", 1, 1), F.lit("."), "o_orderstatus").alias("folder"),
        F.when(F.col("o_orderkey") % 10 == 9, "failed").otherwise("completed").alias("status"),
        F.lit(True).alias("enabled"),
        custom.alias("custom"),
        info.alias("info"),
        F.col("o_orderdate").alias("parsed_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


def _tagged(spark: SparkSession, sf_dir: str, folders: bool = False) -> DataFrame:
    bindings = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("tag"))
    # Folders of status F carry tag 1, those of priority 2 tag 2.
    paths = _docs(spark, sf_dir).select(F.col("folder").alias("target")).distinct()
    marks = paths.filter(F.col("target").endswith("F")).withColumn("tag", F.lit("1")).unionByName(paths.filter(F.col("target").startswith("2")).withColumn("tag", F.lit("2")))
    return candidates.with_tags(_docs(spark, sf_dir), bindings, marks if folders else None)


def _resolved(spark: SparkSession, sf_dir: str, raw: dict, mode: str = "all", signals=None, folders: bool = False) -> DataFrame:
    f = candidates.normalized(raw, mode, pattern=ID if not raw.get("folder_ids") else r"[\w.]+")
    return candidates.candidate_documents(_tagged(spark, sf_dir, folders), f, F.lit(NOW).cast("timestamp"), signals).select("kb_doc_id", "document_id")


@query(f"WITH {DOCS} SELECT kb_doc_id, document_id FROM a WHERE (folder = '1' OR folder LIKE '1.%' OR folder = '2.F') AND list_has_all(tags, ['1', '2']) AND coalesce(custom_status = 'F', false)")
def candidates_by_folder_tag_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with all below it or a single one, two tags, and one metadata value."""
    return _resolved(spark, sf_dir, {"folder_ids": ["1", "2.F", "bad id!"], "tag_ids": ["1", "2", "1"], "metadata": {"status": "F"}})


@query(f"WITH {DOCS} SELECT kb_doc_id, document_id FROM a WHERE o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY")
def candidates_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, {}, "latest")


@query(f"WITH {DOCS} SELECT kb_doc_id, document_id FROM a WHERE len(tags) > 0 AND folder LIKE '2.F'")
def candidates_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever has a tag, in folders that carry two tags."""
    return _resolved(spark, sf_dir, {"folder_tag_ids": ["1", "2"]}, "tagged", folders=True)


EXPRESSION = {
    "op": "or",
    "items": [
        {"op": "and", "items": [{"op": "in", "field": "folder", "values": ["3"]}, {"op": "not_in", "field": "tag", "values": ["3", "4"]}]},
        {"op": "and", "items": [{"op": "eq", "field": "document_metadata", "path": ["deep", "rank"], "values": ["5"]}, {"op": "not", "items": [{"op": "in", "field": "document", "values": [str(i) for i in range(60)]}]}, {"op": "ne", "field": "metadata", "path": ["lane"], "values": ["2"]}]},
        {"op": "and", "items": [{"op": "not_exists", "field": "metadata", "path": ["lane"]}, {"op": "exists", "field": "tag"}, {"op": "in", "field": "folder_tag", "values": ["2"]}]},
    ],
}


@query(
    f"""WITH {DOCS} SELECT kb_doc_id, document_id FROM a WHERE (folder LIKE '3.%' AND NOT list_has_any(tags, ['3', '4']))
    OR (left(o_orderpriority, 1) = '5' AND document_id >= 60 AND (info_lane IS NULL OR info_lane <> '2')) OR (info_lane IS NULL AND len(tags) > 0 AND folder LIKE '2.%')"""
)
def candidates_by_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree over folders, tags, folder tags, ids and nested metadata of two sources."""
    return _resolved(spark, sf_dir, {"filter_expression": EXPRESSION}, folders=True)


@query(f"WITH {DOCS} SELECT kb_doc_id, document_id FROM a WHERE (custom_status IN ('F', 'P') OR custom_status IS NULL) AND coalesce(info_lane IN ('1', '3'), false)")
def candidates_by_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected metadata filters: one lets documents without a value pass, the other doesn't. The signals of a query are
    few; they are drawn together first."""
    rows = [("status", "F", "match_or_missing"), ("status", "P", "match_or_missing"), ("lane", "1", "match_or_missing"), ("lane", "3", "match_only"), ("lane", " ", "match_only")]
    drawn = candidates.collected_signals(spark.createDataFrame(rows, "key string, value string, match_mode string"))
    return _resolved(spark, sf_dir, {}, signals={r["key"]: (r["mode"], r["values"]) for r in drawn.collect()})


@query(f"WITH {DOCS} SELECT l_orderkey * 10 + l_linenumber AS group_id FROM lineitem JOIN a ON kb_doc_id = l_orderkey WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_suppkey % 11 <> 0 AND custom_status = 'P'")
def table_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata filters on a table's filterable columns are tested on its rows."""
    f = candidates.table_fields(candidates.normalized({"metadata": {"flag": "R", "line": "F", "status": "P", "none": ""}}), ["flag", "line", "none"])
    docs = candidates.candidate_documents(_tagged(spark, sf_dir), f, F.lit(NOW).cast("timestamp"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("group_id"), F.col("l_orderkey").alias("kb_doc_id"), F.to_json(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line"))).alias("row_data"), (F.col("l_suppkey") % 11 == 0).alias("deleted"))
    return candidates.table_groups(rows, docs, f)


@query(f"WITH {DOCS} SELECT l_orderkey * 10 + l_linenumber AS group_id FROM lineitem JOIN a ON kb_doc_id = l_orderkey WHERE l_returnflag = 'A' AND (l_linestatus = 'O' OR l_linenumber = 3) AND l_quantity < 40")
def qa_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and tag of a request are tested on questions and answers."""
    f = candidates.qa_fields(candidates.normalized({"metadata": {"category": " A ", "tags": "hot"}}))
    docs = candidates.candidate_documents(_tagged(spark, sf_dir), f, F.lit(NOW).cast("timestamp"))
    tags = F.array_compact(F.array(F.when(F.col("l_linestatus") == "O", "hot"), F.when(F.col("l_linenumber") == 3, "hot"), F.lit("any")))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("group_id"), F.col("l_orderkey").alias("kb_doc_id"), F.col("l_returnflag").alias("category"), tags.alias("tags"), (F.col("l_quantity") < 40).alias("enabled"))
    return candidates.qa_groups(rows, docs, f)


def _search_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    scope = F.when(F.col("o_orderstatus") == "F", "default").when(F.col("o_orderstatus") == "O", "doc_summary").otherwise("keyword")
    units = o.select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderkey").alias("chunk_id"), scope.alias("scope"), (F.col("o_totalprice") > 50000).alias("active"), F.to_json(F.struct(F.substring("o_orderpriority", 1, 1).alias("state"))).alias("unit_meta"))
    chunks = o.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("kb_doc_id"), (F.col("o_orderkey") % 4 != 0).alias("is_leaf"), (F.col("o_orderkey") % 6 != 0).alias("chunk_active"))
    return units, chunks


GATES = "o_totalprice > 50000 AND kb_doc_id % 6 <> 0"
BODY = "lower(p_name || ' ' || p_type || ' ' || CASE WHEN p_size > 25 THEN 'big' ELSE 'little' END)"


@query(
    f"""WITH {DOCS}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0)
    SELECT kb_doc_id AS unit_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e JOIN a ON kb_doc_id = vec_id, q
    WHERE {GATES} AND ((o_orderstatus = 'F' AND kb_doc_id % 4 <> 0) OR o_orderstatus = 'O') AND (left(o_orderpriority, 1) <> '1' OR list_contains(tags, '2')) ORDER BY score DESC, unit_id LIMIT 50"""
)
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors joined with units, chunks and candidate documents, filtered by a tree over units and tags, then the nearest."""
    units, chunks = _search_tables(spark, sf_dir)
    docs = candidates.candidate_documents(_tagged(spark, sf_dir), candidates.FilterSet(), F.lit(NOW).cast("timestamp"))
    node = filters.parse({"op": "or", "items": [{"op": "ne", "field": "search_unit_metadata", "path": ["state"], "values": ["1"]}, {"op": "eq", "field": "tag", "values": ["2"]}]})
    embeddings = table(spark, sf_dir, "embeddings")
    index = embeddings.select(F.col("vec_id").alias("unit_id"), "embedding")
    found = candidates.searchable_units(index, units, chunks, docs, ("default", "doc_summary"), 64, node)
    first = embeddings.filter("vec_id = 0").select("embedding").first()
    return retrieval.vector_recall(found, [float(x) for x in first[0]], 50, tie="unit_id").select("unit_id", "score")


@query(
    f"""WITH {DOCS}, p AS (SELECT p_partkey, {BODY} AS body, list_distinct(string_split({BODY}, ' ')) AS tokens FROM part),
    s AS (SELECT kb_doc_id AS unit_id, body, tokens FROM a JOIN p ON p_partkey = document_id WHERE {GATES} AND o_orderstatus = 'P' AND kb_doc_id % 4 <> 0 AND list_has_any(tokens, ['red', 'ring', 'economy'])),
    r AS (SELECT unit_id, CASE WHEN list_has_all(tokens, ['red', 'ring', 'economy']) THEN 0.72 ELSE 0 END + len(list_intersect(tokens, ['red', 'ring', 'economy'])) / 3.0 * 0.28 + CASE WHEN contains(body, 'ring') THEN 0.08 * 2.0 ELSE 0 END + CASE WHEN contains(body, 'red ring') THEN 0.9 ELSE 0 END + CASE WHEN contains(body, 'red ring economy') THEN 0.45 ELSE 0 END AS raw FROM s)
    SELECT unit_id, round(round(raw / (raw + 0.8), 4), 4) AS score FROM r ORDER BY score DESC, unit_id LIMIT 60"""
)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's plan of strict, loose and weighted terms over index rows joined with units, chunks and documents."""
    units, chunks = _search_tables(spark, sf_dir)
    docs = candidates.candidate_documents(_tagged(spark, sf_dir), candidates.FilterSet(), F.lit(NOW).cast("timestamp"))
    body = F.concat_ws(" ", "p_name", "p_type", F.when(F.col("p_size") > 25, "big").otherwise("little"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("o_custkey"), body.alias("text"))
    index = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), "o_custkey").join(parts, "o_custkey")
    found = candidates.searchable_units(index, units, chunks, docs, ("keyword",))
    plan = lexical.query_plan("The red ring economy", priority_terms=["ring"], priority_phrases=["red ring"], stopwords=["the"], weights={"ring": 2.0})
    return lexical.recall(found, plan, 60, tie="unit_id").select("unit_id", "score")
