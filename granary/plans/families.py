"""Small families: bytes with unknown encoding, pipe rows, rows replaced by document, windows of ideographs, scopes and settings of a search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import analysis, lexical, qa, settings, table_rows, upserts
from granary.plans.registry import query
from granary.plans.segmentation import LETTERS, SIGNS, unspaced
from granary.sources import files
from granary.sources.scratch import scratch_path
from granary.sources.tables import table


@query(
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[^\x01-\x7F]', '', 'g') AS plain FROM documents)
    SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 3 = 0 THEN plain || 'ÿ' ELSE t END AS text, CASE WHEN doc_id % 3 = 0 THEN 'latin-1' ELSE 'utf-8' END AS encoding FROM d"""
)
def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read as bytes: those that no other encoding fits are taken as Latin."""
    t, key = F.coalesce("text", F.lit("")), F.col("doc_id")
    odd = F.concat(F.encode(F.regexp_replace(t, r"[^\x01-\x7F]", ""), "UTF-8"), F.unhex(F.lit("FF")))
    rows = table(spark, sf_dir, "documents").select(key.cast("string").alias("path"), F.when(key % 3 == 0, odd).otherwise(F.encode(t, "UTF-8")).alias("content"))
    return files.decoded(rows)


@query("SELECT p_partkey, '| ' || p_name || ' | ' || p_brand || '\\|' || p_type || ' | a<br>b |  |' AS line FROM part")
def pipe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pipe tables, with bars and line ends in cells marked."""
    values = F.array("p_name", F.concat("p_brand", F.lit("|"), "p_type"), F.lit("a\nb"), F.lit(None))
    return table(spark, sf_dir, "part").select("p_partkey", files.markdown_row(values).alias("line"))


@query(
    """WITH r AS (SELECT l_orderkey AS doc, 'sheet ' || l_returnflag AS sheet, l_linenumber AS row_no, max(l_quantity) AS quantity FROM lineitem GROUP BY ALL),
    n AS (SELECT doc, sheet, row_no + 100 AS row_no, quantity FROM r WHERE doc % 4 = 1 AND row_no <= 3)
    SELECT *, sha256(doc || '|' || sheet || '|' || row_no) AS row_uid FROM (SELECT * FROM r WHERE doc NOT IN (SELECT doc FROM n) UNION ALL SELECT * FROM n)"""
)
def replaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents' sheets under lasting names; documents that come again replace all their earlier rows, the others stay."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.concat(F.lit("sheet "), "l_returnflag").alias("sheet"), F.col("l_linenumber").alias("row_no")).agg(F.max("l_quantity").alias("quantity"))
    again = rows.filter("doc % 4 = 1 and row_no <= 3").withColumn("row_no", F.col("row_no") + 100)
    path = scratch_path(spark, "rows-by-document")
    # A folder holds the documents of one bucket, so that folders stay few however many documents there are.
    bucket = F.pmod(F.xxhash64("doc"), F.lit(16))
    stored = "doc long, sheet string, row_no int, quantity double, bucket int"
    for part in (rows, again):
        new = part.select("doc", "sheet", F.col("row_no").cast("int").alias("row_no"), F.col("quantity").cast("double").alias("quantity"), bucket.cast("int").alias("bucket"))
        if part is again:
            known = spark.read.schema(stored).parquet(path)
            stay = known.join(new.select("doc").distinct(), "doc", "left_anti").join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi").select(*new.columns)
            # Folders are exchanged once all rows are written, so that they can be read until then.
            new = new.unionByName(stay)
        upserts.replace_partitions(new, path, "bucket")
    # Names follow from what is stored: they are neither written nor sent along.
    return table_rows.row_uids(spark.read.schema(stored).parquet(path), "doc", "sheet", "row_no").select("doc", "sheet", "row_no", "quantity", "row_uid")


@query(
    f"""WITH p AS (SELECT p_partkey, translate(p_name || ' ', '{LETTERS} ', '{SIGNS} ') AS name, translate(replace(p_name, ' ', ''), '{LETTERS}', '{SIGNS}') AS run FROM part), s AS (SELECT translate(unnest(['red', 'in']), '{LETTERS}', '{SIGNS}') AS stop),
    w AS (SELECT p_partkey, run, i, substring(run, i, 2) AS w FROM (SELECT *, unnest(range(1, length(run))) AS i FROM p)),
    k AS (SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM s, range(1, 40) t(j) WHERE substring(run, j, length(stop)) = stop AND w.i < j + length(stop) AND w.i + 2 > j))
    SELECT p_partkey, run AS term, 0 AS place FROM p UNION ALL SELECT p_partkey, w, dense_rank() OVER (PARTITION BY p_partkey ORDER BY first)::INT FROM (SELECT p_partkey, w, min(i) AS first FROM k GROUP BY 1, 2)"""
)
def ideograph_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ideographs and their two-letter windows that touch no stopword."""
    stops = [w.translate(str.maketrans(LETTERS, SIGNS)) for w in ("red", "in")]
    rows = table(spark, sf_dir, "part").select("p_partkey", unspaced("p_name").alias("body"))
    return rows.select("p_partkey", F.posexplode(lexical.unstopped_windows("body", stops)).alias("place", "term"))


_KINDS = {
    "general": ({}, ["default", "summary", "question", "answer", "row", "page_body"], ["default", "summary", "doc_summary", "question", "keyword", "answer", "row", "row_fragment", "page_body"]),
    "asked": ({"asked": ["keyword", "summary", "doc_summary"]}, ["summary"], ["keyword", "summary", "doc_summary"]),
    "table": ({}, ["row"], ["row", "row_group", "row_fragment", "keyword"]),
    "qa": ({"qa": {}}, ["question"], ["question", "keyword"]),
    "qa_answers": ({"qa": {"index_mode": "question_answer", "enable_keyword_recall": False}}, ["question", "answer"], ["question", "answer"]),
}
_SCOPES = ("default", "summary", "doc_summary", "question", "answer", "keyword", "row", "row_group", "row_fragment", "page_body")
_IN = lambda scopes: ", ".join(f"'{s}'" for s in scopes)


@query(
    f"WITH u AS (SELECT event_id, [{_IN(_SCOPES)}][event_id % 10 + 1] AS scope FROM events) "
    + " UNION ALL ".join(f"SELECT '{k}' AS kind, '{side}' AS backend, scope, count(*) AS n, min(event_id) AS first FROM u WHERE scope IN ({_IN(s)}) GROUP BY scope" for k, (_, v, w) in _KINDS.items() for side, s in (("vector", v), ("lexical", w)))
)
def scoped_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that each backend reads of collections of each kind, by scope."""
    units = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, _SCOPES)), (F.col("event_id") % 10 + 1).cast("int")).alias("scope"))
    out = []
    for kind, (how, *_) in _KINDS.items():
        config = qa.retrieval_config(how["qa"]) if "qa" in how else None
        asked = how.get("asked")
        of = kind.split("_")[0] if kind in ("qa", "qa_answers", "table") else "general"
        for side, scopes in (("vector", settings.vector_scopes(of, asked, config)), ("lexical", settings.lexical_scopes(of, asked, config))):
            found = units.filter(F.col("scope").isin(*scopes))
            out.append(found.groupBy(F.lit(kind).alias("kind"), F.lit(side).alias("backend"), "scope").agg(F.count("*").alias("n"), F.min("event_id").alias("first")))
    return reduce(DataFrame.unionByName, out)


@query(
    """WITH p AS (SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || p_brand) AS body, list_distinct(string_split(lower(replace(p_name || ' ' || p_type || ' ' || p_brand, '#', ' ')), ' ')) AS tokens FROM part),
    s AS (SELECT *, len(list_intersect(tokens, ['show', 'red', 'ring', 'band', 'crimson'])) AS found FROM p WHERE list_has_any(tokens, ['show', 'red', 'ring', 'band', 'crimson'])),
    r AS (SELECT p_partkey, CASE WHEN found = 5 THEN 0.72 ELSE 0 END + found / 5.0 * 0.28 + CASE WHEN contains(body, 'ring band') THEN 0.08 * 2.0 ELSE 0 END + CASE WHEN contains(body, 'ring') THEN 0.04 * 2.0 ELSE 0 END + CASE WHEN contains(body, 'red') THEN 0.03 ELSE 0 END
      + CASE WHEN contains(body, 'ring band') THEN 0.9 * 2.0 ELSE 0 END + CASE WHEN contains(body, 'ring') THEN 0.45 * 2.0 ELSE 0 END + CASE WHEN contains(body, 'show red ring band crimson') THEN 0.25 ELSE 0 END AS raw FROM s)
    SELECT p_partkey, round(raw / (raw + 0.8), 4) AS score FROM r ORDER BY score DESC, p_partkey LIMIT 50"""
)
def configured_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search as a collection's, a session's and a request's settings say: lexicon and stopwords merged, terms that the query holds
    favoured, synonyms added; the fifty best (a setting)."""
    collection = {"retrieval_test": {"top_k": 20, "query": {"auto_filter_mode": "rule"}}, "query_analysis": {"retrieval_lexicon": [{"term": "Ring band", "aliases": ["ring"], "weight": 2.0}], "retrieval_stopwords": ["of"]}}
    chat = settings.chat_settings(collection, {"top_k": 50}, {"retrieval": {"query": {"auto_filter_mode": "off"}}})
    asked = settings.query_settings(collection["query_analysis"], {"retrieval_stopwords": ["Please"]}, [{"term": "ring band", "aliases": ["band of rings"], "weight": 1.0}], ["the"])
    words = lexical.merged_stopwords(asked["retrieval_stopwords"], ["the", "# not a word"], collection["query_analysis"]["retrieval_stopwords"])
    text = lexical.lexical_query("show the red ring of Please", "show red ring band", [("crimson", ["red"])], words)
    lexicon = spark.createDataFrame([(i, x["term"], x["aliases"], x["weight"], x["enabled"]) for i, x in enumerate(asked["retrieval_lexicon"])], "item_no int, term string, aliases array<string>, weight double, enabled boolean")
    one = spark.createDataFrame([(1, text)], "query_id int, query string")
    matches = [r.asDict() | {"is_phrase": True} for r in analysis.match_lexicon(one, lexicon).collect()]  # of a request's own lexicon
    aliases = [{**m, "matched_text": "ring"} for m in matches]
    terms, phrases, weights = lexical.priority_hints([*matches, *aliases], ["red"])
    plan = lexical.query_plan(text, priority_terms=terms, priority_phrases=phrases, stopwords=words, weights={k.lower(): v for k, v in weights.items()})
    body = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    rows = table(spark, sf_dir, "part").select("p_partkey", body.alias("text"))
    return lexical.recall(rows, plan, chat["top_k"], tie="p_partkey").select("p_partkey", "score")
