"""What queries say about folders, tags, fields and terms; here part descriptions are the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import analysis
from granary.plans.registry import query
from granary.sources.tables import table

Q = "q AS (SELECT p_partkey AS query_id, 'Show ' || p_name || ' of ' || p_type || ' by ' || p_brand AS query FROM part)"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Show "), "p_name", F.lit(" of "), "p_type", F.lit(" by "), "p_brand")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), text.alias("query"))


@query(
    f"""WITH {Q}, f AS (SELECT min(p_partkey) AS folder_id, p_brand AS name, p_type || ' by ' || p_brand AS path, length(p_brand) AS level, max(p_partkey) AS updated FROM part GROUP BY p_brand, p_type),
    m AS (SELECT query_id, folder_id, level, updated, CASE WHEN contains(lower(query), lower(path)) THEN path ELSE name END AS value, CASE WHEN contains(lower(query), lower(path)) THEN 0.99 ELSE 0.93 END AS confidence FROM q JOIN f ON contains(lower(query), lower(name)) OR contains(lower(query), lower(path)))
    SELECT query_id, folder_id::VARCHAR AS target, value, m.confidence::DOUBLE AS confidence, CASE WHEN m.confidence = 0.99 THEN 'folder_path' ELSE 'folder_name' END AS source, row_number() OVER (PARTITION BY query_id ORDER BY level DESC, updated DESC, folder_id)::INT AS rank FROM m QUALIFY rank <= 3"""
)
def query_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that a query names, by name or by full path."""
    part = table(spark, sf_dir, "part")
    folders = part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("folder_id"), F.max("p_partkey").alias("updated"))
    folders = folders.select("folder_id", F.col("p_brand").alias("name"), F.concat("p_type", F.lit(" by "), "p_brand").alias("path"), F.lit(None).cast("string").alias("summary"), F.length("p_brand").alias("level"), "updated")
    return analysis.match_folders(_queries(spark, sf_dir), folders).drop("filter_type")


TAGS = """t AS (SELECT word AS name, min(p_partkey) AS tag_id, max(p_partkey) AS updated, min(p_partkey) % 3 = 0 AS own, CASE WHEN word = 'ring' THEN ['ECONOMY', 'x'] WHEN word = 'red' THEN ['brand#1', 'a'] ELSE []::VARCHAR[] END AS aliases
  FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> 'bolt' GROUP BY word)"""


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("name")).groupBy("name").agg(F.min("p_partkey").alias("tag_id"), F.max("p_partkey").alias("updated"))
    aliases = F.when(F.col("name") == "ring", F.array(F.lit("ECONOMY"), F.lit("x"))).when(F.col("name") == "red", F.array(F.lit("brand#1"), F.lit("a"))).otherwise(F.array().cast("array<string>"))
    types = F.when(F.col("name") == "bolt", F.array(F.lit("folder"))).otherwise(F.array(F.lit("kb_doc"), F.lit("folder")))
    return words.select("tag_id", "name", aliases.alias("aliases"), (F.col("tag_id") % 3 == 0).alias("own"), "updated", types.alias("target_types"))


@query(
    f"""WITH {Q}, {TAGS}, m AS (SELECT query_id, tag_id, own, updated, CASE WHEN contains(lower(query), name) THEN name ELSE list_filter(aliases, lambda a: length(a) > 1 AND contains(lower(query), lower(a)))[1] END AS value, CASE WHEN contains(lower(query), name) THEN 0.95 ELSE 0.92 END AS confidence FROM q, t
      WHERE contains(lower(query), name) OR len(list_filter(aliases, lambda a: length(a) > 1 AND contains(lower(query), lower(a)))) > 0)
    SELECT query_id, tag_id::VARCHAR AS target, value, m.confidence::DOUBLE AS confidence, CASE WHEN m.confidence = 0.95 THEN 'tag_name' ELSE 'tag_alias' END AS source, row_number() OVER (PARTITION BY query_id ORDER BY own DESC, updated DESC, tag_id)::INT AS rank FROM m QUALIFY rank <= 5"""
)
def query_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that a query names, by name or alias."""
    return analysis.match_tags(_queries(spark, sf_dir), _tags(spark, sf_dir)).drop("filter_type")


FIELDS = """o AS (SELECT 0 AS field_no, 'tier' AS field, p_type AS value, 0 AS text_no, p_type AS text, ['show', 'z'] AS hints FROM (SELECT DISTINCT p_type FROM part)
  UNION ALL SELECT 1, 'maker', substr(p_brand, 7), 1, p_brand, ['maker'] FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 2, 'color', w, 0, w, ['hue', 'of'] FROM (SELECT unnest(['red', 'blue', 'green']) AS w))"""


@query(
    f"""WITH {Q}, {FIELDS}, m AS (SELECT query_id, field_no, field, value, text_no, least(0.99, round(CASE WHEN text = value THEN 0.96 ELSE 0.92 END + CASE WHEN len(list_filter(hints, lambda h: length(h) > 1 AND contains(lower(query), h))) > 0 THEN 0.02 ELSE 0 END, 4)) AS confidence FROM q JOIN o ON contains(lower(query), lower(text)))
    SELECT query_id, field AS target, value, confidence::DOUBLE AS confidence FROM m QUALIFY row_number() OVER (PARTITION BY query_id, field ORDER BY confidence DESC, text_no, length(value) DESC, value DESC) = 1"""
)
def query_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of fields that a query names: surer if the field is named, too. Of values that hold one another the longest counts."""
    part = table(spark, sf_dir, "part")
    hints = lambda *h: F.array(*map(F.lit, h))
    tiers = part.select("p_type").distinct().select(F.lit(0).alias("field_no"), F.lit("tier").alias("field"), F.col("p_type").alias("value"), F.lit(0).alias("text_no"), F.col("p_type").alias("text"), hints("show", "z").alias("hints"))
    makers = part.select("p_brand").distinct().select(F.lit(1).alias("field_no"), F.lit("maker").alias("field"), F.substring("p_brand", 7, 9).alias("value"), F.lit(1).alias("text_no"), F.col("p_brand").alias("text"), hints("maker").alias("hints"))
    colors = part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct().filter(F.col("w").isin("red", "blue", "green")).select(F.lit(2).alias("field_no"), F.lit("color").alias("field"), F.col("w").alias("value"), F.lit(0).alias("text_no"), F.col("w").alias("text"), hints("hue", "of").alias("hints"))
    options = tiers.unionByName(makers).unionByName(colors)
    return analysis.match_fields(_queries(spark, sf_dir), options).select("query_id", "target", "value", "confidence")


@query(
    f"""WITH {Q}, l AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS item_no, p_type AS term, [p_name, ' '] AS aliases, p_size / 10.0 - 1 AS weight, p_partkey % 7 <> 0 AS enabled FROM part),
    m AS (SELECT query_id, item_no::INT AS item_no, term, round(greatest(0, least(2, weight)), 4)::DOUBLE AS weight, CASE WHEN contains(lower(query), lower(term)) THEN term ELSE aliases[1] END AS matched_text FROM q JOIN l ON item_no < 120 AND enabled AND (contains(lower(query), lower(term)) OR contains(lower(query), lower(aliases[1]))))
    SELECT * FROM m"""
)
def query_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon items of which a query contains the term or an alias."""
    items = table(spark, sf_dir, "part")
    lexicon = items.select(F.col("p_partkey").cast("int").alias("item_no"), F.col("p_type").alias("term"), F.array("p_name", F.lit(" ")).alias("aliases"), (F.col("p_size") / 10.0 - 1).alias("weight"), (F.col("p_partkey") % 7 != 0).alias("enabled"))
    return analysis.match_lexicon(_queries(spark, sf_dir), lexicon)


@query(
    f"""WITH {Q}, g AS (SELECT p_partkey AS entry_id, p_name AS term, p_partkey % 2 = 0 AS own FROM part), f AS (SELECT p_partkey AS query_id, p_name AS term FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey, 'red widget' FROM part WHERE p_partkey % 4 = 0),
    b AS (SELECT query_id, g.* FROM q JOIN g ON contains(lower(query), lower(term)) UNION SELECT query_id, g.* FROM f JOIN g USING (term)),
    o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, lower(term) ORDER BY own DESC, entry_id) = 1)
    SELECT query_id, entry_id, term, row_number() OVER (PARTITION BY query_id ORDER BY own DESC, entry_id)::INT AS rank FROM o QUALIFY rank <= 2"""
)
def query_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary entries that a query contains or that synonyms force on it."""
    part = table(spark, sf_dir, "part")
    glossary = part.select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("term"), (F.col("p_partkey") % 2 == 0).alias("own"))
    forced = part.filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("term"))
    forced = forced.unionByName(part.filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("query_id"), F.lit("red widget").alias("term")))
    return analysis.glossary_entries(_queries(spark, sf_dir), glossary, forced, 2).select("query_id", "entry_id", "term", "rank")


CANDIDATES = """c AS (SELECT user_id AS query_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'tag_id' WHEN 'click' THEN 'folder_tag_id' WHEN 'error' THEN 'search_unit_metadata' ELSE 'document_metadata' END AS filter_type, (event_id % 5)::VARCHAR AS target, 'v' || (event_id % 3) AS value, value / 200 AS confidence,
  CASE WHEN event_id % 2 = 0 THEN 'llm' ELSE 'rule' END AS layer, CASE WHEN event_id % 7 = 0 THEN 'rejected' WHEN event_id % 7 = 1 THEN 'pending' ELSE 'validated' END AS status FROM events)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("event_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"),
        key.alias("seq"),
        F.when(kind == "view", "tag_id").when(kind == "click", "folder_tag_id").when(kind == "error", "search_unit_metadata").otherwise("document_metadata").alias("filter_type"),
        (key % 5).cast("string").alias("target"),
        F.concat(F.lit("v"), key % 3).alias("value"),
        (F.col("value") / 200).alias("confidence"),
        F.when(key % 2 == 0, "llm").otherwise("rule").alias("layer"),
        F.when(key % 7 == 0, "rejected").when(key % 7 == 1, "pending").otherwise("validated").alias("status"),
    )


@query(
    f"""WITH {CANDIDATES}, s AS (SELECT query_id, filter_type, target, arg_max(value, seq) AS says FROM c WHERE layer = 'llm' AND status = 'validated' AND confidence >= 0.3 GROUP BY ALL)
    SELECT c.query_id, seq, CASE WHEN says <> value THEN 'corrected_by_llm' ELSE status END AS status, CASE WHEN says <> value THEN says END AS corrected_to FROM c LEFT JOIN s USING (query_id, filter_type, target) WHERE layer = 'rule'"""
)
def reconciled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule candidates that a sure model candidate corrects."""
    c = _candidates(spark, sf_dir)
    return analysis.reconciled(c.filter("layer = 'rule'"), c.filter("layer = 'llm'"), 0.3).select("query_id", "seq", "status", "corrected_to")


@query(
    f"""WITH {CANDIDATES}, k AS (SELECT *, CASE WHEN filter_type = 'tag_id' THEN 'doc_tag' WHEN filter_type = 'folder_tag_id' THEN 'folder_tag' ELSE filter_type END AS signal, CASE WHEN filter_type LIKE '%tag_id' THEN 'boost' WHEN target = '1' THEN 'match_only' ELSE 'match_or_missing' END AS match_mode FROM c
      WHERE status <> 'rejected' AND (filter_type LIKE '%tag_id' OR (layer = 'llm' AND (target = '1' OR (target = '2' AND filter_type = 'document_metadata')))))
    SELECT query_id, seq, signal, target, value, match_mode FROM k QUALIFY row_number() OVER (PARTITION BY query_id, signal, target, value ORDER BY seq) = 1"""
)
def filter_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as signals: tags boost, known fields of a model filter."""
    fields = spark.createDataFrame([("document_metadata", "1", "match_only"), ("search_unit_metadata", "1", "match_only"), ("document_metadata", "2", "other")], "filter_type string, target string, match_mode string")
    return analysis.filter_signals(_candidates(spark, sf_dir), fields).drop("confidence")
