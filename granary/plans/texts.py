"""Text functions over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text
from granary.operators import analysis
from granary.plans.registry import query
from granary.sources.tables import table

PUNCT = text.LEXICAL_PUNCTUATION.replace("'", "''")
NORM = f"trim(regexp_replace(translate(lower(text), '{PUNCT}', '{' ' * len(text.LEXICAL_PUNCTUATION)}'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {NORM} AS normalized FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_lexical("text").alias("normalized"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({NORM}, '[A-Za-z0-9][A-Za-z0-9_./:-]*'), lambda t: trim(t, '.:/-_')), lambda t: length(t) >= 2))), ' ') AS terms FROM documents")
def ascii_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(text.ascii_terms("text")), " ").alias("terms"))


MIXED = "CASE WHEN item_id % 2 = 0 THEN text || '统计表格，x统计 ｆ extraordinarily' ELSE text END"


@query(f"SELECT item_id, list_sum(list_transform(regexp_extract_all({MIXED}, '[一-鿿㐀-䶿　-〿＀-￯]|[\\p{{L}}\\p{{N}}_]+|[^\\s]'), lambda p: CASE WHEN length(p) > 8 THEN (length(p) + 3) // 4 ELSE 1 END))::BIGINT AS units FROM benchmark")
def mixed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of texts, with ideographs and wide marks in every other one."""
    body = F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit("统计表格，x统计 ｆ extraordinarily"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", text.mixed_units(body).alias("units"))


BIGRAMS = "list_distinct(list_transform(range(1, greatest(length({c}), 2)), lambda i: substr({c}, i, 2)))"


@query(
    f"""WITH b AS (SELECT item_id, {BIGRAMS.format(c="lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))")} AS g FROM benchmark)
    SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::DOUBLE, 6) AS jaccard FROM b a JOIN b ON b.item_id = a.item_id + 1"""
)
def bigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared bigrams of each passage with the next one."""
    b = table(spark, sf_dir, "benchmark").select("item_id", text.bigrams(F.col("text")).alias("g"))
    pairs = b.select(F.col("item_id").alias("a"), F.col("g").alias("x")).join(b.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("g").alias("y")), "a")
    return pairs.select("a", "b", F.round(text.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query(
    """WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM benchmark)
    SELECT a.item_id AS a, round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t))::DOUBLE, 6) AS overlap FROM t a JOIN t b ON b.item_id = a.item_id + 1"""
)
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", text.terms("text").alias("t"))
    pairs = b.select(F.col("item_id").alias("a"), F.col("t").alias("x")).join(b.select((F.col("item_id") - 1).alias("a"), F.col("t").alias("y")), "a")
    return pairs.select("a", F.round(text.overlap_coefficient(F.col("x"), F.col("y")), 6).alias("overlap"))


@query("SELECT doc_id, CASE WHEN length(c) <= 80 THEN c ELSE rtrim(substr(c, 1, 77)) || '...' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated("text", 80).alias("snippet"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS matched FROM documents")
def match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.match_text("text").alias("matched"))


@query("SELECT doc_id, round(CASE WHEN length(regexp_replace(text, '\\s', '', 'g')) = 0 THEN 0 ELSE length(regexp_replace(text, '[^0-9]', '', 'g')) / length(regexp_replace(text, '\\s', '', 'g'))::DOUBLE END, 6) AS density, length(regexp_replace(text, '[^0-9A-Za-z\\x{4e00}-\\x{9fff}]', '', 'g')) AS chars FROM documents")
def numeric_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.numeric_density("text"), 6).alias("density"), text.meaningful_chars("text").alias("chars"))


STRIP = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>', ' ', 'g'), '(?is)<style.*?>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s{2,}', ' ', 'g'), chr(10) || chr(13) || chr(9) || ' ')"


@query(f"SELECT page_id, {STRIP} AS body FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html("html").alias("body"))


@query("SELECT page_id, lower(regexp_extract(b, '^([^:]+://[^/?]*)', 1)) || regexp_replace(regexp_extract(regexp_replace(b, '^[^:]+://[^/?]*', ''), '^([^?]*)', 1), '/+$', '') || regexp_extract(b, '(\\?.*)$', 1) AS url FROM (SELECT page_id, regexp_replace(CASE WHEN regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN trim(url) ELSE 'https://' || trim(url) END, '#.*$', '') AS b FROM pages)")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_url("url").alias("url"))


@query(f"""SELECT page_id, length(regexp_replace({STRIP}, '[^0-9A-Za-z\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS chars FROM pages""")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that count in a page's text."""
    return table(spark, sf_dir, "pages").select("page_id", text.meaningful_chars(text.strip_html("html")).alias("chars"))


LINKED = "text || chr(10) || CASE doc_id % 4 WHEN 0 THEN '[a](b) short' WHEN 1 THEN '[a](b) and a long line of words that says much more than any link' WHEN 2 THEN 'see http://x.yz' ELSE '[a](b) [c](d) ' || repeat('word ', 20) END"
SAID = "length(regexp_replace(l, '[^0-9A-Za-z\\x{4e00}-\\x{9fff}]', '', 'g'))"


@query(f"SELECT doc_id, len(list_filter(list_transform(string_split({LINKED}, chr(10)), lambda l: trim(l)), lambda l: l <> '' AND (len(regexp_extract_all(l, '\\[[^\\]]+\\]\\([^)]+\\)')) >= 2 OR (len(regexp_extract_all(l, '\\[[^\\]]+\\]\\([^)]+\\)')) >= 1 AND {SAID} <= 40) OR (len(regexp_extract_all(l, '(?i)https?://')) >= 1 AND {SAID} <= 30)))) AS n FROM documents")
def link_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are mostly links; each text has one more line that may be one."""
    key = F.col("doc_id") % 4
    line = F.when(key == 0, "[a](b) short").when(key == 1, "[a](b) and a long line of words that says much more than any link").when(key == 2, "see http://x.yz").otherwise("[a](b) [c](d) " + "word " * 20)
    return table(spark, sf_dir, "documents").select("doc_id", text.link_lines(F.concat("text", F.lit("\n"), line)).alias("n"))


@query("SELECT p_partkey, array_to_string(list_distinct_ordered, ';') AS tags FROM (SELECT p_partkey, list_filter(list_transform(string_split_regex(replace(p_type, ' ', ' ; '), '[，,；;\n]'), lambda x: trim(x)), lambda x: x <> '') AS list_distinct_ordered FROM part)")
def tags_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags out of a cell with separators."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.tags_of(F.replace("p_type", F.lit(" "), F.lit(" ; "))), ";").alias("tags"))


@query("""SELECT c_custkey, sha256('{"acct": "' || c_mktsegment || '", "name": "' || c_name || '"}') AS hash FROM customer""")
def row_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of a row as JSON with sorted keys."""
    row = F.create_map(F.lit("name"), F.col("c_name"), F.lit("acct"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.row_hash(row).alias("hash"))


ASKED = "CASE conv_id % 5 WHEN 0 THEN '如何 ' || text WHEN 1 THEN '排查步骤' WHEN 2 THEN '地区统计' || left(text, 12) WHEN 3 THEN '原因' ELSE text END"


@query(f"SELECT conv_id, turn, length(t) <= 18 AS short_query, regexp_matches(t, '如何|怎么|为什么|原因|是否|能否|哪些|什么') AS question_like, regexp_matches(t, '步骤|处理|解决|配置|设置|排查|修复|原因|办法') AS answer_like, regexp_matches(t, '统计|汇总|合计|平均|同比|环比|筛选|地区|年份|产品') AS table_like FROM (SELECT conv_id, turn, {NORM.replace('text', 'asked')} AS t FROM (SELECT conv_id, turn, {ASKED} AS asked FROM conversations))")
def query_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query's words and length say of what it wants."""
    key = F.col("conv_id") % 5
    asked = F.when(key == 0, F.concat(F.lit("如何 "), "text")).when(key == 1, "排查步骤").when(key == 2, F.concat(F.lit("地区统计"), F.substring("text", 1, 12))).when(key == 3, "原因").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.query_traits(asked).alias("t")).select("conv_id", "turn", "t.*")


@query("SELECT p_partkey, array_to_string(CASE WHEN p_size % 2 = 0 THEN ['x', p_name] ELSE [p_name, 'y-' || p_size] END, '|') AS kept FROM part")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords that may be indexed: none general, long, like sentences or of one ideograph, each once but for case, marks
    at the ends gone. Here the first of them, two of each part."""
    odd = F.array(F.lit("文档"), F.lit("图"), F.lit("k" * 41), F.lit("整句。"), F.lit(" ,; "), F.lit(None).cast("string"))
    even = F.concat(odd, F.array(F.lit("x"), F.concat(F.lit(" "), "p_name", F.lit(" ;")), F.upper("p_name"), F.lit("late")))
    other = F.concat(odd, F.array("p_name", F.concat(F.lit("y-"), "p_size"), F.concat(F.lit("Y-"), "p_size"), F.lit("late")))
    values = F.when(F.col("p_size") % 2 == 0, even).otherwise(other)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.keywords(values, 2), "|").alias("kept"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Is this the customer ' || c_name || '?' WHEN 1 THEN 'where is ' || c_name || '？|Second one？' ELSE '' END AS kept FROM customer")
def question_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made fit for the index: short and vague ones go, equal ones but for case count once, a mark is put where none is."""
    key = F.col("c_custkey") % 3
    asked = F.when(key == 0, F.concat(F.lit(" Is this  the customer "), "c_name", F.lit("?"))).when(key == 1, F.concat(F.lit("where is "), "c_name")).otherwise("这个问题如何处理?")
    more = F.when(key == 1, "Second one").otherwise("这是什么 really")
    kept = text.questions(F.array(F.lit("no"), asked, F.upper(asked), more, F.lit("它是什么意思")), 5)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(kept, "|").alias("kept"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) < 8 END AS low FROM documents")
def low_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries that say nothing: short ones, set phrases, empty openings of short ones."""
    key = F.col("doc_id") % 5
    body = F.when(key == 0, " 暂无摘要 ").when(key == 1, "主要介绍了一些内容").when(key == 2, "主要介绍了一些内容以及其他很多很多有用的东西").when(key == 3, "Short.").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.low_value_summary(body).alias("low"))


@query("SELECT doc_id, sum(len(string_split(text, w)) - 1)::BIGINT AS hits FROM documents, (SELECT unnest(['the ', 'de ', 'der ']) AS w) GROUP BY 1")
def dictionary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often dictionary terms stand in each text."""
    words = ["the ", "de ", "der "]
    hits = [F.size(F.split(text.col("text"), w, -1)) - 1 for w in words]
    return table(spark, sf_dir, "documents").select("doc_id", sum(hits[1:], hits[0]).cast("long").alias("hits"))


@query("SELECT doc_id, min(w) AS first_term, count(*) AS n_terms FROM documents JOIN (SELECT DISTINCT lower(p_brand) AS w FROM part UNION SELECT unnest(['the', 'und', 'que', 'les'])) ON contains(lower(text), w) GROUP BY 1")
def glossary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary entries contained in each text."""
    words = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("w")).unionByName(spark.createDataFrame([("the",), ("und",), ("que",), ("les",)], "w string")).distinct()
    found = analysis.dictionary_matches(table(spark, sf_dir, "documents"), "doc_id", "text", words, "w")
    return found.groupBy("doc_id").agg(F.min("w").alias("first_term"), F.count("*").alias("n_terms"))
