"""Chunking and projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import chunking
from granary.plans.registry import query
from granary.sources.tables import table


@query("SELECT doc_id, (i // 400)::INT AS position, i::INT AS start, substr(text, i + 1, 500) AS content FROM (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS i FROM documents WHERE length(text) > 0)")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.fixed_chunks(docs, "text", 500, 100).select("doc_id", "position", "start", "content")


@query("SELECT doc_id, (i // 400)::INT AS position, substr(text, i + 1, 500) AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 100, 1), 400)) AS i FROM documents WHERE length(text) > 0)")
def windows_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that stop once the text is covered."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.fixed_chunks(docs, "text", 500, 100, stop_at_end=True).select("doc_id", "position", "content")


def _pieces(df: DataFrame, pieces, key: str = "doc_id") -> DataFrame:
    return df.select(key, F.posexplode(pieces).alias("position", "content"))


# Packing in one reduction over strings: chr(1) parts chunks, chr(3) the pieces of one. A chunk's last piece begins the next
# one where both fit.
PIECES = "list_filter(list_transform({split}, lambda x: trim(x, E' \\n\\t\\r\\x0b\\x0c')), lambda x: x <> '')"
PACK = """CASE WHEN len(pieces) = 0 THEN []::VARCHAR[] ELSE string_split(list_reduce(pieces, lambda acc, x: CASE WHEN {whole} + {size_x} <= {budget} THEN acc || chr(3) || x
  WHEN {last} + {size_x} <= {budget} THEN acc || chr(1) || string_split(string_split(acc, chr(1))[-1], chr(3))[-1] || chr(3) || x ELSE acc || chr(1) || x END), chr(1)) END"""


def _packed_sql(split: str, size: str, budget: int, joiner: str, carry: bool = True, source: str = "SELECT doc_id AS id, text FROM documents") -> str:
    """SQL that packs the pieces of each text; size: SQL of a piece {{p}}'s size."""
    of = lambda p: size.replace("{p}", p)
    cur = "string_split(acc, chr(1))[-1]"
    whole = f"list_sum(list_transform(string_split({cur}, chr(3)), lambda y: {of('y')}))"
    last = of(f"string_split({cur}, chr(3))[-1]") if carry else str(budget)
    pack = PACK.format(whole=whole, size_x=of("x"), last=last, budget=budget)
    return f"WITH t AS ({source}), p AS (SELECT id, {PIECES.format(split=split)} AS pieces FROM t), c AS (SELECT id, {pack} AS parts FROM p) SELECT id AS {{key}}, (i - 1)::INT AS position, replace(parts[i], chr(3), {joiner}) AS content FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM c)"


SENTENCES = r"string_split(regexp_replace(text, '([.!?。！？])\s*', '\1' || chr(4), 'g'), chr(4))"
UNITS = r"coalesce(list_sum(list_transform(regexp_extract_all({p}, '[一-鿿㐀-䶿　-〿＀-￯]|[\p{L}\p{N}_]+|[^\s]'), lambda q: CASE WHEN length(q) > 8 THEN (length(q) + 3) // 4 ELSE 1 END)), 0)"


@query(_packed_sql(SENTENCES, "length({p})", 600, "' '").replace("{key}", "doc_id"))
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed to 600 characters with one sentence carried over."""
    return _pieces(table(spark, sf_dir, "documents"), chunking.sentence_chunks("text", 600, 1))


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, then sentences, then words, then characters, packed to 400."""
    return _pieces(table(spark, sf_dir, "documents"), chunking.recursive_chunks("text", 400))


@query(_packed_sql("string_split(text, chr(10))", UNITS, 120, "chr(10) || chr(10)").replace("{key}", "doc_id"))
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs packed to 120 units, the last carried over."""
    paragraphs = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return _pieces(table(spark, sf_dir, "documents"), chunking.paragraph_chunks(paragraphs, 120, 1))


@query("SELECT doc_id, length(text) > 4000 OR len(regexp_extract_all(text, '(?m)^\\s*(?:#{1,6} |[-*+] |\\d+[.)] |\\||```|>)')) > 5 AS complex FROM documents")
def complex_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", chunking.is_complex("text").alias("complex"))


@query(
    """WITH l AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations)
    SELECT conv_id, section::BIGINT AS section, max(CASE WHEN role = 'user' THEN trim(regexp_replace(text, '[\\s#]+', ' ', 'g')) END) AS heading, count(CASE WHEN role <> 'user' THEN 1 END) AS n_lines FROM l WHERE section > 0 GROUP BY 1, 2""".replace("\\\\", "\\")
)
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown sections; here user turns are headings of a conversation's text."""
    flat = F.regexp_replace("text", r"[\s#]+", " ")
    line = F.when(F.col("role") == "user", F.concat(F.lit("## "), flat)).otherwise(F.concat(F.lit("x "), F.regexp_replace("text", r"[\s#]+", " ")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(parts, "\n").alias("body"))
    sections = chunking.heading_sections(whole, "conv_id", "body").filter("section > 0")
    lines = F.when(F.coalesce("content", F.lit("")) == "", 0).otherwise(F.size(F.split("content", "\n"))).cast("long")
    return sections.select("conv_id", "section", F.col("heading"), lines.alias("n_lines"))


@query("SELECT l_orderkey, l_linenumber, 'flag: ' || l_returnflag || '; status: ' || l_linestatus AS content, ((l_linenumber - 1) // 3)::INT AS shard FROM lineitem")
def row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.lit("flag"), F.lit("none"), F.lit("status")).alias("h"), F.array("l_returnflag", F.lit(" "), "l_linestatus").alias("v"))
    return chunking.table_row_chunks(rows, "l_orderkey", "h", "v", "l_linenumber", 3)


@query(
    """WITH n AS (SELECT user_id, event_id, event_type, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10)::INT AS chunk FROM events)
    SELECT user_id, chunk, 'user,event' || chr(10) || string_agg(event_type, chr(10) ORDER BY event_id) AS content, count(*) AS n_rows FROM n GROUP BY 1, 2"""
)
def packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return chunking.packed_rows(rows, "user_id", "event_id", "event_type", F.lit("user,event"), 10)


@query(
    """WITH c AS (SELECT p_partkey AS chunk_id, p_name AS content, CASE WHEN p_size > 10 THEN p_type ELSE ' ' END AS summary, CASE WHEN p_size % 2 = 0 THEN ['What is ' || p_name || '?'] ELSE []::VARCHAR[] END AS questions, string_split(p_type, ' ') AS keywords, p_size <> 7 AS vectorize FROM part),
    u AS (SELECT chunk_id, 'default' AS search_scope, content AS search_text, 20 AS priority FROM c WHERE vectorize UNION ALL SELECT chunk_id, 'summary', summary, 30 FROM c WHERE vectorize UNION ALL SELECT chunk_id, 'question', unnest(questions), 10 FROM c WHERE vectorize UNION ALL SELECT chunk_id, 'keyword', array_to_string(keywords, ' '), 50 FROM c WHERE vectorize)
    SELECT *, sha256(search_text) AS search_text_hash FROM u WHERE trim(search_text) <> ''"""
)
def search_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed search units of enriched chunks."""
    part = table(spark, sf_dir, "part")
    questions = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("What is "), "p_name", F.lit("?")))).otherwise(F.array().cast("array<string>"))
    chunks = part.select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("content"), F.when(F.col("p_size") > 10, F.col("p_type")).otherwise(" ").alias("summary"), questions.alias("questions"), F.split("p_type", " ").alias("keywords"), (F.col("p_size") != 7).alias("vectorize"))
    return chunking.search_units(chunks).drop("unit_no")


@query("SELECT c_custkey, c_custkey // 3 AS parent_id, NOT EXISTS (SELECT 1 FROM customer d WHERE d.c_custkey // 3 = c.c_custkey AND d.c_custkey > 0) AS is_leaf FROM customer c WHERE c_custkey > 0")
def leaf_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").filter("c_custkey > 0").select("c_custkey", F.floor(F.col("c_custkey") / 3).alias("parent_id"))
    return chunking.leaf_flags(nodes, "c_custkey", "parent_id")
