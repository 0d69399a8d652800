"""Elements of pages; here lines of an order are lines of a page, turns of a conversation its texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators import layout
from granary.plans.chunks import UNITS
from granary.plans.registry import query
from granary.sources.tables import table

LINES = """e AS (SELECT user_id AS page, event_id AS n, CASE event_type WHEN 'view' THEN 'goes on' WHEN 'click' THEN 'Ends here.' || CASE WHEN event_id % 2 = 0 THEN '!' ELSE '' END WHEN 'error' THEN '- item' WHEN 'signup' THEN 'Text' ELSE 'key = 1' END AS content,
  (event_id % 4)::DOUBLE AS x0, event_id * 10.0 + value / 10 AS y0, event_id % 4 + 50.0 + event_id % 70 AS x1, event_id * 10.0 + value / 10 + 8 AS y1, 10 + (event_id % 3) * 0.2 AS size FROM events),
  l AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n) AS k FROM e), g AS (SELECT * REPLACE (y0 - (n - k) * 10 AS y0, y1 - (n - k) * 10 AS y1) FROM l)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind, value = F.col("event_id"), F.col("event_type"), F.col("value")
    content = F.when(kind == "view", "goes on").when(kind == "click", F.concat(F.lit("Ends here."), F.when(n % 2 == 0, "!").otherwise(""))).when(kind == "error", "- item").when(kind == "signup", "Text").otherwise("key = 1")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").withColumn("k", k)
    # Sums in the order of the SQL: where keys are large, other orders round otherwise.
    moved = (n - F.col("k")) * 10
    y0 = n * 10.0 + value / 10
    y0, y1 = y0 - moved, y0 + 8 - moved
    return rows.select(F.col("user_id").alias("page"), n.alias("n"), content.alias("content"), (n % 4).cast("double").alias("x0"), y0.alias("y0"), (n % 4 + 50.0 + n % 70).alias("x1"), y1.alias("y1"), (10 + (n % 3) * 0.2).alias("size"))


BREAK = """b AS (SELECT *, lag(content) OVER w AS pc, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lag(size) OVER w AS ps FROM g WINDOW w AS (PARTITION BY page ORDER BY n)),
  m AS (SELECT *, pc IS NOT NULL AND NOT regexp_matches(content, '^(-|\\w+\\s*[:=])') AND NOT regexp_matches(pc, '[!?]$') AS may FROM b)""".replace("\\\\", "\\")


@query(
    f"""WITH {LINES}, {BREAK}, i AS (SELECT page, n, content, sum(CASE WHEN may AND y0 - py1 <= 4 AND abs(size - ps) <= 0.3 AND abs(x0 - px0) <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY n) AS island FROM m)
    SELECT page, island::BIGINT AS island, min(n) AS first, string_agg(content, ' ' ORDER BY n) AS content FROM i GROUP BY 1, 2"""
)
def line_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined into paragraphs by ends of sentences, gaps, sizes and indents."""
    return _joined(layout.paragraphs(_lines(spark, sf_dir), "page", "n"))


def _joined(lines: DataFrame) -> DataFrame:
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]), " ")
    return lines.groupBy("page", "island").agg(F.min("n").alias("first"), texts.alias("content"))


@query(
    f"""WITH {LINES}, {BREAK}, s AS (SELECT *, CASE WHEN y0 - py1 <= greatest(py1 - py0, 1) * 0.6 THEN 1 ELSE 0 END + CASE WHEN abs(x0 - px0) <= 1.5 THEN 1 ELSE -1 END + CASE WHEN (x1 - x0) / (px1 - px0) BETWEEN 0.55 AND 1.6 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(content, '^[a-z]') THEN 1 ELSE 0 END AS score FROM m),
    i AS (SELECT page, n, content, sum(CASE WHEN may AND y0 - py1 <= 2.5 AND score >= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY n) AS island FROM s)
    SELECT page, island::BIGINT AS island, min(n) AS first, string_agg(content, ' ' ORDER BY n) AS content FROM i GROUP BY 1, 2"""
)
def recognised_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines joined by score, the careful way."""
    return _joined(layout.recognised_paragraphs(_lines(spark, sf_dir), "page", "n", "conservative"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN l_quantity WHEN l_suppkey = 0 THEN l_quantity ELSE l_quantity / 1000 * 600 END AS x, CASE WHEN l_returnflag = 'A' OR l_suppkey = 0 THEN l_quantity ELSE l_quantity / 1000 * 800 END AS y FROM lineitem"""
)
def rescaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on a canvas in points of the page, where its size is known."""
    q = F.col("l_quantity")
    box = layout.rescaled(F.array(q, q, q + 1, q + 1), F.when(F.col("l_returnflag") != "A", 600.0), F.when(F.col("l_suppkey") == 0, 0.0).otherwise(800.0), F.lit(1000.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", box[0].alias("x"), box[1].alias("y"))


@query(
    r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN text || repeat(chr(1), length(text)) WHEN doc_id % 6 = 2 THEN repeat('### ', length(text)) WHEN doc_id % 6 = 3 THEN repeat('1 2 3 4 5 ', 10) ELSE text END AS body FROM documents),
    q AS (SELECT doc_id, body, regexp_replace(body, '\s+', '', 'g') AS dense, CASE WHEN doc_id % 6 = 4 THEN 10 ELSE 0 END AS chars FROM d)
    SELECT doc_id, CASE WHEN length(trim(body, E' \n\t')) < 50 THEN 'short' WHEN len(regexp_extract_all(body, '[\x00-\x08\x0b-\x0c\x0e-\x1f]')) > 0.1 * length(body) THEN 'garbled' WHEN len(regexp_extract_all(dense, '[一-鿿A-Za-z0-9]')) < 0.35 * length(dense) THEN 'unreadable' WHEN chars = 10 THEN 'sparse' WHEN NOT regexp_matches(body, '[，。！？；：、]|\b[a-zA-Z]{2,}\b') THEN 'no_sentences' ELSE 'ok' END AS reason FROM q"""
)
def page_text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason against a page's text."""
    key = F.col("doc_id")
    n = F.length("text")
    body = F.when(key % 6 == 1, F.concat("text", F.repeat(F.lit("\x01"), n))).when(key % 6 == 2, F.repeat(F.lit("### "), n)).when(key % 6 == 3, F.lit("1 2 3 4 5 " * 10)).otherwise(F.col("text"))
    quality = layout.page_quality(body, F.lit(100.0), F.lit(100.0), F.when(key % 6 == 4, 10).otherwise(0))
    return table(spark, sf_dir, "documents").select("doc_id", quality["reason"].alias("reason"))


@query(
    rf"""WITH RECURSIVE e AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN '![image](' || trim(text) || ')' ELSE trim(text) END AS p, turn // 4 AS page, 50.0 - turn % 4 // 2 AS y0, 10.0 * (turn % 2) AS x0 FROM conversations WHERE turn % 7 <> 4 AND trim(text) <> '' AND turn % 9 <> 8),
    k AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY page, y0, x0, turn) AS i, p, greatest(1, {UNITS.replace("{p}", "p")})::BIGINT AS n FROM e),
    r AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, []::VARCHAR[] AS done, []::STRUCT(p VARCHAR, n BIGINT)[] AS now FROM k
      UNION ALL SELECT conv_id, i, CASE WHEN over THEN list_append(done, array_to_string(list_transform(now, lambda x: x.p), chr(10))) ELSE done END, list_append(CASE WHEN over THEN now[tail:] ELSE now END, {{'p': p, 'n': n}}) FROM (
        SELECT k.conv_id, k.i, k.p, k.n, r.done, r.now, len(r.now) > 0 AND list_sum(list_transform(r.now, lambda x: x.n)) + k.n > 80 AS over, list_filter(range(1, len(r.now) + 1), lambda j: j = len(r.now) OR list_sum(list_transform(r.now[j:], lambda x: x.n)) <= 24)[1] AS tail
        FROM r JOIN k ON k.conv_id = r.conv_id AND k.i = r.i + 1)),
    f AS (SELECT conv_id, list_append(done, array_to_string(list_transform(now, lambda x: x.p), chr(10))) AS parts FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1 AND i > 0)
    SELECT conv_id, (j - 1)::INT AS position, parts[j] AS content FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS j FROM f)"""
)
def layout_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of pages in reading order packed to a budget, with the last ones carried over; footers and elements without a box go."""
    turn = F.col("turn")
    x0, y0 = 10.0 * (turn % 2), 50.0 - F.floor(turn % 4 / 2)
    kind = F.when(turn % 7 == 4, "footer").when(turn % 5 == 3, "Image").otherwise("text")
    box = F.when(turn % 9 == 8, F.array(x0, y0, x0, y0)).otherwise(F.array(x0, y0, x0 + 5, y0 + 1))
    elements = table(spark, sf_dir, "conversations").select("conv_id", turn.alias("idx"), kind.alias("type"), F.col("text").alias("content"), F.floor(turn / 4).cast("int").alias("page_no"), box.alias("bbox"))
    return layout.layout_chunks(layout.layout_elements(elements, "conv_id"), "conv_id", "place", 80, 40)


@query(
    """WITH c AS (SELECT conv_id, turn, turn // 2 AS chunk, regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g') AS norm FROM conversations) SELECT conv_id, chunk, turn AS element FROM c WHERE length(trim(norm)) > 1""".replace("\\\\", "\\")
)
def aligned_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which elements chunks came from: two turns each, found again by their lines."""
    turns = table(spark, sf_dir, "conversations")
    elements = turns.select("conv_id", F.col("turn").alias("place"), F.col("text").alias("content"))
    line = F.regexp_replace("text", r"\s+", " ")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("t")))), lambda x: x["t"]), "\n")
    chunks = turns.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("chunk")).agg(parts.alias("content"))
    return layout.aligned_elements(chunks, elements, "conv_id")
