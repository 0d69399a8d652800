"""Sections by configured rules, drawn together, and cut into trees; tables over page breaks; a user's separators.

Texts are built of rows of equal size, so that SQL can say by counting what the packers find by measuring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import layout, sections, user_rules
from granary.plans.chunks import UNITS
from granary.plans.registry import query
from granary.sources.tables import table

RULES = [sections.HeadingRule("^[AEIOU]", 1), sections.HeadingRule("^[B-D]", 2, keep=False), sections.HeadingRule("^[F-H]", 4)]


@query(
    r"""WITH l AS (SELECT doc_id, i, parts[i] AS line, CASE WHEN regexp_matches(parts[i], '^[AEIOU]') THEN 1 WHEN regexp_matches(parts[i], '^[B-D]') THEN 2 WHEN regexp_matches(parts[i], '^[F-H]') THEN 4 END AS level
      FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM documents))),
    s AS (SELECT *, count(level) OVER w AS section, max(CASE WHEN level = 1 THEN i END) OVER w AS i1, max(CASE WHEN level <= 2 THEN i END) OVER w AS i2, max(CASE WHEN level <= 4 THEN i END) OVER w AS i4 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT *, regexp_replace(line, '^[\s　]+|[\s　]+$', '', 'g') AS bare FROM s),
    p AS (SELECT t.*, concat_ws('/', a.bare, CASE WHEN b.level = 2 THEN b.bare END, CASE WHEN c.level = 4 THEN c.bare END) AS path FROM t LEFT JOIN t a ON a.doc_id = t.doc_id AND a.i = t.i1 LEFT JOIN t b ON b.doc_id = t.doc_id AND b.i = t.i2 LEFT JOIN t c ON c.doc_id = t.doc_id AND c.i = t.i4),
    g AS (SELECT doc_id, section, coalesce(max(level), 0) AS level, coalesce(max(CASE WHEN level IS NOT NULL THEN bare END), '') AS heading, arg_max(path, i) AS path,
      regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level IS NULL OR level <> 2), ''), '^[\s　]+|[\s　]+$', '', 'g') AS content FROM p GROUP BY 1, 2),
    f AS (SELECT *, CASE WHEN content = '' THEN heading ELSE content END AS body, max(section) OVER (PARTITION BY doc_id) AS most FROM g)
    SELECT doc_id, section, level, heading, path, body AS content FROM f WHERE most > 0 AND body <> ''"""
)
def rule_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at lines that rules call headings, some of which stay out of their sections."""
    return sections.rule_sections(table(spark, sf_dir, "documents"), "doc_id", "text", RULES).select("doc_id", "section", "level", "heading", "path", "content")


@query(
    """WITH s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i, '### line' || chr(10) || 'part ' || l_partkey || ' of five words' AS content FROM lineitem)
    SELECT l_orderkey, (i // 2)::INT AS section, 3 AS level, 'line' AS heading, string_agg(content, chr(10) || chr(10) ORDER BY i) AS content FROM s GROUP BY 1, i // 2"""
)
def joined_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small siblings drawn together while two of them, but not three, fit: nine units each, within twenty."""
    lines = _numbered(table(spark, sf_dir, "lineitem"), "l_orderkey", F.concat(F.lit("### line\npart "), "l_partkey", F.lit(" of five words")), "l_linenumber", "l_partkey")
    rows = lines.select("l_orderkey", F.col("i").alias("section"), F.lit(3).alias("level"), F.lit("line").alias("heading"), F.lit("").alias("path"), F.col("r").alias("content"))
    return sections.joined_sections(rows, "l_orderkey", 20).select("l_orderkey", "section", "level", "heading", "content")


def _numbered(rows: DataFrame, key: str, text: Column, *order: str) -> DataFrame:
    """key, i, r: a text for each row, numbered from 0 within its key."""
    found = F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("r")))), lambda x: x["r"])
    return rows.groupBy(key).agg(found.alias("a")).select(key, F.posexplode("a").alias("i", "r"))


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipe table of orders for each customer."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "o_orderkey", "o_orderstatus", F.year("o_orderdate")), F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"])
    body = F.concat(F.lit("| order | status | year |\n| --- | --- | --- |\n"), F.array_join(rows, "\n"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(body.alias("content"))


@query(
    rf"""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, '| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || year(o_orderdate) || ' |' AS r FROM orders),
    h AS (SELECT '| order | status | year |' || chr(10) || '| --- | --- | --- |' AS head), b AS (SELECT o_custkey, head || chr(10) || string_agg(r, chr(10) ORDER BY i) AS p FROM r, h GROUP BY o_custkey, head), u AS (SELECT *, {UNITS.replace("{p}", "p")} AS n FROM b),
    w AS (SELECT o_custkey, 'section' AS role, 0 AS position, 0 AS part, true AS vectorize, p AS content FROM u WHERE n < 60 UNION ALL SELECT o_custkey, 'child', 0, 0, n <= 40, p FROM u WHERE n >= 60 UNION ALL SELECT o_custkey, 'parent', 0, 0, false, p FROM u WHERE n >= 240
      UNION ALL SELECT r.o_custkey, 'part', 0, (i // 5 + 1)::INT, true, head || chr(10) || string_agg(r, chr(10) ORDER BY i) FROM r JOIN u USING (o_custkey), h WHERE n >= 60 GROUP BY r.o_custkey, i // 5, head)
    SELECT * FROM w"""
)
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as sections: small ones whole, large ones with their parts below them, very large ones with a parent. A row has seven or
    eight units, so that five are in a part of forty."""
    rows = _order_rows(spark, sf_dir).select("o_custkey", F.lit(0).alias("section"), F.lit("").alias("path"), "content")
    return sections.section_tree(rows, "o_custkey", 40, 10_000).drop("section")


LINES = "l AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, lpad(o_orderkey::VARCHAR, 19, 'x') AS r FROM orders)"


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each customer: a line of nineteen letters an order."""
    line = F.lpad(F.col("o_orderkey").cast("string"), 19, "x")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("r")))), lambda x: x["r"])
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(lines, "\n").alias("text"))


@query(
    f"""WITH {LINES}, n AS (SELECT o_custkey, i // 8 AS a, count(*) AS lines FROM l GROUP BY 1, 2),
    one AS (SELECT o_custkey, 1 AS level, (i // 8)::VARCHAR AS place, NULL AS parent, string_agg(r, chr(10) ORDER BY i) AS content FROM l GROUP BY 1, i // 8),
    two AS (SELECT o_custkey, i // 8 AS a, i % 8 // 4 AS b, string_agg(r, chr(10) ORDER BY i) AS content, count(*) AS lines FROM l GROUP BY 1, 2, 3),
    three AS (SELECT o_custkey, i // 8 AS a, i % 8 // 4 AS b, i % 4 // 2 AS c, string_agg(r, chr(10) ORDER BY i) AS content, count(*) AS lines FROM l GROUP BY 1, 2, 3, 4),
    t AS (SELECT * FROM one UNION ALL SELECT two.o_custkey, 2, a || '.' || b, a::VARCHAR, content FROM two JOIN n USING (o_custkey, a) WHERE two.lines < n.lines
      UNION ALL SELECT three.o_custkey, 3, a || '.' || b || '.' || c, CASE WHEN two.lines = n.lines THEN a::VARCHAR ELSE a || '.' || b END, three.content FROM three JOIN two USING (o_custkey, a, b) JOIN n USING (o_custkey, a) WHERE three.lines < two.lines)
    SELECT *, NOT EXISTS (FROM t u WHERE u.o_custkey = t.o_custkey AND u.parent = t.place) AS is_leaf FROM t"""
)
def chunk_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into pieces of eight, four and two lines, each within the one above; pieces that are the whole of it are left out."""
    return sections.hierarchy(_order_lines(spark, sf_dir), "o_custkey", "text", 42).select("o_custkey", "level", "place", "parent", "content", "is_leaf")


@query(
    f"""WITH {LINES}, n AS (SELECT o_custkey, count(*) AS n FROM l GROUP BY 1), c AS (SELECT o_custkey, n, unnest(range(greatest(1, n // 2))) AS k FROM n)
    SELECT c.o_custkey, k::INT AS position, string_agg(r, chr(10) ORDER BY i) AS content FROM c JOIN l ON l.o_custkey = c.o_custkey AND i BETWEEN 2 * k AND 2 * k + 2 GROUP BY 1, 2"""
)
def user_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at line ends and drawn together in threes, each chunk beginning with the last line of the one before."""
    rules = [user_rules.Separator("\n\n"), user_rules.Separator("\n")]
    cut = user_rules.cut_by_rules("text", rules, 60, 20)
    return _order_lines(spark, sf_dir).select("o_custkey", F.posexplode(cut).alias("position", "content"))


@query(
    """WITH RECURSIVE t AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey::VARCHAR) AS i, CASE l_partkey % 5 WHEN 0 THEN ['', 'more ' || l_suppkey] WHEN 1 THEN ['a', 'b', 'c'] WHEN 2 THEN ['k' || l_partkey, 'v'] ELSE ['key', 'value'] END AS header, [['r' || l_linenumber, l_suppkey::VARCHAR]] AS rows FROM lineitem),
    r AS (SELECT l_orderkey, i, 1 AS island, i AS first, 1 AS n_parts, header, rows FROM t WHERE i = 1
      UNION ALL SELECT t.l_orderkey, t.i, CASE WHEN s THEN r.island ELSE r.island + 1 END, CASE WHEN s THEN r.first ELSE t.i END, CASE WHEN s THEN r.n_parts + 1 ELSE 1 END, CASE WHEN s THEN r.header ELSE t.header END,
        CASE WHEN NOT s THEN t.rows WHEN t.header = r.header THEN list_concat(r.rows, t.rows) WHEN t.header[1] = '' THEN list_concat(list_append(r.rows[1 : len(r.rows) - 1], [r.rows[-1][1], r.rows[-1][2] || ' ' || t.header[2]]), t.rows) ELSE list_concat(list_append(r.rows, t.header), t.rows) END
      FROM (SELECT r.*, len(n.header) = len(r.header) AS s FROM r JOIN t n ON n.l_orderkey = r.l_orderkey AND n.i = r.i + 1) r JOIN t ON t.l_orderkey = r.l_orderkey AND t.i = r.i + 1)
    SELECT l_orderkey, first::INT AS first, n_parts::INT AS n_parts, array_to_string(header, '|') AS header, array_to_string(list_transform(rows, lambda x: array_to_string(x, '|')), ';') AS rows FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey, island ORDER BY i DESC) = 1"""
)
def joined_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that go on over page breaks: repeated headers go, cut rows are stitched, headers that are rows become rows."""
    lines = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    header = F.when(part % 5 == 0, F.array(F.lit(""), F.concat(F.lit("more "), "l_suppkey"))).when(part % 5 == 1, F.array(*map(F.lit, "abc"))).when(part % 5 == 2, F.array(F.concat(F.lit("k"), part), F.lit("v"))).otherwise(F.array(F.lit("key"), F.lit("value")))
    rows = F.array(F.array(F.concat(F.lit("r"), "l_linenumber"), F.col("l_suppkey").cast("string")))
    # Of equal places and parts the lesser supplier comes first, as it is in the header or the row.
    found = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", header.alias("header"), rows.alias("rows")))).alias("t"))
    tables = found.select("l_orderkey", F.posexplode("t").alias("i", "t")).select("l_orderkey", (F.col("i") + 1).alias("place"), "t.header", "t.rows")
    joined = layout.joined_tables(tables, "l_orderkey", "place")
    return joined.select("l_orderkey", "first", "n_parts", F.array_join("header", "|").alias("header"), F.array_join(F.transform("rows", lambda x: F.array_join(x, "|")), ";").alias("rows"))
