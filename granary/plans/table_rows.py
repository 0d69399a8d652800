"""Rows of sheets: here parts are rows of a sheet a brand, conversations cells of a sheet, lines cells with merged ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import table_rows
from granary.plans.registry import query
from granary.sources.tables import table


@query(
    """WITH c AS (SELECT l_orderkey % 50 AS sheet, l_orderkey // 50 % 13 AS row_no, CASE WHEN l_quantity < 46 THEN ' ' ELSE l_returnflag END AS value FROM lineitem),
    r AS (SELECT sheet, row_no, count(CASE WHEN trim(value) <> '' THEN 1 END) AS filled FROM c WHERE row_no < 10 GROUP BY ALL)
    SELECT sheet, coalesce(min(CASE WHEN filled >= 2 THEN row_no END), arg_max(row_no, (filled, -row_no))) AS header_row FROM r GROUP BY 1"""
)
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of ten rows with two filled cells, else the fullest."""
    cells = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("sheet"), (F.floor(F.col("l_orderkey") / 50) % 13).alias("row_no"), F.when(F.col("l_quantity") < 46, " ").otherwise(F.col("l_returnflag")).alias("value"))
    return table_rows.header_row(cells)


@query(
    """WITH c AS (SELECT p_partkey % 40 AS sheet, p_partkey // 40 % 10 AS row_no, p_partkey // 400 AS col_no, p_name AS value FROM part), m AS (SELECT s_suppkey % 40 AS sheet, 2 AS top, 0 AS "left", 4 AS bottom, 1 AS "right" FROM supplier WHERE s_suppkey < 20),
    x AS (SELECT sheet, row_no, col_no FROM (SELECT sheet, unnest(range(top, bottom + 1)) AS row_no, unnest([0, 0, 0]) AS col_no FROM m UNION SELECT sheet, unnest(range(top, bottom + 1)), unnest([1, 1, 1]) FROM m)),
    f AS (SELECT x.*, c.value AS merged FROM x JOIN c ON c.sheet = x.sheet AND c.row_no = 2 AND c.col_no = 0)
    SELECT coalesce(c.sheet, f.sheet) AS sheet, coalesce(c.row_no, f.row_no) AS row_no, coalesce(c.col_no, f.col_no) AS col_no, CASE WHEN f.sheet IS NOT NULL THEN merged ELSE value END AS value FROM c FULL JOIN f USING (sheet, row_no, col_no)"""
)
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged ranges filled with their first cell's value."""
    key = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").select((key % 40).alias("sheet"), (F.floor(key / 40) % 10).alias("row_no"), F.floor(key / 400).alias("col_no"), F.col("p_name").alias("value"))
    whole = lambda n, name: F.lit(n).cast("long").alias(name)
    merges = table(spark, sf_dir, "supplier").filter("s_suppkey < 20").select((F.col("s_suppkey") % 40).alias("sheet"), whole(2, "top"), whole(0, "left"), whole(4, "bottom"), whole(1, "right"))
    return table_rows.with_merged_cells(cells, merges)


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') END WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN '是' ELSE '否' END
    WHEN 2 THEN CASE WHEN o_custkey % 3 = 0 THEN (o_custkey // 3)::BIGINT::VARCHAR ELSE o_custkey || '.5' END ELSE CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END END AS value FROM orders"""
)
def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, booleans, numbers and errors as texts."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("date", "bool", "number", "text"))), (key % 4 + 1).cast("int"))
    number = F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") / 3).otherwise(F.col("o_custkey") + 0.5)
    at = F.when(key % 3 == 0, F.col("o_orderdate")).otherwise(F.timestamp_add("MINUTE", F.lit(90), F.col("o_orderdate")))
    text = F.when(F.col("o_orderstatus") == "F", " #REF! ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    return o.select("o_orderkey", table_rows.cell_text(kind, text, number, at, F.col("o_custkey") % 2 == 0).alias("value"))


LIMIT = 40
PART_ROWS = """r AS (SELECT p_brand AS sheet, p_partkey AS row_no, p_type AS tier, p_name || ' ' || repeat('long ', p_size % 17) AS note, CASE WHEN p_size % 3 = 0 THEN '' ELSE repeat(p_type || ',', p_size % 20) END AS words, p_size::VARCHAR AS size FROM part),
  i AS (SELECT *, '[' || sheet || '] 第' || row_no || '行; tier: ' || tier AS identity FROM r), x AS (SELECT *, CASE WHEN length(identity) + 2 <= 64 THEN identity || '; ' ELSE '[' || sheet || '] 第' || row_no || '行; ' END AS prefix FROM i),
  b AS (SELECT *, 80 - length(prefix) AS room, list_filter(['note: ' || trim(note), CASE WHEN words <> '' THEN 'words: ' || words END, 'size: ' || size], lambda t: t IS NOT NULL) AS fields, list_filter([{'n': 'note', 'v': trim(note)}, {'n': 'words', 'v': words}, {'n': 'size', 'v': size}], lambda t: t.v <> '') AS named FROM x),
  u AS (SELECT *, flatten(list_transform(named, lambda t: CASE WHEN length(t.n) + 2 + length(t.v) <= room THEN [t.n || ': ' || t.v] ELSE list_transform(range(1, length(t.v) + 1, greatest(room - length(t.n) - 2, 50)), lambda k: chr(2) || t.n || ': ' || substr(t.v, k, greatest(room - length(t.n) - 2, 50))) END)) AS units FROM b),
  g AS (SELECT *, list_transform(string_split(list_reduce(units, lambda acc, t: CASE WHEN NOT starts_with(t, chr(2)) AND NOT starts_with(string_split(acc, chr(1))[-1], chr(2)) AND length(string_split(acc, chr(1))[-1]) + 2 + length(t) <= room THEN acc || '; ' || t ELSE acc || chr(1) || t END), chr(1)), lambda t: replace(t, chr(2), '')) AS groups FROM u)"""


def _part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat("p_name", F.lit(" "), F.expr("repeat('long ', p_size % 17)"))
    words = F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.expr("repeat(p_type || ',', p_size % 20)"))
    header = F.array(*map(F.lit, ("tier", "note", "words", " ", "size")))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("row_no"), header.alias("header"), F.array("p_type", note, words, F.lit("no name"), F.col("p_size").cast("string")).alias("values"))


@query(
    f"""WITH {PART_ROWS}, w AS (SELECT *, 'tier: ' || tier || '; ' || array_to_string(fields, '; ') AS body FROM g)
    SELECT sheet, row_no, 'excel_row' AS role, 0 AS part, len(groups) = 1 AS is_leaf, CASE WHEN len(groups) = 1 THEN body ELSE identity || chr(10) || body END AS content, tier AS tier_filter FROM w
    UNION ALL SELECT sheet, row_no, 'excel_row_fragment', k::INT, true, prefix || groups[k], tier FROM (SELECT *, unnest(range(1, len(groups) + 1)) AS k FROM w WHERE len(groups) > 1)"""
)
def wide_row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as one leaf, or a parent and groups of fields; fields beyond the limit in windows."""
    found = table_rows.row_chunks(_part_rows(spark, sf_dir), LIMIT, ["tier"], ["tier", "none"])
    return found.withColumn("tier_filter", F.col("filter_fields")["tier"]).drop("filter_fields")


COLUMNS = [{"name": "tier", "role": "dimension", "aliases": ["level", " "]}, {"name": "size", "aggregatable": True}, {"name": "note", "role": "content"}, {"name": "key", "role": "identifier"}, {"name": " "}]
CONTEXT = "'表头: tier（别名: level）；size；note；key'"


@query(
    f"""SELECT p_partkey, concat_ws(chr(10), '工作表: ' || p_brand, CASE WHEN p_size > 5 THEN '行定位: row ' || p_partkey END, '当前字段: tier、size', CASE WHEN p_size > 3 THEN '筛选值: tier=' || p_type END, {CONTEXT}, '维度字段: tier、key', '指标字段: size、note', '唯一标识字段: key', CASE WHEN p_size % 2 = 0 THEN '命中视角: 行片段' ELSE '命中视角: 行' END, p_name) AS content FROM part"""
)
def row_search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's text with the schema around it."""
    values = F.when(F.col("p_size") > 3, F.create_map(F.lit("tier"), F.col("p_type"))).otherwise(F.create_map().cast("map<string,string>"))
    place = F.when(F.col("p_size") > 5, F.concat(F.lit("row "), "p_partkey"))
    role = F.when(F.col("p_size") % 2 == 0, "excel_row_fragment").otherwise("excel_row")
    text = table_rows.contextual_text(F.col("p_brand"), place, F.array(F.lit("tier"), F.lit("size")), values, F.col("p_name"), role, table_rows.schema_of(COLUMNS))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("content"))


@query(
    f"""SELECT p_brand, min(p_partkey) AS anchor, '工作表: ' || arg_min(p_type, p_partkey) || chr(10) || '行定位: ' || arg_min(p_name, p_partkey) || chr(10) || '当前行字段: a、b' || chr(10) || {CONTEXT} || chr(10) || '维度字段: tier、key' || chr(10) || '指标字段: size、note' || chr(10) || string_agg(p_name, chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY 1"""
)
def row_group_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of a row under its place and schema."""
    chunks = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("chunk_id"), F.col("p_type").alias("sheet"), F.col("p_name").alias("identity"), F.array(F.lit("a"), F.lit("b")).alias("fields"), F.col("p_name").alias("content"))
    return table_rows.row_group_text(chunks, "p_brand", table_rows.schema_of(COLUMNS))


@query(
    """SELECT p_brand AS sheet, p_partkey AS row_no FROM part WHERE p_size <> 9 AND (p_name ILIKE '%ring%' OR p_type ILIKE '%ring%') AND p_type ILIKE '%o%' ORDER BY 1, 2 LIMIT 20 OFFSET 20"""
)
def table_rows_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a table's rows by search over columns and by column."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("row_no"), F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("type"))).alias("row_data"), (F.col("p_size") == 9).alias("deleted"))
    return table_rows.list_rows(rows, "ring", ("name", "type"), {"type": "o", "name": " "}, page=2).select("sheet", "row_no")


@query("SELECT p_brand AS sheet, '工作表: ' || p_brand || '；行数: ' || count(*) || '；字段: tier、size；过滤列: tier' AS content FROM part GROUP BY 1")
def sheet_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet"))
    return table_rows.sheet_root(rows, "sheet", F.array(F.lit("tier"), F.lit("size")), ["tier"])
