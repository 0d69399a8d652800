"""Tables written to files and read again with what is found of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import tables
from granary.plans.registry import query
from granary.sources import files, formats
from granary.sources.scratch import scratch_path
from granary.sources.tables import table


def _orders_as_files(spark: SparkSession, sf_dir: str) -> str:
    """The orders as files with semicolons, one folder a status. Keys begin above 1, which is a truth word."""
    path = scratch_path(spark, "order-files")
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1000).alias("o_orderkey"), F.date_format("o_orderdate", "yyyy/MM/dd").alias("o_orderdate"), F.concat(F.lit("a; "), "o_orderpriority").alias("note"), (F.col("o_orderkey") % 2 == 0).alias("even"), (F.col("o_orderkey") + 0.5).alias("amount"), "o_orderstatus")
    rows.write.partitionBy("o_orderstatus").option("header", True).option("sep", ";").csv(path)
    return path


@query("SELECT o_orderkey + 1000 AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, 'a; ' || o_orderpriority AS note, o_orderkey % 2 = 0 AS even, o_orderkey + 0.5::DOUBLE AS amount FROM orders")
def typed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read as one table, with the types of their cells."""
    formats.registered(spark)
    rows = spark.read.format("table_files").option("typed", True).load(_orders_as_files(spark, sf_dir))
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "note", "even", "amount")


@query("SELECT o_orderstatus AS status, 'o_orderkey|o_orderdate|note|even|amount' AS header, 'int|datetime|text|bool|float' AS types, count(*) AS n, ';' AS delimiter, 1 AS header_row FROM orders GROUP BY 1")
def file_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each file: header, types, rows, delimiter."""
    formats.registered(spark)
    sheets = spark.read.format("table_files").option("sheets", True).load(_orders_as_files(spark, sf_dir))
    types = F.array_join(F.transform("header", lambda h: F.col("column_types")[h]), "|")
    rows = sheets.select(F.regexp_extract("path", r"o_orderstatus=(\w+)", 1).alias("status"), F.array_join("header", "|").alias("header"), types.alias("types"), "row_count", "delimiter", "header_row_number")
    return rows.groupBy("status", "header", "types", "delimiter", F.col("header_row_number").alias("header_row")).agg(F.sum("row_count").alias("n"))


@query("SELECT 'part-' || p_brand AS brand, count(*) AS n, min(p_name || '/' || p_type) AS first, 'p_name=text p_size=int p_type=text' AS types FROM part GROUP BY 1")
def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of files as records of header and values, each with the types of its file's columns."""
    formats.registered(spark)
    path = scratch_path(spark, "part-files")
    rows = table(spark, sf_dir, "part").select("p_name", (F.col("p_size") + 2).alias("p_size"), "p_type", F.concat(F.lit("part-"), "p_brand").alias("brand"))
    rows.write.partitionBy("brand").option("header", True).option("sep", "|").csv(path)
    found = spark.read.format("table_files").load(path)
    brand = F.replace(F.regexp_extract("path", r"brand=([^/]+)/", 1), F.lit("%23"), F.lit("#"))
    types = F.array_join(F.transform(F.array_sort(F.map_keys("column_types")), lambda k: F.concat(k, F.lit("="), F.col("column_types")[k])), " ")
    first = F.min(F.concat(F.col("values")[0], F.lit("/"), F.col("values")[2])).alias("first")
    return found.groupBy(brand.alias("brand"), types.alias("types")).agg(F.count("*").alias("n"), first)


@query(
    """SELECT trim(q.text) AS question, trim(a.text) AS answer, 'conversation ' || q.conv_id || '||turn ' || q.turn AS similar_questions, q.conv_id % 3 <> 0 AS is_enabled
    FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE trim(q.text) <> '' AND trim(a.text) <> ''"""
)
def question_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers written as files and read again."""
    formats.registered(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim("text").alias("question")).filter("question <> ''")
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("question").alias("answer"))
    similar = F.array(F.concat(F.lit("conversation "), "conv_id"), F.lit(" "), F.concat(F.lit("turn "), "turn"))
    rows = turns.join(answers, ["conv_id", "turn"]).select("question", "answer", similar.alias("similar_questions"), F.lit(None).cast("string").alias("category"), (F.col("conv_id") % 3 != 0).alias("enabled"))
    path = scratch_path(spark, "questions")
    rows.write.format("question_files").mode("append").save(path)
    return files.read_qa(spark, path).select("question", "answer", F.array_join("similar_questions", "||").alias("similar_questions"), "is_enabled")


_KIND = "CASE WHEN x IN ('是', 'true', 'True', 'TRUE', '1', '否', 'false', 'False', 'FALSE', '0') THEN 'bool' WHEN regexp_matches(x, '^(\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}|\\d{8}$)') THEN 'datetime' WHEN regexp_matches(x, '^[+-]?\\d+$') THEN 'int' WHEN TRY_CAST(x AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'text' END"
_VOTED = "CASE WHEN count(CASE WHEN kind = 'text' THEN 1 END) > 0.3 * count(*) THEN 'text' WHEN bool_or(kind = 'bool') THEN 'bool' WHEN bool_or(kind = 'datetime') THEN 'datetime' WHEN bool_or(kind = 'int') THEN 'int' ELSE 'float' END"
_INFERRED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value"],
}


@query(
    f"WITH v AS ({' UNION ALL '.join(f'''SELECT '{t}' AS tbl, '{c}' AS col, {c}::VARCHAR AS x FROM (SELECT * FROM {t} LIMIT 100)''' for t, cs in _INFERRED.items() for c in cs)}), k AS (SELECT tbl, col, {_KIND} AS kind FROM v WHERE trim(x) <> '') SELECT tbl, col, {_VOTED} AS kind FROM k GROUP BY 1, 2"
)
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column types of three tables from their first rows, as column and type."""

    def of(name: str) -> DataFrame:
        one = tables.inferred_types(tables.first_rows(table(spark, sf_dir, name), _INFERRED[name]))
        return one.select(F.lit(name).alias("tbl"), F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("kind")) for c in one.columns))).alias("f")).select("tbl", "f.col", "f.kind")

    return reduce(DataFrame.unionByName, map(of, _INFERRED))
