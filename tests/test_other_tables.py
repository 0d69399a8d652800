"""Queries against their SQL on tables unlike the given ones: large keys, halves, digits in front, several files."""

import duckdb
import pytest
from granary import catalog
from granary.functions import tables
from pyspark.sql import functions as F

from tests.test_oracle import plain

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def same(spark, path, name, table, rows):
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/{table}.parquet")
    df = QUERIES[name](spark, str(path))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    relation = con.sql(SQL[name])
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["line_paragraphs", "recognised_paragraphs"])
def test_lines_of_large_keys(spark, sf_dir, tmp_path, name):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.col("event_id") % 5 * 5 + F.col("event_id") % 7 * 0.005
    same(spark, tmp_path, name, "events", events.withColumn("value", value).withColumn("event_id", F.col("event_id") + 10**12))


def test_usage_of_halves(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    same(spark, tmp_path, "stream_usage", "events", events.withColumn("value", F.floor("value") + F.lit(0.5)))


def test_scores_of_pages_that_begin_with_digits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>2024. 12 months " + "word " * 30 + "</p>"), (2, "u", "<p>7</p>"), (3, "u", "")], "page_id long, url string, html string")
    same(spark, tmp_path, "page_scores", "pages", pages)


def test_first_rows_are_those_of_the_first_file(spark, tmp_path):
    for i, ids in enumerate((spark.range(50), spark.range(50, 200_000))):
        ids.coalesce(1).write.parquet(f"{tmp_path}/made{i}")
        (tmp_path / "t.parquet").mkdir(exist_ok=True)
        next((tmp_path / f"made{i}").glob("*.parquet")).rename(tmp_path / f"t.parquet/part-{i}.parquet")
    rows = tables.first_rows(spark.read.parquet(f"{tmp_path}/t.parquet"), ["id"])
    assert sorted(r.id for r in rows.collect()) == list(range(100))
    assert tables.inferred_types(rows).first().id == "bool"
