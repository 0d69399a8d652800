"""Delimited files as a Spark source and sink, and types of any table."""

import os
from datetime import datetime

import pytest
from granary.functions import tables
from granary.sources import files, formats
from granary.sources.formats import typed, voted_kind
from pyspark.sql import functions as F


@pytest.fixture
def folder(spark, tmp_path):
    formats.registered(spark)

    def write(**contents):
        for name, data in contents.items():
            (tmp_path / f"{name}.csv").write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(tmp_path)

    return write


def test_typed_table_of_a_folder(spark, folder):
    a = '\n,,\n﻿'.encode()[:0] + "﻿code;when;flag;price;note\n\n12;2024-01-05 10:30;true;1.5;a\n13;20240106;0;2;\"b;\nc\"\n14;2024/1/7;是;x;\n".encode()
    b = "note,code,price,more\nq,99999999999999999999,-3,z\n,7,1e3,\n".encode("gb18030")
    path = folder(a=a, b=b)
    (open(os.path.join(path, "_hidden.csv"), "w")).close()
    rows = spark.read.format("table_files").option("typed", True).load(path)
    assert rows.schema.simpleString() == "struct<code:bigint,when:timestamp,flag:boolean,price:double,note:string>" or rows.schema["price"].dataType.simpleString() == "string"
    got = sorted((tuple(r) for r in rows.collect()), key=repr)
    assert (12, datetime(2024, 1, 5, 10, 30), True) in [r[:3] for r in got] and (13, datetime(2024, 1, 6), False) in [r[:3] for r in got]
    assert (7, None, None) in [r[:3] for r in got] and (None, None, None) in [r[:3] for r in got] and len(got) == 5
    assert {r[4] for r in got} == {"a", "b;\nc", "q", None}
    assert rows.rdd.getNumPartitions() == 2


def test_rows_and_sheets(spark, folder):
    path = folder(title="Report 2024\n\nname | size |\nbolt | 5 | x\n\nring||\nnut | 6\n", empty="", big5="名稱\t值\n螺絲\t二\n".encode("big5"))
    read = spark.read.format("table_files")
    found = {r.sheet_name: r for r in read.option("sheets", True).option("headerRows", 10).load(path).collect()}
    assert set(found) == {"title", "big5"}
    t = found["title"]
    assert (t.header, t.header_row_number, t.row_count, t.delimiter, t.encoding) == (["name", "size", "列3"], 3, 3, "|", "utf-8")
    assert t.column_types == {"name": "text", "size": "int", "列3": "text"} and found["big5"].delimiter == "\t"
    rows = spark.read.format("table_files").option("headerRows", 10).load(path).filter("sheet_name = 'title'").orderBy("row_index").collect()
    assert [(r.row_index, r["values"]) for r in rows] == [(1, ["bolt", "5", "x"]), (2, ["ring", "", ""]), (3, ["nut", "6", ""])]
    plain = spark.read.format("table_files").load(path).filter("sheet_name = 'title'").orderBy("row_index").collect()
    assert [r.header for r in plain] == [["Report 2024"]] * 4 and plain[0]["values"] == ["name"]
    limited = spark.read.format("table_files").option("headerRows", 10).option("maxRows", 4).option("maxColumns", 2).load(path).filter("sheet_name = 'title'").collect()
    assert [(r.header, r["values"]) for r in limited] == [(["name", "size"], ["bolt", "5"])]
    assert spark.read.format("table_files").load(f"{path}/b*.csv").count() == 1


def test_no_files(spark, folder):
    path = folder()
    assert spark.read.format("table_files").load(path).count() == 0
    with pytest.raises(Exception, match="no files"):
        spark.read.format("table_files").option("typed", True).load(path)


def test_votes_and_cells():
    assert voted_kind(["1", "25"]) == "bool" and voted_kind(["2", "2.5"]) == "int" and voted_kind(["2.5", "1e9", ""]) == "float"
    assert voted_kind(["x"] * 3 + ["5"] * 7) == "int" and voted_kind(["x"] * 4 + ["5"] * 6) == "text" and voted_kind(["", None]) == "text"
    assert voted_kind(["2024-1-5", "7"]) == "datetime" and voted_kind(["yes", "no"]) == "text"
    assert typed("x", "int") is None and typed("", "text") is None and typed("否", "bool") is False and typed("5", "bool") is None
    assert typed("2024-13-05", "datetime") is None and typed("2024/1/5", "datetime") == datetime(2024, 1, 5)


QA = "question string, answer string, similar_questions array<string>, category string, tags array<string>, enabled boolean"


def test_questions_written_and_read_again(spark, folder, tmp_path):
    folder()
    rows = [("q 1", 'a, "b"\nc', ["x", " ", "y "], None, ["t", "u"], True), ("是什么", "答", None, "c", [], False), (" q3 ", "a3", [], "", None, None)]
    frame = spark.createDataFrame(rows, QA).repartition(2, "question")
    out = str(tmp_path / "qa")
    frame.write.format("question_files").mode("append").save(out)
    names = [n for n in os.listdir(out) if n.endswith(".csv")]
    assert sorted(os.listdir(out)) == sorted(names)
    for n in names:
        data = open(f"{out}/{n}", "rb").read()
        assert data.startswith(b"\xef\xbb\xbf") and data.count(b"\xef\xbb\xbf") == 1
    back = sorted((r.question, r.answer, r.similar_questions, r.tags, r.is_enabled) for r in files.read_qa(spark, out).collect())
    assert back == [("q 1", 'a, "b"\nc', ["x", "y"], ["t", "u"], True), ("q3", "a3", [], [], True), ("是什么", "答", [], [], False)]
    frame.limit(1).write.format("question_files").mode("overwrite").save(out)
    assert files.read_qa(spark, out).count() == 1
    frame.limit(0).write.format("question_files").mode("append").save(out)
    assert files.read_qa(spark, out).count() == 1
    with pytest.raises(Exception, match="unknown columns"):
        frame.withColumn("other", F.lit(1)).write.format("question_files").mode("append").save(out)


def test_a_task_that_fails_leaves_nothing(spark, folder, tmp_path):
    folder()
    out = str(tmp_path / "qa")
    good = spark.createDataFrame([("q", "a", [], "", [], True)], QA)
    good.write.format("question_files").mode("append").save(out)
    before = sorted(os.listdir(out))
    fails = F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string"))
    bad = spark.range(8).repartition(4).select(fails.cast("string").alias("question"), F.lit("a").alias("answer"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("question_files").mode("append").save(out)
    assert sorted(os.listdir(out)) == before


def test_types_of_any_table(spark):
    tables.registered(spark)
    frame = spark.createDataFrame([(5, "2024-01-01", None, 2.5, True), (6, "x", None, 3.5, False), (7, "2024-01-03", None, 1.5, True), (8, "2024-01-03", None, 1.5, True)], "a int, b string, c string, d double, e boolean")
    frame.createOrReplaceTempView("some_table")
    assert tuple(spark.sql("SELECT * FROM inferred_types(TABLE(some_table))").first()) == ("int", "datetime", "text", "float", "bool")
    assert spark.sql("SELECT * FROM inferred_types(TABLE(SELECT a, b FROM some_table WHERE a > 9))").columns == ["a", "b"]
    one = tables.inferred_types(spark.range(5, 100_000))
    assert one.columns == ["id"] and one.first().id == "int"
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "LocalLimit 100" in plan or "GlobalLimit 100" in plan or "CollectLimit 100" in plan
