"""Dear expressions stand once in a plan, and say what they said."""

from granary.functions.text import mixed_units
from granary.operators import retrieval, web
from pyspark.sql import functions as F


def times(df, word):
    return df._jdf.queryExecution().optimizedPlan().toString().count(word)


def test_units_take_a_text_apart_once(spark):
    df = spark.createDataFrame([("a bc, 中文 abcdefghijkl",), ("",), (None,)], "t string")
    out = df.select("t", mixed_units("t").alias("n"))
    assert times(out, "regexp_extract_all") == 1
    assert {r["t"]: r["n"] for r in out.collect()} == {"a bc, 中文 abcdefghijkl": 8, "": 0, None: 0}


def test_a_paragraph_is_stripped_once(spark):
    rows = ["text", " 　", "", None, " Menu a", "a menu", "all Rights Reserved, 1", "　导航", "footer", "\t© x", "下一篇"]
    out = spark.createDataFrame([(r,) for r in rows], "p string").filter(web.is_meaningful(F.col("p")))
    assert times(out, "regexp_replace") == 1
    assert sorted(r["p"] for r in out.collect()) == ["a menu", "text"]


def test_a_summary_is_judged_once(spark):
    chunks = spark.createDataFrame([(1, 12), (1, 11), (2, 21), (3, 31), (4, 41)], "doc int, chunk_id int")
    said = [(1, "A summary  of an order by clerk and date"), (2, "none of it"), (3, None), (4, "aa " * 20), (5, "A summary of no chunk at all, said by a clerk")]
    out = retrieval.summary_units(chunks, spark.createDataFrame(said, "doc int, summary string"))
    assert times(out, "regexp_extract_all") == 3
    assert [tuple(r) for r in out.collect()] == [(11, "doc_summary", "A summary of an order by clerk and date", 35, False)]
