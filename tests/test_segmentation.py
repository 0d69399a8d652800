"""Dictionary segmentation against an exhaustive search."""

import math
import random
import re

import pytest
from granary.operators import segmentation
from granary.operators.segmentation import analyzed, best_path, segmented, weighted_dictionary
from pyspark.sql import functions as F

LETTERS = "天地人和中国大学生活动物"


def all_paths(run, weights, unknown):
    """Every way to cut a run, as (sum, words)."""
    if not run:
        return [(0, [])]
    sizes = [s for s in range(1, len(run) + 1) if run[:s] in weights]
    if 1 not in sizes:
        sizes.append(1)
    return [(weights.get(run[:s], unknown) + rest, [run[:s], *words]) for s in sizes for rest, words in all_paths(run[s:], weights, unknown)]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(1)
    found = {"".join(rng.choice(LETTERS) for _ in range(rng.choice([1, 2, 2, 2, 3, 4]))): rng.randrange(1, 1000) for _ in range(150)}
    return {**found, "大学": 50, "大学生": 50, "学生": 50, "生活": 50}


@pytest.fixture(scope="module")
def dictionary(spark, words):
    return weighted_dictionary(spark.createDataFrame([*words.items(), ("", 3), (None, 4)], "word string, n long")).persist()


def test_paths_are_the_best_ones(spark, words, dictionary):
    rng = random.Random(2)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 13))) for _ in range(60)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(900, None, 0), (901, "", 0), (902, "no signs", 0), (903, "中国，大学 and 天", 0), (904, "大" * 300, 0)]
    weights = {r.word: r.weight for r in dictionary.collect()}
    unknown = dictionary.first().unknown
    assert unknown == round(-math.log(sum(words.values())) * 1_000_000)
    frame = spark.createDataFrame(rows, "id long, body string, at int").withColumns({c: F.lit(1) for c in ("window", "head", "word", "size", "weight", "cut", "path")})
    got = {(r.id, r.run_no): r for r in segmented(frame, "id", "body", dictionary).collect()}
    for i, t in enumerate(texts):
        most, options = max(s for s, _ in all_paths(t, weights, unknown)), all_paths(t, weights, unknown)
        best = [w for s, w in options if s == most]
        assert got[i, 0].words == max(best, key=lambda w: [len(x) for x in w]), t
        search = []
        for w in got[i, 0].words:
            search += [w[j : j + n] for n in (2, 3) if len(w) > n for j in range(len(w) - n + 1) if w[j : j + n] in weights] + [w]
        assert [x.word for x in got[i, 0].search] == search
    assert [k for k in got if k[0] >= 900] and {k for k in got if k[0] >= 900} == {(903, 0), (903, 1), (903, 2), (904, 0)}
    assert "".join(got[904, 0].words) == "大" * 300


def test_dealt_out_and_sent_dictionaries_give_the_same(spark, dictionary):
    rng = random.Random(3)
    frame = spark.createDataFrame([(i, "".join(rng.choice(LETTERS) for _ in range(40))) for i in range(30)], "id long, body string")
    sent = sorted(map(tuple, segmented(frame, "id", "body", dictionary).select("id", "words").collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = segmented(frame, "id", "body", dictionary).select("id", "words")
        assert "BroadcastHashJoin" not in dealt._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, dealt.collect())) == sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_equal_paths_take_the_longer_first_word():
    assert best_path(4, [(1, 2, -5, False), (1, 1, -2, False), (2, 1, -3, True), (3, 2, -1, False), (1, 4, -6, False)], -9) == [(1, 4, False)]
    assert best_path(3, [], -9) == [(1, 1, False), (2, 1, False), (3, 1, False)]
    assert best_path(0, [], -9) == []


def test_terms_windows_and_what_is_ignored(spark):
    words = weighted_dictionary(spark.createDataFrame([("中国", 50), ("大学", 50), ("学生", 40), ("生活", 30)], "word string, n long"), spark.createDataFrame([("大学生",), ("中国",)], "word string"))
    rows = spark.createDataFrame([(1, "中国大学生 GPT-4 中国"), (2, "天地人"), (3, None), (4, "中国和")], "id long, body string")
    got = {r.id: r for r in analyzed(rows, "id", "body", words, ["学生", "地"]).collect()}
    assert [(t.text, t.score, t.source) for t in got[1].terms] == [("中国", 1.0, "own_word"), ("大学生", 1.0, "own_word"), ("大学", 0.94, "word"), ("gpt-4", 1.0, "letters")]
    assert got[1].ignored == ["学生"] and got[1].windows == ["中国大学生", "国大"]
    assert got[2].terms == [] and got[2].windows == ["天地人"]
    assert got[3].terms == [] and got[3].windows == []
    asked = {r.id: r for r in analyzed(rows, "id", "body", words, ["学生", "地"], "query").collect()}
    assert asked[1].windows == [] and asked[4].windows == ["中国和", "国和"]


def test_limits_of_a_mode(spark):
    body = " ".join(f"w{i}" for i in range(300)) + "".join(chr(0x4E00 + i) for i in range(200))
    rows = spark.createDataFrame([(1, body)], "id long, body string")
    words = weighted_dictionary(spark.createDataFrame([("天地", 1)], "word string, n long"))
    for mode in ("index", "query"):
        r = analyzed(rows, "id", "body", words, mode=mode).first()
        assert len(r.terms) == segmentation.MOST_TERMS[mode] and len(r.windows) == segmentation.MOST_WINDOWS[mode]
    nothing = weighted_dictionary(spark.createDataFrame([], "word string, n long"))
    assert [len(r.words) for r in segmented(rows, "id", "body", nothing).collect()] == [200]


def test_what_a_dictionary_is_counted_from_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(word):
        read.add(1)
        return word

    counted = spark.createDataFrame([("大学", 5), ("学生", 4), ("生活", 3)], "word string, n long").select(seen("word").alias("word"), "n")
    rows = spark.createDataFrame([(1, "大学生活")], "id long, body string")
    dictionary = weighted_dictionary(counted)
    before = read.value
    found = segmented(rows, "id", "body", dictionary).collect()
    assert [r.words for r in found] == [["大学", "生活"]] and read.value == before > 0


def test_stretches_are_not_sent_and_equal_runs_are_cut_once(spark, tmp_path, monkeypatch):
    """Stretches are many times their runs, which Spark's size of exploded rows doesn't say; copies of a text add none."""
    rng = random.Random(4)
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 13))) for _ in range(3000)]
    spark.createDataFrame([(w, 1) for w in words], "word string, n long").write.parquet(f"{tmp_path}/words")  # files have a size
    spark.createDataFrame([(i, "中国大学 and 学生活动") for i in range(20)], "id long, body string").coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows, dictionary, graphs = spark.read.parquet(f"{tmp_path}/rows"), weighted_dictionary(spark.read.parquet(f"{tmp_path}/words")), []
    whole = segmentation.word_graph
    monkeypatch.setattr(segmentation, "word_graph", lambda runs, *a: graphs.append(runs) or whole(runs, *a))
    found = segmented(rows, "id", "body", dictionary)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"(\w+Join) \[word#\d+\], \[word#\d+\]", plan) == ["SortMergeJoin"]
    got = found.collect()
    assert len(got) == 40 and len({tuple(r.words) for r in got}) == 2
    assert [g.count() for g in graphs] == [2]
