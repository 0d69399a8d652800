"""The kept lexical index against a plain index and against recall over whole texts."""

import random

import pytest
from granary.operators import lexical
from granary.operators.lexical_index import LexicalIndex, query_plans
from pyspark.sql import functions as F

SCHEMA = "unit_id long, scope string, text string"
WORDS = ["red", "Ring", "the", "economy", "bolt,", "x-ray", "中国大学", "the red", "(small)", "ringing"]


def texts(seed, ids):
    rng = random.Random(seed)
    return [(i, rng.choice(["answer", "question"]), rng.choice(["", None, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9)))] + [" ".join(rng.choice(WORDS) for _ in range(6))] * 4)) for i in ids]


def held(index):
    return sorted((r.unit_id, r.scope, r.body) for r in index.units().collect())


def plain(rows):
    return sorted((i, s, (t or "").strip().lower()) for (i, s), t in rows.items())


@pytest.fixture
def index(spark, tmp_path):
    return LexicalIndex(spark, str(tmp_path / "index"), 8)


def test_changes_equal_a_plain_table(spark, index):
    """Upserts, repeats and deletions in turn; postings always are those of the texts that count."""
    rng, want = random.Random(1), {}
    assert held(index) == [] and index.postings().count() == 0
    for step in range(5):
        new = texts(step, rng.sample(range(40), 15))
        index.upsert(spark.createDataFrame([*new, new[0], (None, "answer", "red"), (3, None, "red")], SCHEMA))
        want |= {(i, s): t for i, s, t in new}
        gone = rng.sample(sorted(want), 4)
        index.delete(spark.createDataFrame([*gone, (999, "answer")], "unit_id long, scope string"))
        want = {k: t for k, t in want.items() if k not in gone}
        if step == 3:
            index.compacted()
            index.cleaned()
            assert len(index.generations()) == 1
        assert held(index) == plain(want)
        fresh = LexicalIndex(spark, index.path, 8)
        tokens = fresh.units().select("unit_id", "scope", F.explode(F.array_union(lexical.text.lexical_tokens("body"), lexical.text.cjk_terms("body"))).alias("token"))
        assert sorted(map(tuple, fresh.postings().select("unit_id", "scope", "token").collect())) == sorted(map(tuple, tokens.collect()))


def test_what_is_the_same_writes_nothing(spark, index):
    rows = spark.createDataFrame(texts(2, range(20)), SCHEMA)
    assert index.upsert(rows) == 1
    assert index.upsert(rows) is None and index.delete(spark.createDataFrame([(99, "x")], "unit_id long, scope string")) is None
    assert index.generations() == [1]
    changed = rows.withColumn("text", F.when(F.col("unit_id") == 4, F.lit("new")).otherwise(F.col("text")))
    assert index.upsert(changed) == 2
    assert spark.read.parquet(f"{index.path}/units/generation=2").count() == 1


def test_changes_that_fail_leave_nothing(spark, index, monkeypatch):
    index.upsert(spark.createDataFrame(texts(3, range(10)), SCHEMA))
    before = held(index)
    monkeypatch.setattr(LexicalIndex, "_commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        index.upsert(spark.createDataFrame(texts(4, range(30)), SCHEMA))
    with pytest.raises(OSError):
        index.delete(spark.createDataFrame([r[:2] for r in before], "unit_id long, scope string"))
    assert held(index) == before
    monkeypatch.undo()
    index.upsert(spark.createDataFrame([(77, "answer", "red ring")], SCHEMA))
    assert held(index) == sorted([*before, (77, "answer", "red ring")])
    assert sorted(r.unit_id for r in index.postings(spark.createDataFrame([("ring",)], "token string")).filter("unit_id > 30").collect()) == [77]


def test_two_changes_at_once(spark, index):
    other = LexicalIndex(spark, index.path, 8)
    other._next = lambda: 1
    index.upsert(spark.createDataFrame([(1, "answer", "red")], SCHEMA))
    with pytest.raises(Exception, match="(?i)exists"):
        other._commit(1, False)


def test_search_reads_only_the_buckets_of_its_tokens(spark, index):
    index.upsert(spark.createDataFrame([(i, "answer", f"word{i} shared") for i in range(200)], SCHEMA))
    found = index.postings(spark.createDataFrame([("word7",)], "token string"))
    assert [r.unit_id for r in found.collect()] == [7]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    rows = index._live("postings", [r[0] for r in spark.createDataFrame([("word7",)], "token string").select(index._bucket("token")).collect()])
    read = {f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}
    rows.collect()
    scan = rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert len(read) >= 1 and scan.metrics().apply("numPartitions").value() == 1


@pytest.mark.parametrize("stopwords", [[], ["the"]])
def test_batch_search_equals_recall_over_whole_texts(spark, index, stopwords):
    rows = texts(5, range(150))
    frame = spark.createDataFrame(rows, SCHEMA)
    index.upsert(frame)
    queries = ["the red ring", "Ring", "中国大学 ring", "economy (small)", "国大学", "the", "", "nothing at all"]
    asked = [(q, t, ["red ring"] if q % 2 else None, ["bolt", "ring"] if q % 3 == 0 else None) for q, t in enumerate(queries)]
    plans = query_plans(spark.createDataFrame(asked, "query_id int, text string, favoured_phrases array<string>, favoured_terms array<string>"), stopwords)
    got = {}
    for r in sorted(index.search(plans, 12).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.unit_id, r.score))
    # The index holds windows as words, so that a word of two signs finds them.
    inner = index.search(query_plans(spark.createDataFrame([(1, "国大")], "query_id int, text string")), 5).collect()
    assert len(inner) == 5 and {r.score for r in inner} == {round(1.9 / 2.7, 4)}
    for q, t, phrases, terms in asked:
        plan = lexical.query_plan(t, priority_terms=terms or (), priority_phrases=phrases or (), stopwords=stopwords)
        want = [(r.unit_id, r.score) for r in lexical.recall(frame, plan, 12, tie="unit_id").collect()]
        assert [s for _, s in got.get(q, [])] == [s for _, s in want], t
        assert [x for x in got.get(q, []) if x[1] > want[-1][1]] == [x for x in want if x[1] > want[-1][1]]


def test_written_rows_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def token(n):
        made.add(1)
        return f"w{n % 7}"

    rows = spark.range(90).select(F.col("id").alias("unit_id"), F.lit("a").alias("scope"), token("id").alias("token"), (F.col("id") % 4).cast("int").alias("bucket"))
    index = LexicalIndex(spark, str(tmp_path / "index"), 4)
    index._write(rows, "postings", 1, "token", "unit_id", "scope")
    assert made.value == 90 and spark.read.parquet(f"{index.path}/postings").count() == 90
