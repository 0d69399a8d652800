"""Entries in texts, both ways, and fields of nested metadata, against plain versions."""

import json
import random
import re

import pytest
from granary.operators import analysis, chat, filters, ranking
from pyspark.sql import functions as F

TEXTS = [(1, "see  the  Red\tring here"), (2, ""), (3, None), (4, "REDRING"), (5, "a b c"), (6, "here"), (7, "the the the  red ring")]
ENTRIES = ["red ring", "the  red", "here", "r", None, " ", "Here", "here", "redr", "the", "ring  here", "zzzz"]


def clean(s):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", s or "").strip(" ").lower()


def plain(texts, entries):
    return sorted({(i, e) for i, t in texts for e in entries if len(clean(e)) >= 2 and clean(e) in clean(t)})


def random_data(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abAB") for _ in range(rng.randrange(1, 4)))
    phrase = lambda n: rng.choice([" ", "  ", "\t", "\n"]).join(word() for _ in range(rng.randrange(n)))
    return [(i, phrase(15)) for i in range(40)], [phrase(4) for _ in range(60)]


@pytest.mark.parametrize("data", [(TEXTS, ENTRIES), random_data(1), random_data(2)], ids=["odd", "one", "two"])
def test_both_ways_find_what_a_plain_search_finds(spark, data):
    texts, entries = data
    rows = spark.createDataFrame(texts, "id long, text string")
    words = spark.createDataFrame([(e, 1) for e in entries], "word string, other int")
    for most in (1000, 0):
        got = analysis.dictionary_matches(rows, "id", "text", words, "word", most_sent=most)
        assert sorted(map(tuple, got.collect())) == plain(texts, entries), most


def test_entries_keep_their_columns_and_equal_ones_their_rows(spark):
    entries = spark.createDataFrame([(1, "red ring"), (2, "RED  ring"), (3, "none of it")], "entry_id int, term string")
    got = analysis.contained(spark.createDataFrame([(9, "a Red Ring")], "query_id int, query string"), "query_id", "query", entries, "term")
    assert sorted(map(tuple, got.select("query_id", "entry_id", "term").collect())) == [(9, 1, "red ring"), (9, 2, "RED  ring")]


def test_windows_are_joined_without_their_text(spark):
    """What is exploded by window holds an id and the window, and nothing else."""
    found = analysis.contained(spark.createDataFrame(TEXTS, "id long, text string"), "id", "text", spark.createDataFrame([("red ring",)], "e string"), "e")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in plan.splitlines() if "Generate explode" in line and "_anchor" in line]
    above = [plan.splitlines()[plan.splitlines().index(line) - 1] for line in generated]
    assert generated and not any("_q" in line.split("Project [")[-1].split("]")[0] for line in above if "Project [" in line)


def plain_paths(value, path=""):
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in plain_paths(v, f"{path}.{k.strip()}" if path else k.strip()) if k.strip()]
    if isinstance(value, list):
        return [(path, v) for v in value if not isinstance(v, (dict, list)) and v is not None and str(v).strip()]
    return [(path, value)] if value is not None and str(value).strip() else []


def test_fields_of_metadata_however_deep(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.5:
            return {rng.choice(["a", "b ", " c"]): value(depth - 1) for _ in range(rng.randrange(3))}
        return rng.choice(["x", "y", " ", None, ["p", "q", " "], [], "z"])

    deep = "bottom"
    for i in range(15):
        deep = {f"level{15 - i}": deep}
    docs = [{"m": value(4)} for _ in range(60)] + [deep, {}]
    rows = spark.createDataFrame([(json.dumps(d),) for d in docs] + [(None,), ("not json",), ("[1]",)], "doc string")
    want = {}
    for p, v in (x for d in docs for x in plain_paths(d)):
        want.setdefault(p, []).append(v)
    got = {r.path: (r.n, r["values"]) for r in filters.json_paths(rows, "doc", 2).collect()}
    assert got == {p: (len(v), sorted(set(v))[:2]) for p, v in want.items()}
    assert max(p.count(".") for p in got) == 14
    assert filters.json_paths(rows.filter(F.lit(False)), "doc").count() == 0


def test_terms_put_in_both_ways(spark):
    """The longest term at each place, in one pass, whether the terms go with the rows or are joined."""
    rng = random.Random(5)
    terms = {"".join(rng.choice("abc ") for _ in range(rng.randrange(1, 5))): f"<{i}>" for i in range(60)}
    terms = {t: v for t, v in terms.items() if t.strip() == t and t}
    queries = [(i, "".join(rng.choice("abc d") for _ in range(rng.randrange(25)))) for i in range(80)] + [(100, None)]
    pattern = re.compile("|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))))
    want = {i: None if q is None else pattern.sub(lambda m: terms[m.group()], q) for i, q in queries}
    frame = spark.createDataFrame(queries, "id int, query string")
    mapping = spark.createDataFrame(list(terms.items()), "user_term string, professional_term string")
    for most in (1000, 0):
        got = chat.rewritten(frame, "id", "query", mapping, most_sent=most).collect()
        assert {r.id: r.rewritten for r in got} == want, most
    none = chat.rewritten(frame, "id", "query", mapping.limit(0)).collect()
    assert {r.id: r.rewritten for r in none} == dict(queries)


def test_numbers_without_one_task(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(50)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "id int, v int").repartition(7)
    got = ranking.numbered(frame, "n", "v", -F.col("id")).collect()
    want = {(i, v): n for n, (v, _, i) in enumerate(sorted((v, -i, i) for i, v in rows), 1)}
    assert {(r.id, r.v): r.n for r in got} == want
    plan = ranking.numbered(frame, "n", "v", "id")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert ranking.numbered(frame.limit(0), "n", "v").count() == 0


def test_equal_queries_and_equal_terms_are_sought_once(spark, monkeypatch):
    """Copies of a query or of a glossary's term multiply neither the search nor the pairs before the ranks."""
    sizes, whole = [], analysis.contained

    def counted(queries, query_id, query, entries, entry):
        sizes.append((queries.count(), entries.count()))
        return whole(queries, query_id, query, entries, entry)

    monkeypatch.setattr(analysis, "contained", counted)
    queries = spark.createDataFrame([(i, ["Red  Ring", "red ring"][i % 2]) for i in range(6)] + [(9, None)], "query_id int, query string")
    glossary = spark.createDataFrame([(i, "red ring", i == 3) for i in range(5)] + [(7, "RED", None), (8, "red", False)], "entry_id int, term string, own boolean")
    forced = spark.createDataFrame([(9, "Red"), (9, "red ring")], "query_id int, term string")
    got = analysis.glossary_entries(queries, glossary, forced, 2).collect()
    assert sorted((r.query_id, r.entry_id, r["rank"]) for r in got) == [(q, e, k) for q in (*range(6), 9) for e, k in ((3, 1), (8, 2))]
    lexicon = spark.createDataFrame([(0, "ring", ["x"], 1.0, True)], "item_no int, term string, aliases array<string>, weight double, enabled boolean")
    assert sorted(r.query_id for r in analysis.match_lexicon(queries, lexicon).collect()) == list(range(6))
    assert sizes == [(2, 2), (2, 2)]  # the item has a term and an alias


@pytest.mark.parametrize("most", [1000, 0], ids=["few", "many"])
def test_windows_of_queries_are_not_sent(spark, monkeypatch, tmp_path, most):
    """Windows are many times their texts, which Spark's size of exploded rows doesn't say: few entries go to them, many are merged."""
    texts, entries = random_data(4)
    entries += [f"entry {i} that is in no text and makes their table the larger one" for i in range(200)]
    monkeypatch.setattr(analysis, "MOST_SENT", most, raising=False)
    spark.createDataFrame(texts, "id long, text string").write.parquet(f"{tmp_path}/texts")  # files have a size
    spark.createDataFrame([(e,) for e in dict.fromkeys(entries)], "word string").write.parquet(f"{tmp_path}/words")
    found = analysis.contained(spark.read.parquet(f"{tmp_path}/texts"), "id", "text", spark.read.parquet(f"{tmp_path}/words"), "word")
    joins = re.findall(r"(\w+Join) \[_anchor#\d+\], \[_anchor#\d+\], Inner(, Build\w+)?", found._jdf.queryExecution().executedPlan().toString())
    assert joins == [("BroadcastHashJoin", ", BuildRight") if most else ("SortMergeJoin", "")]
    assert sorted((r.id, r.word) for r in found.collect()) == plain(texts, entries)
