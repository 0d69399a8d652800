"""Operators against plain versions, and properties that must hold."""

import random

import pytest
from granary.functions import scoring, text, udfs
from granary.operators import chunking, filters, retrieval, trees
from granary.operators.retrieval import Search
from granary.operators.upserts import changes, upsert
from granary.sources import files
from pyspark.sql import functions as F


def one(spark, column, value=None, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("r")).first().r


# Filter trees


def test_parse_drops_bad_nodes_and_collapses():
    leaf = {"op": "eq", "field": "a", "value": True}
    assert filters.parse({"op": "and", "items": [leaf, {"op": "nope"}]}) == filters.Node("eq", "a", (), ("true",))
    assert filters.parse({"op": "or", "items": []}) is None and filters.parse("x") is None
    deep = leaf
    for _ in range(9):
        deep = {"op": "not", "items": [deep]}
    assert filters.parse(deep) is None
    assert len(filters.parse({"op": "in", "field": "a", "values": list(range(100))}).values) == filters.MOST_VALUES
    assert filters.uses(filters.parse({"op": "not", "items": [leaf]}), {"a"})


def test_only_keeps_what_is_not_stricter():
    a, b = {"op": "eq", "field": "a", "value": 1}, {"op": "eq", "field": "b", "value": 2}
    keep = lambda op: filters.only(filters.parse({"op": op, "items": [a, b]}), {"a"})
    assert keep("and") == filters.parse(a) and keep("or") is None


def test_missing_values_match_negations(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("{}",), (None,)], "m string")
    count = lambda raw: df.filter(filters.over_json(filters.parse(raw), "m")).count()
    assert count({"op": "ne", "field": "k", "value": 1}) == 2
    assert count({"op": "not", "items": [{"op": "eq", "field": "k", "value": 1}]}) == 0
    assert df.filter(filters.id_condition(F.col("m"), "in", [])).count() == 0 and df.filter(filters.id_condition(F.col("m"), "not_in", [])).count() == 3


def test_adding_a_condition_never_adds_rows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    a = filters.parse({"op": "in", "field": "k", "values": list(range(50))})
    b = filters.parse({"op": "ne", "field": "k", "value": 7})
    assert events.filter(filters.over_json(filters.both(a, b), "props")).count() <= events.filter(filters.over_json(a, "props")).count()


# Fusion


def plain_fuse(hits, search):
    """The same rules as a fold over the hits in order."""
    groups = {}
    for h in sorted(hits, key=lambda h: h["seq"]):
        least = search.vector_threshold if h["backend"] == "vector" else search.lexical_threshold
        if h["score"] < least:
            continue
        g = groups.setdefault(h["group_key"], {"v": 0.0, "k": 0.0, "scopes": set(), "backends": set(), "n": {}, "best": None, "first": h["seq"]})
        key = "v" if h["backend"] == "vector" else "k"
        g[key] = max(g[key], h["score"])
        g["scopes"].add(h["scope"])
        g["backends"].add(h["backend"])
        n = g["n"][h["scope"]] = g["n"].get(h["scope"], 0) + 1
        w = search.scopes.get(h["scope"], scoring.OTHER_SCOPE)
        meaning = (g["v"] * search.vector_weight + g["k"] * search.lexical_weight) * w
        repeat = {"answer": min(0.08, 0.02 * (n - 1)), "row_fragment": min(0.05, 0.015 * (n - 1))}.get(h["scope"], 0.0)
        boost = min(0.1, max(0.0, h["boost"]))
        boost = 0.0 if meaning < 0.2 else round(boost * 0.5, 4) if meaning < 0.35 else round(boost, 4)
        bonus = min(0.2, min(0.12, 0.03 * (len(g["scopes"]) - 1)) + (0.05 if len(g["backends"]) > 1 else 0) + repeat + h["bonus"] + boost)
        score = round(min(1.0, meaning + bonus), 6)
        if g["best"] is None or score >= g["best"][0]:
            g["best"] = (score, h["chunk"])
    out = sorted(((g["best"][0], -g["first"], k, g["best"][1]) for k, g in groups.items()), key=lambda x: (-x[0], -x[1]))
    return [(k, s, a) for s, _, k, a in out[: search.rerank_n] if s >= search.threshold]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fusion_equals_the_fold(spark, seed):
    random.seed(seed)
    hits = [
        {"seq": i, "backend": "vector" if i < 80 else "lexical", "group_key": f"g{random.randrange(25)}", "chunk": i, "scope": random.choice(["answer", "row_fragment", "question", "odd"]), "score": random.randrange(20) / 20, "boost": random.choice([0.0, 0.04, 0.08]), "bonus": random.choice([0.0, 0.03])}
        for i in range(150)
    ]
    search = Search(rerank_n=15, vector_threshold=0.1, lexical_threshold=0.2, threshold=0.25).clamped()
    shuffled = hits[:]
    random.shuffle(shuffled)
    schema = "seq long, backend string, group_key string, chunk long, scope string, score double, boost double, bonus double"
    frame = spark.createDataFrame([tuple(h[c.split()[0]] for c in schema.split(", ")) for h in shuffled], schema).repartition(4)
    got = [(r.group_key, round(r.score, 6), r.anchor) for r in retrieval.fuse(frame, search).collect()]
    want = plain_fuse(hits, search)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[2] for g in got] == [w[2] for w in want]
    assert all(abs(g[1] - w[1]) < 1e-5 for g, w in zip(got, want, strict=True))


def test_search_limits():
    s = Search(top_k=50, rerank_n=20, vector_k=9999).clamped()
    assert (s.top_k, s.vector_k, s.keyword_k) == (20, 500, 80)


# Chunking


def texts(seed=5, n=30):
    random.seed(seed)
    piece = lambda: "".join(random.choice("ab cd. é\n") for _ in range(random.randint(0, 300)))
    return [None, "", "x" * 900, *(piece() for _ in range(n))]


@pytest.mark.parametrize("name", sorted(udfs.CHUNKERS))
def test_chunks_cover_the_text(spark, name):
    df = spark.createDataFrame(list(enumerate(texts())), "i int, t string")
    options = {"size": 100, "overlap": 0}
    rows = udfs.chunked(df, "t", name, **options).orderBy("i", "position").collect()
    for i, t in enumerate(texts()):
        joined = "".join(r.content for r in rows if r.i == i)
        squeeze = lambda s: "".join(s.split())
        assert squeeze(joined) == squeeze(t or "")
    if name in ("fixed", "recursive"):
        assert all(len(r.content) <= 100 for r in rows)


def test_overlap_must_be_less_than_size():
    with pytest.raises(ValueError):
        chunking.windows("t", 10, 10)
    with pytest.raises(ValueError):
        udfs.chunked(None, "t", "nope")


def test_headings(spark):
    body = "intro\n# A\none\n## B\ntwo\nthree\n# C\n### D"
    rows = chunking.heading_sections(spark.createDataFrame([(1, body)], "id int, t string"), "id", "t").orderBy("section").collect()
    assert [(r.level, r.heading, r.path, r.content) for r in rows] == [(0, None, "", "intro"), (1, "A", "A", "one"), (2, "B", "A > B", "two\nthree"), (1, "C", "C", ""), (3, "D", "C > D", "")]


# Text


@pytest.mark.parametrize(
    "function,value,want",
    [
        (text.normalize_lexical, "  Foo,\tBAR！baz ", "foo bar baz"),
        (text.ascii_terms, "a-b. x 3.14/ zz zz", ["a-b", "3.14", "zz"]),
        (text.cjk_terms, "知识库 x 检", ["知识库", "知识", "识库"]),
        (text.mixed_units, "知识 word abcdefghijk !", 2 + 1 + 3 + 1),
        (text.normalize_url, "Example.COM/a/?q=1#f", "https://example.com/a?q=1"),
        (text.normalize_url, "HTTP://Ex.com", "http://ex.com"),
        (text.strip_html, "<p>a</p><script>x<y</script> b", "a b"),
        (text.tags_of, "a, b；a;;c", ["a", "b", "c"]),
        (text.value_type, "2024/1/5", "datetime"),
        (text.value_type, "1", "bool"),
        (text.value_type, "12", "int"),
        (text.value_type, "-1.5", "float"),
        (text.strip_json_fence, '```json\n{"a": 1}\n```', '{"a": 1}'),
        (text.numeric_density, "a1 2", 2 / 3),
        (text.low_value_summary, "short", True),
        (text.match_text, "A-b_c!", "a b_c"),
        (text.mixed_units, None, 0),
        (text.ascii_terms, None, []),
    ],
)
def test_text_functions(spark, function, value, want):
    got = one(spark, function("v"), value)
    assert got == want or abs(got - want) < 1e-9


def test_scores(spark):
    assert one(spark, text.lexical_score(F.lit(1.5))) == 0.6522
    assert one(spark, text.question_match(F.lit("How to reset?"), F.lit("how to reset"))) == pytest.approx(1.0)
    assert one(spark, text.bigrams(F.lit("a"))) == ["a"] and one(spark, text.bigrams(F.lit(""))) == []
    assert one(spark, scoring.distance_decay(F.lit(9))) == 0.30
    assert one(spark, udfs.replace_longest(F.lit("ab abc"), {"ab": "abc", "abc": "x"})) == "abc x"
    assert one(spark, text.keywords(F.array(F.lit("文档"), F.lit(" a,"), F.lit("A"), F.lit("b。c")), 5)) == ["a"]


# Trees, changes, files


def test_moves_and_closure(spark):
    assert one(spark, trees.moved(F.lit("a.b.c"), "a.b", "x"), None) == "x.c" and one(spark, trees.moved(F.lit("a.bc"), "a.b", "x"), None) == "a.bc"
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 12)], "c int, p int")
    assert trees.closure(links, "c", "p").count() == 66


def test_closure_of_deep_chains_and_cycles(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 41)] + [(100, 101), (101, 102), (102, 100), (200, None)], "c int, p int")
    chain = {(i, j, i - j) for i in range(1, 41) for j in range(i)}
    cycle = {(100 + i, 100 + (i + d) % 3, d) for i in range(3) for d in (1, 2, 3)}
    rows = [tuple(r) for r in trees.closure(links, "c", "p").collect()]
    assert len(rows) == len(chain | cycle) and set(rows) == chain | cycle


def test_changes(spark):
    old, new = (spark.createDataFrame(rows, "id int, v string") for rows in ([(1, "a"), (2, "b"), (3, None)], [(2, "c"), (3, None), (4, "d")]))
    assert {r.id: r.action for r in changes(old, new, ["id"], ["v"]).collect()} == {1: "delete", 2: "update", 3: "keep", 4: "insert"}
    assert {r.id: r.v for r in upsert(old, new, ["id"]).collect()} == {1: "a", 2: "c", 3: None, 4: "d"}


def test_delimited_and_templates(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("name;n\n a ;1\n;\nb;2\n")
    rows = files.read_delimited(spark, str(p))
    assert [tuple(r) for r in rows.collect()] == [("a", "1"), ("b", "2")]
    assert files.table_rows(rows, "s").first().header == ["name", "n"]
    q = tmp_path / "qa.csv"
    q.write_text("question,answer,similar_questions,tags,enabled\nWhy?,Because,How?||Who?,\"x,y;x\",no\n")
    row = files.read_qa(spark, str(q)).first()
    assert (row.similar_questions, row.tags, row.is_enabled, row.category) == (["How?", "Who?"], ["x", "y"], False, None)
    q.write_text("question,what\na,b\n")
    with pytest.raises(ValueError):
        files.read_qa(spark, str(q))


def test_decoding_and_paths(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("知识库检索平台".encode("gb18030"))
    (tmp_path / "b.txt").write_bytes("é".encode())
    out = {r.path[-5:]: (r.text, r.encoding) for r in files.decoded(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert out == {"a.txt": ("知识库检索平台", "gb18030"), "b.txt": ("é", "utf-8")}
    assert one(spark, files.is_temporary(F.lit("t/documents/temp/x")), None) and not one(spark, files.is_temporary(F.lit("t/documents/x")), None)
    assert one(spark, files.parser_for(F.lit("a/b.MD")), None) == "markdown"


# Markdown and rules


def table_text(rows):
    return "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | {'w ' * n}|" for i, n in enumerate(rows))


def test_table_parts_repeat_the_header_and_lose_nothing(spark):
    from granary.operators import markdown

    body = table_text([3, 5, 200, 1, 4])
    parts = one(spark, markdown.split_table(F.col("v"), 40), body)
    assert len(parts) > 2 and all(p.startswith("| a | b |\n| --- | --- |\n") for p in parts)
    assert [line for p in parts for line in p.split("\n")[2:]] == body.split("\n")[2:]


def test_code_list_and_small_pieces(spark):
    from granary.operators import markdown

    code = "```py\n" + "\n".join(f"x{i} = {i}" for i in range(30)) + "\n```"
    parts = one(spark, markdown.split_code(F.col("v"), 30), code)
    assert len(parts) > 1 and all(p.startswith("```py\n") and p.endswith("\n```") for p in parts)
    items = one(spark, markdown.split_list(F.col("v"), 6), "- a b\n  more\n- c\n- d e f g h i j")
    assert items[0].startswith("- a b\n  more") and "\n".join(items) == "- a b\n  more\n- c\n- d e f g h i j"
    merged = one(spark, markdown.merge_small(F.array(F.lit("a b c d"), F.lit("e"), F.lit("f g h i j"), F.lit("k")), 3, 6), None)
    assert merged == ["a b c d\n\ne", "f g h i j\n\nk"]


def test_rules(spark):
    from granary.operators import rules

    status = rules.enhancement(F.col("v"), F.lit("text"), F.lit(True), least=3)["reason"]
    assert one(spark, status, " ") == "empty" and one(spark, status, "a b") == "short" and one(spark, status, "1 2 3 4 5") == "numeric" and one(spark, status, "a b c d") == "ok"
    assert one(spark, rules.usable_summary("v"), "too short") is None
    assert rules.merged_config({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}, {"b": 4}) == {"a": {"x": 1, "y": 3}, "b": 4}
    assert one(spark, rules.merged_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))["b"]) == "3"
