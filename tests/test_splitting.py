"""HTML and wide tables cut into parts that stand alone, and token counts, against plain versions."""

import random
import re
from html.parser import HTMLParser

import pytest
from granary.functions.text import mixed_units
from granary.functions.tokens import TokenCounter, Vocabulary, merged_count, read_ranks, to_lines
from granary.operators import chunking, markdown
from pyspark.sql import functions as F

VOID = ("br", "img")


class Balance(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.good = [], True

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        self.good = self.good and bool(self.open) and self.open.pop() == tag


def balanced(html):
    b = Balance()
    b.feed(html)
    b.close()
    return b.good and not b.open


def random_html(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.random()
        if depth < 5 and kind < 0.45:
            tag = rng.choice(["div", "p", "b", 'span class="x y"', "UL"])
            out.append(f"<{tag}>{random_html(rng, depth + 1)}</{tag.split()[0]}>")
        elif kind < 0.55:
            out.append(rng.choice(["<br>", '<img src="a b">', "<br/>", "<!-- a < b > c -->"]))
        else:
            out.append(rng.choice(["", " ", "\n"]) + " ".join(f"word{rng.randrange(90)}" for _ in range(rng.randrange(1, 12))) + rng.choice(["", " "]))
    return "".join(out)


def text_of(html):
    return re.sub(r"(?s)<!--.*?-->|</?[A-Za-z][^>]*>", "", html)


@pytest.mark.parametrize("budget", [5, 30, 120])
def test_html_parts_are_balanced_and_hold_the_whole(spark, budget):
    rng = random.Random(budget)
    docs = [random_html(rng) for _ in range(80)] + ["", "plain text only " * 30, "<p>" * 20 + "deep words here" + "</p>" * 20, "<div>" + "w " * 400 + "</div>"]
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, html string")
    rows = frame.select("id", F.posexplode(markdown.split_html(F.col("html"), budget)).alias("pos", "part")).select("*", mixed_units("part").alias("n")).collect()
    for i, d in enumerate(docs):
        parts = [r for r in sorted(rows, key=lambda r: r.pos) if r.id == i]
        assert all(balanced(r.part) for r in parts), d
        assert "".join(text_of(r.part) for r in parts) == text_of(d)
        assert sum(r.part.count("<!--") for r in parts) == d.count("<!--") and sum(r.part.count("<img") for r in parts) == d.count("<img")
        # A part over the budget holds no more than one word.
        assert all(r.n <= budget + 5 or len(text_of(r.part).split()) <= 1 for r in parts), (budget, d)


def test_html_that_is_not_balanced(spark):
    docs = ["<div><p>one two</div> three</p> four", "</b>x<i>y", "a < b & <c", "<ul><li>a<li>b</ul>"]
    frame = spark.createDataFrame([(d,) for d in docs], "html string")
    parts = [r.p for r in frame.select(F.explode(markdown.split_html(F.col("html"), 1000)).alias("p")).collect()]
    assert parts == ["<div><p>one two</p></div> three four", "x<i>y</i>", "a < b & <c", "<ul><li>a<li>b</li></li></ul>"]


@pytest.mark.parametrize("budget", [12, 40, 90, 400])
def test_header_heavy_tables(spark, budget):
    """Every cell stands once under its name (the key in every part), in order, and headers take no more than half of the budget."""
    rng = random.Random(budget)
    tables = []
    for _ in range(25):
        width, height = rng.randrange(1, 14), rng.randrange(0, 9)
        head = [f"name{i}" + " x" * rng.randrange(6) for i in range(width)]
        tables.append((head, [[f"r{r}c{c}" for c in range(width)] for r in range(height)]))
    line = lambda cells: "| " + " | ".join(cells) + " |"
    texts = ["\n".join([line(h), line(["---"] * len(h)), *map(line, rows)]) for h, rows in tables]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string")
    found = {}
    for r in frame.select("id", F.posexplode(markdown.split_header_heavy_table(F.col("body"), budget)).alias("pos", "part"), markdown.header_units(F.col("body")).alias("h")).orderBy("id", "pos").collect():
        found.setdefault(r.id, []).append(r.part)
    units = {r.part: r.n for r in spark.createDataFrame([(p,) for some in found.values() for p in some], "part string").select("part", markdown.header_units(F.col("part")).alias("n")).collect()}
    for i, (head, rows) in enumerate(tables):
        cells, columns = {}, []
        for part in found[i]:
            lines = [[c.strip() for c in x.strip()[1:-1].split("|")] for x in part.split("\n")]
            assert lines[0][0] == head[0] and set(lines[1]) == {"---"} and all(len(x) == len(lines[0]) for x in lines)
            assert units[part] <= max(budget // 2 + 12, 5) or len(lines[0]) <= 2 or len(head) <= 2
            columns += [c for c in lines[0][1:] if c not in columns]
            for x in lines[2:]:
                for name, value in zip(lines[0][1:], x[1:], strict=True):
                    cells.setdefault((x[0], name), []).append(value)
        assert columns == head[1:]
        assert cells == {(row[0], name): [v] for row in rows for name, v in zip(head[1:], row[1:], strict=True)}


def test_large_elements_are_cut_by_kind(spark):
    wide = "| " + " | ".join(f"column{i}" for i in range(40)) + " |\n|" + " --- |" * 40 + "\n| " + " | ".join("v" for _ in range(40)) + " |"
    page = "<div>\n" + "".join(f"<p>word number {i}</p>\n" for i in range(60)) + "</div>"
    cut = lambda kind, body: [r.p for r in spark.range(1).select(F.explode(markdown.split_element(F.lit(kind), F.lit(body), 60)).alias("p")).collect()]
    assert len(cut("table", wide)) > 5 and all(p.startswith("| column0 | ") for p in cut("table", wide))
    assert len(cut("html", page)) > 5 and all(balanced(p) for p in cut("html", page))


def plain_count(word, ranks):
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        joints = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not joints:
            break
        _, i = min(joints)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return len(parts)


@pytest.mark.parametrize("seed", range(4))
def test_merges_equal_a_plain_loop(seed):
    rng = random.Random(seed)
    pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 7))) for _ in range(200)}
    ranks = {p: i for i, p in enumerate(sorted(pieces, key=lambda _: rng.random()))}
    for _ in range(300):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40)))
        assert merged_count(word, ranks) == (1 if word in ranks else plain_count(word, ranks))
    assert merged_count(b"", ranks) == 0 and merged_count(b"ab" * 20_000, {b"ab": 0, b"abab": 1}) == 10_000


@pytest.fixture(scope="module")
def public():
    return pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_counts_equal_a_public_library(spark, public, name):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public.path(name), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(name)
    alphabet = "ab cdE' é中国😀\n\t.,!12ſ "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "we'll see it's done", "x" * 3000, " " * 50]
    counter = TokenCounter(read_ranks(spark, public.path(name)))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, text string")
    got = {r.id: r.n for r in frame.select("id", counter.count("text").alias("n")).collect()}
    assert [got[i] for i in range(len(texts))] == [len(library.encode_ordinary(t)) for t in texts] and got[len(texts)] == 0


def test_chunkers_take_tokens_as_their_size(spark, tmp_path):
    path = tmp_path / "ranks"
    path.write_text(to_lines([(bytes([b]), b) for b in range(256)] + [(b"ab", 256), (b" ab", 257)]))
    counter = TokenCounter(read_ranks(spark, str(path)))
    body = "ab ab ab ab\n\nxyz ab\n\nab\n\nqqqqqqqqqq"
    frame = spark.createDataFrame([(1, body)], "id int, text string")
    got = [r.content for r in frame.select(F.posexplode(chunking.paragraphs_by("text", 6, counter)).alias("pos", "content")).orderBy("pos").collect()]
    sizes = [Vocabulary({bytes([b]): b for b in range(256)} | {b"ab": 256, b" ab": 257}).count(p) for p in body.split("\n\n")]
    assert sizes == [4, 4, 1, 10] and got == ["ab ab ab ab", "xyz ab\n\nab", "qqqqqqqqqq"]


def test_rows_of_a_table_are_found_once(spark):
    from granary.operators import markdown, web

    frame = spark.range(1).select(F.col("id").cast("string").alias("t"))
    for cut, pattern in ((web.split_html_table(F.col("t"), 60), r"(?is)<tr\b.*?</tr>"), (markdown.split_wide_table(F.col("t"), 3), r"^\s*\||\|\s*$")):
        assert frame.select(cut)._jdf.queryExecution().optimizedPlan().toString().count(pattern) <= 2  # the expression, and its name


def test_names_of_replaced_rows_are_not_stored(spark, sf_dir):
    from granary.plans.families import replaced_rows

    found = replaced_rows(spark, sf_dir)
    assert "row_uid" in found.columns and all("row_uid" not in spark.read.parquet(f).columns for f in found.inputFiles()[:2])


def test_embedded_texts_are_taken_in_slices(spark):
    from granary.functions import udfs

    rows = spark.range(600).select("id", F.when(F.col("id") != 5, F.concat(F.lit("Word w"), F.col("id").cast("string"))).alias("t")).coalesce(1)
    sizes = udfs.embed(rows, "t").mapInArrow(lambda batches: batches, "id long, t string, vector array<double>")
    found = {r.id: r.vector for r in sizes.collect()}
    assert len(found) == 600 and set(found[5]) == {0.0} and all(abs(sum(x * x for x in v) - 1) < 1e-9 or not any(v) for v in found.values())
    assert udfs.MOST_EMBEDDED < 600


def plain_elements(body):
    lines, code, kinds = (body or "").split("\n"), False, []
    for line in lines:
        fence = re.match(r"[ \t\r\f\v]*```", line)
        marks = {"table": r"\s*\|", "list": r"\s*([-*+]|[0-9]+[.)]) ", "quote": r"\s*>", "html": r"\s*</?[a-zA-Z]"}
        kinds.append("code" if fence or code else next((k for k, m in marks.items() if re.match(m, line)), "plain"))
        code ^= bool(fence)
    starts = [i for i in range(len(lines)) if i == 0 or kinds[i] != kinds[i - 1]]
    runs = [(n, kinds[a], a, "\n".join(lines[a:b])) for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(lines)], strict=True), 1)]
    return [r for r in runs if r[3].strip()]


def test_elements_without_sorting_lines(spark):
    rng = random.Random(7)
    lines = ["", "  ", "text", "- a", "12) c", "+ d", "-no", " > q", "```", "```py", "\t```", "````", "| a |", "  |x", "<p>", "</p> x", "<1", "1.x"]
    texts = [None, "", "\n\n", "```", "```\n" * 401, *("\n".join(rng.choice(lines) for _ in range(rng.randrange(14))) for _ in range(300))]
    out = markdown.elements(spark.createDataFrame(list(enumerate(texts)), "id int, body string"), "id", "body")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "Exchange", "Sort", "Aggregate"))
    assert sorted(map(tuple, out.collect())) == [(i, *r) for i, t in enumerate(texts) for r in plain_elements(t)]
