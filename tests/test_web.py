import random

import plain_html
from granary.operators import page_elements, web

TABLE = "<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td>2</td></tr></table>"
SPANNED = "<table><tr><th colspan='2'>a</th></tr><tr><td>1</td><td>x &lt; y</td></tr></table>"
LONG = "This paragraph says enough to count as a section of its own."
PAGE = f"""<!DOCTYPE html><html><head><title>t</title><script>var x = "<p>no</p>";</script></head><body><div class="intro top"><h1>Guide</h1><p>{LONG}<br>More.<p>Second <b>one</b>.</div><p>short</p><aside><p>{LONG}</p></aside><div id="t"><h2>Data</h2>{TABLE}<ul><li>one<li>two</ul>{SPANNED}</div></body></html>"""


def table_of(spark, pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")


def sections_by_page(spark, pages):
    out = {}
    for r in page_elements.page_sections(table_of(spark, pages), "page_id").collect():
        out.setdefault(r.page_id, []).append((r.section_no, r.section_type, r.title, r.markdown, [tuple(b) for b in r.blocks]))
    return [sorted(out.get(i, [])) for i in range(len(pages))]


def test_sections_of_a_page(spark):
    links = f'<body><div><a href="/">{LONG}</a></div><main><h1>T</h1><table><tr><td>{LONG}</td></tr></table></main></body>'
    (intro, aside, data), *others = sections_by_page(spark, [PAGE, "", None, "just text", links, "<p>" * 60 + "deep" + "<div>" * 60])
    assert (intro[1], intro[2]) == ("content_section", "Guide") and aside[1] == "sidebar" and data[1] == "table_section"
    assert intro[3] == f"# Guide\n\n{LONG}More.\n\nSecond one."
    kinds = [(b[0], b[1], b[3]) for b in data[4]]
    assert kinds == [(4, "heading", None), (5, "table", "markdown"), (6, "text", None), (7, "text", None), (8, "table", "html")]
    assert data[4][1][2] == "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |" and data[4][2][2] == "- one"
    assert data[4][4][2] == "<table><tr><th colspan='2'>a</th></tr><tr><td>1</td><td>x &lt; y</td></tr></table>"
    assert others[0] == others[1] == [] and others[2][0][3] == "just text" and others[4][0][3] == "deep"
    assert [s[2] for s in others[3]] == ["", "T"]


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        if depth < 4 and kind < 0.55:
            tag = rng.choice(["div", "section", "article", "p", "li", "ul", "h2", "b", "aside", "main", "a", "dd", "dt"])
            out.append(f"<{tag} class='c{rng.randrange(3)} x' id=i{rng.randrange(4)}>{random_page(rng, depth + 1)}" + (f"</{tag}>" if rng.random() < 0.8 else ""))
        elif kind < 0.65:
            width = rng.randrange(1, 4)
            cells = lambda t, width=width: "".join(f"<{t}>{rng.choice(['', 'x|y', 'some <b>cell</b>'])}" for _ in range(width))
            out.append(f"<table><tr>{cells('th')}" + "".join(f"<tr>{cells('td')}</tr>" for _ in range(rng.randrange(3))) + "</table>")
        elif kind < 0.72:
            out.append(rng.choice(["<br>", "<!-- no <p> -->", "<script>var a = '<p>no';</script>", "</b>", "<img src=a>"]))
        else:
            out.append(" ".join(f"word{rng.randrange(50)}" for _ in range(rng.randrange(1, 9))) + rng.choice([" ", "", " &lt; ", "\n\n"]))
    return "".join(out)


def test_pages_equal_a_plain_reader(spark):
    rng = random.Random(4)
    pages = [f"<html><body>{random_page(rng)}</body></html>" if i % 4 else random_page(rng) for i in range(120)]
    html = lambda sections: [(n, kind, title, blocks if all(b[3] != "html" for b in blocks) else [b[:2] for b in blocks]) for n, kind, title, _, blocks in sections]  # noqa: E731  tables stay as they are written
    for page, got in zip(pages, sections_by_page(spark, pages), strict=True):
        assert html(got) == html(plain_html.sections_of(page)), page


def test_selectors(spark):
    rng = random.Random(5)
    pages = [PAGE, *(random_page(rng) for _ in range(40))]
    text = lambda page: plain_html.parsed(page).text()
    for selector in ("div.intro h1", "#t li", ".top.intro p", "p >", ".none", "div.c1", "#i2 .c0", "*", "section.x p", "li#i1.c2"):
        found = {r.page_id: r.html for r in page_elements.with_selector(table_of(spark, pages), "page_id", "html", selector).collect()}
        for i, page in enumerate(pages):
            want = plain_html.selected(page, selector)
            assert text(found[i]) == text(want), (selector, page)
            assert selector == "*" or (found[i] == page) == (want == page)  # elements that have no end are not sought


def test_page_chunks(spark):
    big = "<table><tr><th>k</th><th>v</th></tr>" + "".join(f"<tr><td>{i}</td><td>value {i}</td></tr>" for i in range(40)) + "</table>"
    wide = "<table><tr><th rowspan='2'>k</th></tr>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(40)) + "</table>"
    rows = [(1, PAGE), (2, f"<body><div><h3>T</h3><p>Copyright 2020 by all of us, whoever we are.</p>{big}{wide}</div></body>"), (3, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    out = web.page_chunks(page_elements.page_sections(page_elements.with_selector(pages, "page_id", "html", " "), "page_id"), "page_id", 30).collect()
    of = lambda page, role: [r.content for r in sorted(out, key=lambda r: (r.section_no, r.position, r.part)) if r.page_id == page and r.role == role]
    assert len(of(1, "web_root")) == 3 and of(1, "web_text")[0].startswith("# Guide\n") and "# Guide\n# Guide" not in of(1, "web_text")[0] and not of(3, "web_root")
    assert of(2, "web_text") == []
    markdown, html = [p for p in of(2, "web_table_fragment") if p[0] == "|"], [p for p in of(2, "web_table_fragment") if p[0] == "<"]
    assert sum(len(p.split("\n")) - 2 for p in markdown) == 40 and all(p.startswith("| k | v |\n| --- | --- |\n") for p in markdown)
    assert sum(p.count("<td>") for p in html) == 40 and all(p.startswith("<table><tr><th rowspan='2'>k</th></tr>") and p.endswith("</table>") for p in html)
    assert len(of(2, "web_table_parent")) == 2 and all(not r.vectorize for r in out if r.role in ("web_root", "web_table_parent"))


def test_texts_of_a_page_end_at_tables(spark):
    block = lambda kind, text: (kind, text, "markdown" if kind == "table" else "text")
    blocks = [block("heading", "# T"), block("paragraph", "one"), block("list", "two"), block("table", "| a |"), block("paragraph", "menu"), block("table", "| b |"), block("heading", "## U"), block("paragraph", "three"), block("paragraph", "w " * 40), block("paragraph", "four")]
    schema = "page_id int, section_no int, title string, markdown string, blocks array<struct<type: string, text: string, format: string>>"
    rows = spark.createDataFrame([(1, 0, "T", "m", blocks), (2, 0, "", "m", []), (3, 0, "", "m", [block("paragraph", "alone")])], schema)
    out = web.page_chunks(rows, "page_id", 30).filter("role = 'web_text'").collect()
    got = {p: [r.content for r in sorted(out, key=lambda r: r.position) if r.page_id == p] for p in (1, 2, 3)}
    assert got == {1: ["# T\none\n\ntwo", "# T\nthree", "# T\n" + "w " * 40, "# T\nfour"], 2: [], 3: ["alone"]}


def test_containers_are_measured_without_joins(spark):
    """Running sums at both ends of an element: nested links count twice, an outer table holds the inner one."""
    html = "<body><a>ab<div role=main>c<a>d</a></div></a><table><tr><td>x<table><tr><td>y</table></table><h2>z</h2></body>"
    tokens = page_elements.page_tokens(spark.createDataFrame([(1, html)], "page_id int, html string"), "page_id", "html")
    scores = page_elements.container_scores(tokens, "page_id")
    assert "Join" not in scores._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.tag, r.score) for r in scores.collect()) == [("body", 7.0 - 2 + 160 + 40), ("div", 0.8)]
    tables = page_elements.measured_elements(tokens, "page_id").filter("tag = 'table'").orderBy("begin")
    assert [(r.around, r.tables) for r in tables.collect()] == [(0, 1), (1, 0)]


def test_tables_are_read_within_their_page(spark):
    """No token of a page becomes a row: nothing is joined, sorted or dealt out."""
    nested = "<table><tr><th>a<th>b<tr><td>x &amp;lt; | y<td><b> two\n\n words</b><tr><td>1<td>in <table><tr><td>p<td>q</table></table>"
    spanned = "<TABLE><tr><td>1<td>2<tr><td RowSpan=2>3<td>4</TABLE>"
    line = "<table><tr><td>1<td>2<br/></td></tr><tr><td></td></tr></table>"
    pages = [f"<p>{nested}<div>{spanned}{line}", "<table>", "<tr><td>1<td>2<tr><td>3<td>4", "", None, "<table><tr><td>1<td>a\nb<tr><td>3<td>4</table><!-- <table> --><table><tr><td>1<td>2<tr><td>3<td>4"]
    found = page_elements.page_tables(table_of(spark, pages), "page_id", "html")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Join", "Window", "Exchange", "Sort"))
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.page_id, r.begin)):
        got.setdefault(r.page_id, []).append((r.begin, r.simple, r.markdown))
    assert got == {
        0: [(1, True, "| a | b |\n| --- | --- |\n| x &lt; \\| y | two words |\n| 1 | in pq |\n| p | q |"), (40, False, None), (58, False, None)],
        1: [(0, False, None)],
        5: [(0, False, None), (18, True, "| 1 | 2 |\n| --- | --- |\n| 3 | 4 |")],
    }
