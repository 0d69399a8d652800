import random
import re

from granary.operators import sections
from granary.operators.sections import HeadingRule
from granary.operators.user_rules import Separator, cut_by_rules
from pyspark.sql import functions as F


def test_rule_sections(spark):
    texts = [(1, "intro\n第1章 One\nbody\n1.1 Sub\n\nmore\n第2章 Two"), (2, "no heading at all"), (3, "第9章 X\n1.1 A\n1.2 B\ntext")]
    rules = [HeadingRule(r"^第\d+章", 1), HeadingRule(r"^\d+\.\d+ ", 2, keep=False)]
    rows = sections.rule_sections(spark.createDataFrame(texts, "id long, body string"), "id", "body", rules)
    got = sorted((r.id, r.section, r.level, r.path, r.content) for r in rows.collect())
    assert got == [
        (1, 0, 0, "", "intro"),
        (1, 1, 1, "第1章 One", "第1章 One\nbody"),
        (1, 2, 2, "第1章 One/1.1 Sub", "more"),
        (1, 3, 1, "第2章 Two", "第2章 Two"),
        (3, 1, 1, "第9章 X", "第9章 X"),
        (3, 2, 2, "第9章 X/1.1 A", "1.1 A"),
        (3, 3, 2, "第9章 X/1.2 B", "text"),
    ]


def row(no, level, path, n, heading=None):
    return (1, no, level, heading or path.split("/")[-1], path, f"{'#' * level} h{no}\n" + "word " * n if level else "word " * n)


def test_joined_sections(spark):
    schema = "id long, section int, level int, heading string, path string, content string"
    cases = [
        # A stub takes its sibling; the chapter that results is a parent of what follows.
        ([row(0, 1, "a", 1), row(1, 1, "b", 5), row(2, 2, "b/c", 5)], 400, ["b/c"]),
        # Small siblings of level 3 are drawn together, of level 2 only under one parent.
        ([row(0, 3, "a/b/c", 100), row(1, 3, "a/b/d", 100)], 400, ["a/b/d"]),
        ([row(0, 2, "a/b", 90), row(1, 2, "a/c", 40)], 400, ["a/c"]),
        ([row(0, 2, "b", 90), row(1, 2, "c", 40)], 400, ["b", "c"]),
        ([row(0, 2, "a/b", 100), row(1, 2, "a/c", 90)], 400, ["a/b", "a/c"]),
        # Nothing goes beyond the limit.
        ([row(0, 1, "a", 100), row(1, 2, "a/b", 150), row(2, 2, "a/c", 150)], 290, ["a/b", "a/c"]),
    ]
    for rows, limit, paths in cases:
        out = sections.joined_sections(spark.createDataFrame(rows, schema), "id", limit).orderBy("section").collect()
        assert [r.path for r in out] == paths, rows
        words = lambda texts: [w for t in texts for w in t.split()]
        assert words(r.content for r in out) == words(r[5] for r in rows)


def test_section_tree(spark):
    random.seed(5)
    text = lambda n: " ".join(random.choice(["alpha", "beta.", "gamma", "delta!"]) for _ in range(n))
    grid = "| a | b |\n| - | - |\n" + "\n".join(f"| r{i} | {text(3)} |" for i in range(60))
    code = "```py\n" + "\n".join(f"x{i} = {i}" for i in range(8)) + "\n```"
    rows = [(1, 0, "short", text(20)), (1, 1, "p/" * 3, "\n".join([text(90), grid, text(70), code, text(3)])), (2, 0, "long", "\n".join(text(60) for _ in range(12))), (3, 0, "", " \n")]
    out = sections.section_tree(spark.createDataFrame(rows, "id long, section int, path string, content string"), "id", 60, 120).collect()
    of = lambda *k: sorted((r.role, r.position, r.part, r.vectorize, r.content) for r in out if (r.id, r.section) == k)
    assert [r[0] for r in of(1, 0)] == ["section"] and not of(3, 0)
    children = [r for r in of(1, 1) if r[0] == "child"]
    assert [c for r in children for c in r[4].split()] == [w for w in rows[1][3].split()]
    table = next(r for r in children if r[4].startswith("| a"))
    assert not table[3] and all(r[3] for r in children if r is not table)
    parts = [r[4].split("\n") for r in of(1, 1) if r[0] == "part" and r[1] == table[1]]
    assert len(parts) > 1 and all(p[:2] == grid.split("\n")[:2] for p in parts) and [x for p in parts for x in p[2:]] == grid.split("\n")[2:]
    assert any(r[4].startswith(code) for r in children)  # with the short tail
    parents = [r for r in of(2, 0) if r[0] == "parent"]
    assert len(parents) > 1 and " ".join(r[4] for r in parents).split() == rows[2][3].split() and not any(r[3] for r in parents)


def test_hierarchy(spark):
    texts = [(1, "one two three"), (2, "\n".join(" ".join(f"w{i}" for i in range(30)) for _ in range(12))), (3, None)]
    out = sections.hierarchy(spark.createDataFrame(texts, "id long, body string"), "id", "body", 200).collect()
    assert [(r.level, r.is_leaf, r.content) for r in out if r.id == 1] == [(1, True, "one two three")]
    nodes = {r.place: r for r in out if r.id == 2}
    assert all(r.parent is None or len(nodes[r.parent].content) > len(r.content) for r in nodes.values())
    leaves = sorted((tuple(map(int, r.place.split("."))), r.content) for r in nodes.values() if r.is_leaf)
    assert " ".join(c for _, c in leaves).split() == texts[1][1].split() and not [r for r in out if r.id == 3]


def plain_cut(text, rules, size, overlap):
    def sliced(s):
        out, at = [], 0
        while True:
            out.append(s[at : at + size].strip())
            if at + size >= len(s):
                return [x for x in out if x]
            at += size - overlap

    def pieces(s, rule):
        pattern = re.escape(rule.pattern) if rule.literal else rule.pattern
        cuts = [m.end() if rule.keep == "previous" else len(s[: m.start()].rstrip("\r\n")) for m in re.finditer(pattern, s)]
        cuts = [0, *cuts, len(s)]
        return [s[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]

    def merge(parts):
        out, cur = [], ""
        for p in parts:
            if len(p) > size:
                out, cur = [*out, cur, *sliced(p)], ""
            elif len(cur + p) <= size:
                cur += p
            else:
                out.append(cur)
                tail = cur[-overlap:] if overlap and len(cur) > overlap else ""
                if len(tail + p) <= size:
                    cur = tail + p
                else:
                    out, cur = [*out, *sliced(p)], ""
        return [x.strip() for x in [*out, cur] if x.strip()]

    def cut(s, rest):
        if len(s.strip()) <= size:
            return [s]
        if not rest:
            return sliced(s)
        found = pieces(s, rest[0])
        if len(found) <= 1:
            return cut(s, rest[1:])
        return merge([x for p in found if p.strip() for x in cut(p, rest[1:])])

    return cut(text, rules) if text and text.strip() else []


def test_user_rules_equal_the_plain_version(spark):
    random.seed(9)
    rules = [Separator(r"# ", keep="next"), Separator("\n\n"), Separator(r"[.!?]", literal=False)]
    words = ["alpha", "be", "gamma", "x" * 30, "end.", "no!", "\n\n", "\n# head", "\n"]
    texts = [None, "", "  ", "short"] + [" ".join(random.choice(words) for _ in range(random.randint(1, 80))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    for overlap in (0, 10):
        got = {r.id: r.c for r in df.select("id", cut_by_rules("body", rules, 60, overlap).alias("c")).collect()}
        same = lambda xs: [x.strip() for x in xs]
        assert all(same(got[i]) == same(plain_cut(t, rules, 60, overlap)) for i, t in enumerate(texts))
    assert df.select(F.sum(F.size(cut_by_rules("body", [], 60, 10)))).first()[0] > 60


def test_pieces_of_sections_are_worked_out_once(spark):
    rows = spark.createDataFrame([(1, 0, "", "a line of words\n" * 60 + "\n- one\n- two\n"), (2, 0, "", "short")], "id long, section int, path string, content string")
    tree = sections.section_tree(rows, "id", 20, 400)
    assert "Window" not in tree._jdf.queryExecution().optimizedPlan().toString()
    assert {r.role for r in tree.collect()} == {"section", "child", "parent"}
