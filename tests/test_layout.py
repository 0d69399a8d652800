import random

import pytest
from granary.operators import layout
from granary.operators.layout import _Element, align


def test_tables_over_page_breaks(spark):
    h, other = ["Key", "Value"], ["a", "b", "c"]
    rows = [
        (1, 0, h, [["k1", "v1"]]),
        (1, 1, h, [["k2", "v2"]]),  # the header is repeated
        (1, 2, ["", "more v2"], [["k3", "v3"]]),  # a row cut by the page break
        (1, 3, ["k4", "v4"], []),  # a row read as a header
        (1, 4, other, [["x", "y", "z"]]),
        (2, 0, ["", ""], [["k", "v"]]),
        (2, 1, ["", " "], [["k", "w"]]),
    ]
    df = spark.createDataFrame(rows, "doc long, n int, header array<string>, rows array<array<string>>")
    out = {(r.doc, r.first): (r.n_parts, r.rows) for r in layout.joined_tables(df, "doc", "n").collect()}
    assert out[1, 0] == (4, [["k1", "v1"], ["k2", "v2 more v2"], ["k3", "v3"], ["k4", "v4"]])
    assert out[1, 4] == (1, [["x", "y", "z"]])
    assert out[2, 0] == (2, [["k", "v"], ["", " "], ["k", "w"]])


def elements(*texts):
    return [_Element(i, t, frozenset(t.split())) for i, t in enumerate(texts)]


def test_alignment():
    page = elements("title", "first line of it", "second one", "first line of it", "far away words stand here now")
    assert align(["first line", "second one"], "first line second one", page, 0) == ([1, 2], 3)
    assert align(["first line"], "first line", page, 3) == ([3], 4)
    assert align(["the first line of it too"], "", page, 2) == ([3], 4)
    # No line fits: the most alike element counts, if it is alike enough.
    assert align(["far x y z away"], "far x y z away", page, 0) == ([4], 5)
    assert align(["quite other"], "quite other", page, 1) == ([], 1)
    assert align([], "", [], 0) == ([], 0)


def plain_layout(pieces, size, overlap):
    """Chunks of (text, units) as lists of texts."""
    size = max(80, size)
    overlap = max(0, min(overlap, int(size * 0.3)))
    out, now = [], []
    for piece in pieces:
        if now and sum(n for _, n in now) + piece[1] > size:
            out.append([t for t, _ in now])
            tail = []
            for old in reversed(now) if overlap else ():
                if tail and sum(n for _, n in tail) + old[1] > overlap:
                    break
                tail.insert(0, old)
            now = tail
        now.append(piece)
    return [*out, *([[t for t, _ in now]] if now else [])]


@pytest.mark.parametrize(("size", "overlap"), [(80, 24), (80, 0), (10, 500), (120, 30), (200, 7)])
def test_layout_chunks_equal_a_plain_version(spark, size, overlap):
    rng = random.Random(size + overlap)
    docs = {d: [" ".join(f"w{rng.randrange(100)}" for _ in range(rng.choice([1, 5, 11, 25, 50, 70, 95]))) for _ in range(rng.randrange(1, 20))] for d in range(12)}
    docs[12] = ["a " * 50, "b " * 25, "c " * 70]
    rows = [(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts)] + [(13, 0, " "), (13, 1, None)]
    # The order column may have any name.
    for order in ("n", "p", "content_no"):
        frame = spark.createDataFrame(rows, f"doc int, {order} int, content string")
        got = {}
        for r in layout.layout_chunks(frame, "doc", order, size, overlap).collect():
            got.setdefault(r.doc, {})[r.position] = r.content
        want = {d: ["\n".join(c) for c in plain_layout([(t, len(t.split())) for t in texts], size, overlap)] for d, texts in docs.items()}
        assert {d: [c[i] for i in sorted(c)] for d, c in got.items()} == want
        if order == "n" and (size, overlap) == (80, 24):
            assert len(want[12][1].split()) == 25 + 70


def test_elements_of_a_layout(spark):
    box = [0.0, 1.0, 5.0, 2.0]
    rows = [
        (1, 0, "Text", " below ", 2, box),
        (1, 1, "image", "http://x/y.png", 1, [0.0, 5.0, 5.0, 6.0]),
        (1, 2, "title", "right", 1, [3.0, 1.0, 5.0, 2.0]),
        (1, 3, "title", "left", 1, box),
        (1, 4, "header", "no", 1, box),
        (1, 5, "text", "  ", 1, box),
        (1, 6, "text", "no page", None, box),
        (1, 7, "text", "flat", 1, [0.0, 1.0, 5.0, 1.0]),
        (1, 8, "text", "short box", 1, [0.0, 1.0, 5.0]),
        (1, 9, None, "no kind", 1, box),
        (1, 10, "text", "no box", 1, None),
        (1, 11, "text", "same place", 1, box),
    ]
    frame = spark.createDataFrame(rows, "doc int, idx int, type string, content string, page_no int, bbox array<double>")
    found = layout.layout_elements(frame, "doc")
    assert [r.content for r in found.orderBy("place").collect()] == ["left", "same place", "right", "![image](http://x/y.png)", "below"]
    assert [r.content for r in layout.layout_chunks(found, "doc", "place", 80).collect()] == ["left\nsame place\nright\n![image](http://x/y.png)\nbelow"]
