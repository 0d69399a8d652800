from collections import defaultdict

from granary.llm.line_dedup import Spread, dedup_lines
from pyspark.sql import functions as F


def plain(rows, sites=3, least=5):
    where = defaultdict(set)
    first = {}
    for i, text, source in sorted(rows, key=lambda r: r[0]):
        for p, line in enumerate((text or "").split("\n") if text is not None else []):
            if len(line.split()) >= least:
                where[line.strip()].add(source)
                first.setdefault(line.strip(), (i, p))
    out = {}
    for i, text, _ in rows:
        if text is None:
            out[i] = (0, 0, None)
            continue
        lines = text.split("\n")
        kept = [x for p, x in enumerate(lines) if len(x.split()) < least or len(where[x.strip()]) < sites or first[x.strip()] == (i, p)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def rows():
    footer = "all rights reserved by this site"
    out = [(i, f"own line number {i} of the text\n  {footer}\t\nshort one\n{footer}", f"s{i % 4}") for i in range(12)]
    out += [(20, "two sites have this line only", "a"), (21, "two sites have this line only", "b"), (22, None, "a"), (23, "", None)]
    out += [(30 + i, "a null source is a site\nshort one", [None, "x", "y"][i]) for i in range(3)]
    return out + [(50 + i, f"line number {k} is everywhere here " * 3, f"q{i}") for k in range(3) for i in range(3 * k, 3 * k + 3)]


def test_equals_the_plain_version(documents):
    out = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(documents(rows())).collect()}
    assert out == plain(rows())


def test_many_sites_and_estimates(documents):
    many = [(i, "the same long line on very many sites", f"site{i}") for i in range(3000)] + [(5000 + i, "this line is on just a few sites", f"site{i}") for i in range(90)]
    out = dedup_lines(documents(many), Spread(sites=100)).collect()
    assert sum(r.n_removed for r in out) == 2999


def test_empty_table_and_long_text(documents):
    assert dedup_lines(documents(["a"]).limit(0)).count() == 0
    long = "x y z w v " * 50_000
    assert dedup_lines(documents([long])).first().text == long


def test_repeated_rows_null_ids_and_clashing_columns(documents):
    text = "\n".join(f"this line stands on every site {i}" for i in range(3))
    rows = [(i, text, f"s{i}") for i in range(5)] + [(2, text, "s2"), (None, text, "s7"), (None, "own words only in this line", "s8")]
    clashing = documents(rows).withColumns({c: F.lit(1) for c in ("tie", "place", "line", "site", "cut", "stays", "raw")})
    out = sorted(((str(r.doc_id), r.n_removed, r.text) for r in dedup_lines(clashing).collect()))
    assert len(out) == len(rows)
    # Nulls come first: the row without an id keeps the lines.
    assert out[-2:] == [("None", 0, "own words only in this line"), ("None", 0, text)]
    assert all(r[1:] == (3, "") for r in out[:-2])
