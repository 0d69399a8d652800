import hashlib
import math
import random

import numpy as np
import pytest
from granary.llm.vector_codes import bounds, compressed, nearest_entries
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows):
    """The contract, part by part, in Python's whole numbers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for width in sorted({len(v) for _, v, _ in kept}):
        mine = [r for r in kept if len(r[1]) == width]
        firsts = {}
        for i, v, _ in sorted(mine, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            firsts.setdefault(i, v)
        cuts = bounds(width)
        books = [[v[b:e] for v in list(firsts.values())[:16]] for b, e in zip(cuts, cuts[1:])]

        def near(part, book):
            return min((sum((x - y) ** 2 for x, y in zip(part, entry)), e) for e, entry in enumerate(book))

        for _ in range(6):
            for p, (b, e) in enumerate(zip(cuts, cuts[1:])):
                found = [near(v[b:e], books[p])[1] for _, v, _ in mine]
                for k in set(found):
                    members = [v[b:e] for (_, v, _), f in zip(mine, found) if f == k]
                    books[p][k] = [sum(c) // len(members) for c in zip(*members)]
        digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
        for i, v, label in mine:
            found = [near(v[b:e], books[p]) for p, (b, e) in enumerate(zip(cuts, cuts[1:]))]
            out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label, digest))
    labels = {}
    for _, _, error, label, _ in out:
        labels[label] = labels.get(label, 0) + error
    return sorted(((i, c, e, labels[label], d) for i, c, e, label, d in out), key=repr)


def check(spark, rows):
    clashing = {c: F.lit(1) for c in ("row", "v", "pos", "part", "n", "width", "entry", "code", "error")}
    got = compressed(spark.createDataFrame(rows, SCHEMA).withColumns(clashing))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_codes_equal_a_plain_version(spark):
    """Random vectors, a third of them one vector, ties, shared prefixes, odd rows, repeated and null ids."""
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(1000 + i, [0.1] * 16, 3) for i in range(150)]
    rows += [(2000 + i, [rng.choice([-0.25, 0.0, 0.25]) for _ in range(16)], None) for i in range(150)]
    odd = [(3000, None, 1), (3001, [None] + [0.0] * 15, 1), (3002, [math.nan] * 16, 1), (3003, [math.inf] + [0.0] * 15, 1)]
    check(spark, [*rows, *odd, rows[3], (5, rows[4][1], 1), (None, rows[9][1], None), (None, [9.0] * 16, 2)])


def test_few_rows_other_lengths_and_none(spark):
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(w)], i % 2) for i, w in enumerate([8, 8, 8, 0, 0, 3, 11, 11, 11, 11] + [11] * 20)]
    check(spark, rows)
    check(spark, [(None, [0.5] * 8, None)])
    assert compressed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert compressed(spark.createDataFrame([(1, None, 2)], SCHEMA)).count() == 0


def test_the_walk_finds_what_a_full_search_finds():
    rng = np.random.default_rng(4)
    parts = np.unique(rng.integers(-4, 4, (3000, 5)), axis=0)
    entries = rng.integers(-4, 4, (16, 5))
    index, distance = nearest_entries(parts, entries)
    far = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (index == far.argmin(1)).all() and (distance == far.min(1)).all()


def test_too_large(spark):
    with pytest.raises(ValueError, match="63 bits"):
        compressed(spark.createDataFrame([(1, [1e300] * 8, 1)], SCHEMA))
