import math

import numpy as np
import pytest
from granary.llm.ann import nearest
from granary.llm.exact_topk import exact_topk
from pyspark.sql import functions as F


def rows_of(seed, n, dimensions=16, copies=150):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dimensions))
    vectors = centres[rng.integers(8, size=n)] + 0.6 * rng.normal(size=(n, dimensions))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[:copies] = vectors[0]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]


ODD = [(10_000, None), (10_020, []), (10_040, [None] * 16), (10_060, [float("nan")] * 16), (10_080, [math.inf] * 16), (None, [1.0] * 16)]


@pytest.fixture(scope="module")
def data(spark):
    rows = rows_of(1, 900)
    frame = spark.createDataFrame([(i, v, 0) for i, v in [*rows, *ODD, rows[40]]], "vec_id long, embedding array<float>, rank int")
    return rows, frame


def plain(rows, measure, k=20, every=20):
    out = {}
    for q, x in rows:
        if q % every == 0:
            scores = sorted(((-measure(x, y), i) for i, y in rows if i != q))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def test_exact_topk(data):
    rows, frame = data
    whole = [(i, np.floor(64 * np.array(v))) for i, v in rows]
    want = plain(whole, lambda x, y: int(x @ y))
    got = {}
    for r in sorted(exact_topk(frame).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_recall_and_scores_of_the_index(data):
    rows, frame = data
    vectors = [(i, np.array(v)) for i, v in rows]
    want = plain(vectors, lambda x, y: float(x @ y))
    got = {}
    for r in sorted(nearest(frame).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    at = dict(vectors)
    for q, found in got.items():
        assert all(abs(float(at[q] @ at[i]) - s) < 1e-12 for i, s in found)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)


def test_few_candidates_zero_vectors_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 0.0]), (3, [0.5, 0.5]), (4, [-1.0, 2.0]), (40, [1.0, 2.0, 3.0])], schema)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in nearest(few).collect()) == [(0, 1, 3), (0, 2, 4)]
    exact = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk(few).collect())
    assert exact == [(0, 1, 3, 2048), (0, 2, 20, 0), (0, 3, 4, -4096), (20, 1, 0, 0), (20, 2, 3, 0), (20, 3, 4, 0)]
    assert nearest(few.limit(0)).count() == 0 and exact_topk(few.limit(0)).count() == 0


def test_ties_repeated_rows_and_several_lengths(spark):
    """Equal scores go to smaller ids, equal rows count once, and vectors of another length are another search."""
    rows = [(i, [1.0, float(i % 3)]) for i in range(60)] + [(100 + i, [0.5, 0.5, float(i % 2)]) for i in range(45)] + [(0, [1.0, 0.0]), (21, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("key", "ids", "list", "score", "rank", "width", "vector")})
    for search, scale in ((nearest, 1), (exact_topk, 64)):
        got = {}
        for r in sorted(search(frame).collect(), key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        for q, x in rows:
            if q % 20:
                continue
            others = sorted({(-scale * scale * float(np.dot(x, y)), i) for i, y in rows if i != q and len(y) == len(x)})
            assert got[q] == [(i, -s) for s, i in others][:20], (search, q)


def test_a_query_reads_more_lists_than_the_beam(monkeypatch):
    from granary.llm import ann

    monkeypatch.setattr(ann, "BEAM_SEARCH", 2)
    monkeypatch.setattr(ann, "RATIO", 10.0)
    rng = np.random.default_rng(3)
    points = rng.normal(size=(400, 8))
    index = ann.build_index(points, float(np.linalg.norm(points, axis=1).max()), 400)
    lists = ann._choose(index, np.full(len(index.centroids), 20), points[:5], 20)
    assert len(index.centroids) == 20 and all(sorted(x.tolist()) == list(range(20)) for x in lists)


def test_scores_that_doubles_cannot_hold(spark):
    frame = spark.createDataFrame([(i, [1e7, float(i)]) for i in range(30)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="2 \\*\\* 53"):
        exact_topk(frame)


def test_no_task_reads_more_than_its_share(spark, monkeypatch):
    """Five blocks of queries, forty of candidates, nothing broadcast: every pair of blocks meets once, in as many keys as there are shares."""
    from granary.llm import exact_topk as topk

    for name, value in (("QUERY_BLOCK", 12), ("CANDIDATE_BLOCK", 30), ("MOST_SHARE", 2), ("LEAST_GROUPS", 10)):
        monkeypatch.setattr(topk, name, value)
    rows = [(i, v) for i, v in rows_of(7, 1200, copies=0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk.quantised(frame)
    queries = topk._blocks(topk.distinct_vectors(vectors.filter(topk.is_query()), 1), topk.QUERY_BLOCK).persist()
    candidates = topk._blocks(topk.distinct_vectors(vectors, 21), topk.CANDIDATE_BLOCK).persist()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = topk._pairs(queries, candidates, None).select("q_part", "c_part", "block", "c_block").collect()
        got = {}
        for r in sorted(topk.exact_topk(frame).collect(), key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(pairs) == len({(r.block, r.c_block) for r in pairs}) == queries.count() * candidates.count()
    keys = {}
    for r in pairs:
        keys[r.q_part, r.c_part] = keys.get((r.q_part, r.c_part), 0) + 1
    assert queries.count() >= 5 and max(keys.values()) <= 4 and len(keys) >= len(pairs) / 4
    assert got == plain([(i, np.floor(64 * np.array(v))) for i, v in rows], lambda x, y: int(x @ y))


def test_copies_of_blocks_are_not_sent(spark, monkeypatch, tmp_path):
    """Copies of the queries' blocks are as many as there are shares of candidates, which Spark's size of exploded rows doesn't say."""
    from granary.llm import exact_topk as topk

    for name, value in (("QUERY_BLOCK", 12), ("CANDIDATE_BLOCK", 30), ("MOST_SHARE", 2), ("LEAST_GROUPS", 10)):
        monkeypatch.setattr(topk, name, value)
    vectors = topk.quantised(spark.createDataFrame(rows_of(8, 600, copies=0), "vec_id long, embedding array<double>"))
    sides = {"q": (vectors.filter(topk.is_query()), 1, topk.QUERY_BLOCK), "c": (vectors, 21, topk.CANDIDATE_BLOCK)}
    for name, (rows, kept, size) in sides.items():
        topk._blocks(topk.distinct_vectors(rows, kept), size).write.parquet(f"{tmp_path}/{name}")  # files have a size
    queries, candidates = (spark.read.parquet(f"{tmp_path}/{name}") for name in sides)
    plan = topk._pairs(queries, candidates, None)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [width#" in plan and "q_part" in plan
    sent = [line for line, below in zip(plan.splitlines(), plan.splitlines()[1:], strict=False) if "BroadcastExchange" in line and "Generate" in below]
    assert not sent
    least = candidates.selectExpr("sum(length(vectors))", "sum(size(ids))", "max(width)").first()
    assert least[0] == least[1] * least[2]  # a byte a number


@pytest.mark.parametrize("most", [100, 30_000, 2_000_000_000, 1 << 40])
def test_numbers_of_any_size_come_back(most):
    from granary.llm import exact_topk as topk

    vectors = np.array([[most, -most, 0.0], [1.0, 2.0, -3.0]])
    kept = topk._narrow(vectors)
    assert np.array_equal(topk._matrix(kept.tobytes(), 2, 3), vectors) and kept.dtype == topk.KINDS[kept.itemsize]
