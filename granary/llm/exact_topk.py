"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block. A first pass counts each query's scores in the bins of a
coarse histogram; the sums over all blocks tell in which bin the kth score lies; each further pass splits that bin,
until it is one value wide. A last pass keeps the scores not below the kth and breaks ties by the smaller id. Scores
themselves never leave a block before that: only bin counts do, and of those only the bins at or above the block's own
kth score, for the kth of all can't be lower.

Scores are inner products of whole numbers, exact below 2 ** 53; vectors that could reach that raise an error. Blocks hold a bounded number
of vectors, in the least bytes that hold their numbers; a block of queries meets each block of candidates once a pass, dealt out by shares
of both, so that no key gathers all candidates. Both sides are merged: copies of blocks are never sent through the driver.

Queries and candidates follow the rules in `vectors`; an empty table gives no rows, and a query with fewer candidates
than k gets all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import stored, table
from granary.llm.vectors import BLOCK, distinct_vectors, packed, usable

K = 20
EVERY = 20
SCALE = 64.0
BINS = 128
#: Large blocks of queries, scored a slice at once; a task takes up to MOST_SHARE blocks of queries and of candidates at once, of
#: candidates more than one only beyond LEAST_GROUPS blocks.
QUERY_BLOCK, QUERY_SLICE, CANDIDATE_BLOCK = 8192, 1024, 4096
MOST_SHARE, LEAST_GROUPS = 16, 512
#: Tasks of a pass: two for each key that pairs are dealt out by, up to this many.
MOST_TASKS = 2000
#: How a block's numbers are kept, by their bytes.
KINDS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id and vector, each component x of the embedding turned into floor(64 x), kept as a double."""
    vector = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("double"))
    return rows.filter(F.col("vec_id").isNotNull() & usable()).select("vec_id", vector.alias("vector"))


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """Whole numbers as the smallest kind that holds them all."""
    least, most = vectors.min(), vectors.max()
    return vectors.astype(next((k for k in (np.int8, np.int16, np.int32) if np.iinfo(k).min <= least and most <= np.iinfo(k).max), np.float64))


def _matrix(data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, KINDS[len(data) // (rows * width)]).reshape(rows, width).astype(np.float64)


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    out = packed(frame, "key")
    vectors = np.frombuffer(out["vectors"].iloc[0], np.float64)
    return out.assign(vectors=[_narrow(vectors).tobytes()])


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """The distinct vectors in blocks of about `size`, a row each, numbered from 0 within each vector length."""
    counts = vectors.groupBy(F.size("vector").alias("width")).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    numbered = vectors.withColumn("width", F.size("vector")).join(F.broadcast(counts), "width").withColumn("block", F.pmod("key", "blocks").cast("int"))
    return numbered.groupBy("width", "block").applyInPandas(_block, BLOCK)


def _grid(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """By vector length how many blocks of queries and of candidates one task takes, and how many such shares there are."""
    blocks = lambda df, name: df.groupBy("width").agg((F.max("block") + 1).alias(name))
    sizes = blocks(queries, "q_n").join(blocks(candidates, "c_n"), "width")
    share = lambda n, fine, most: F.least(F.greatest(F.floor(F.col(n) / fine), F.lit(1)), F.lit(most)).cast("int")
    sizes = sizes.withColumn("q_share", share("q_n", MOST_SHARE, MOST_SHARE)).withColumn("c_share", share("c_n", LEAST_GROUPS, MOST_SHARE))
    parts = lambda n, size: F.sequence(F.lit(0), F.floor((F.col(n) - 1) / F.col(size)).cast("int"))
    return sizes.select("width", "q_share", "c_share", parts("q_n", "q_share").alias("q_parts"), parts("c_n", "c_share").alias("c_parts"))


def _pairs(queries: DataFrame, candidates: DataFrame, state: DataFrame | None) -> DataFrame:
    """Each block of queries with each block of candidates; state: low, width of the bin and count above, by query.

    Pairs are dealt out by a share of the query blocks and a share of the candidate blocks: no key has more than MOST_SHARE of
    either, and both sides are copied about equally little. Spark takes the copies for no larger than the blocks, and would else
    send all copies of the queries to every task."""
    q = queries.select("block", "width", F.col("keys").alias("q_keys"), F.col("vectors").alias("q_vectors"))
    if state is not None:
        q = q.hint("merge").join(state, ["width", "block"])
    else:
        q = q.withColumn("states", F.lit(None).cast("binary"))
    grid = _grid(queries, candidates)
    place = lambda block, share: F.floor(F.col(block) / F.col(share)).cast("int")
    q = q.join(F.broadcast(grid), "width").withColumn("q_part", place("block", "q_share")).withColumn("c_part", F.explode("c_parts"))
    c = candidates.select("width", F.col("block").alias("c_block"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"))
    c = c.join(F.broadcast(grid), "width").withColumn("c_part", place("c_block", "c_share")).withColumn("q_part", F.explode("q_parts"))
    drop = ("q_share", "c_share", "q_parts", "c_parts")
    # As many tasks as the pairs need: by the blocks' bytes alone Spark would take fewer.
    keys = ["width", "q_part", "c_part"]
    tasks = min(2 * (grid.agg(F.sum(F.size("q_parts") * F.size("c_parts"))).first()[0] or 1), MOST_TASKS)
    return c.drop(*drop).repartition(tasks, *keys).hint("merge").join(q.drop(*drop).repartition(tasks, *keys), keys)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole-number inner products; in single precision where that is exact."""
    most = np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0) * q.shape[1]
    if most < 1 << 24:
        return q.astype(np.float32) @ c.astype(np.float32).T
    return q @ c.T


def _counts(row, k: int, bins: int, top: int) -> pd.DataFrame:
    """Counts by bin of one pair of blocks: key, bin, n. A vector counts as often as it has ids; bin numbers fall with the score."""
    keys = np.frombuffer(row.q_keys, np.int64)
    q, c = _matrix(row.q_vectors, len(keys), row.width), _matrix(row.c_vectors, len(row.c_ids), row.width)
    low, wide = _ranges(row.states, len(keys), top, bins)
    times = np.fromiter(map(len, row.c_ids), np.int64, len(c))
    return pd.concat([_counts_of(row, keys[i : i + QUERY_SLICE], q[i : i + QUERY_SLICE], c, times, low[i : i + QUERY_SLICE], wide[i : i + QUERY_SLICE], k, bins) for i in range(0, len(keys), QUERY_SLICE)])


def _counts_of(row, keys: np.ndarray, q: np.ndarray, c: np.ndarray, times: np.ndarray, low: np.ndarray, wide: np.ndarray, k: int, bins: int) -> pd.DataFrame:
    scores = _scores(q, c)
    high = low + wide * bins
    # The bins go down from high: bin 0 is the highest. What lies above the range was counted in the pass before.
    at = np.floor((high[:, None] - 1 - scores) / wide[:, None]).astype(np.int64)
    inside = (at >= 0) & (at < bins)
    flat = np.arange(len(keys))[:, None] * bins + at
    weights = np.broadcast_to(times, at.shape)[inside]
    counts = np.bincount(flat[inside], weights=weights, minlength=len(keys) * bins).reshape(len(keys), bins)
    before = np.cumsum(counts, axis=1) - counts
    rows, columns = np.nonzero((counts > 0) & (before < k))
    return pd.DataFrame({"width": row.width, "block": row.block, "key": keys[rows], "bin": columns, "n": counts[rows, columns].astype(np.int64)})


def _ranges(states: bytes | None, n: int, top: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The lowest score and the width of a bin, by query."""
    if states is None:
        wide = -(-(2 * top + 1) // bins)
        return np.full(n, float(top + 1 - wide * bins)), np.full(n, float(wide))
    low, wide = np.frombuffer(states, np.float64).reshape(-1, 2).T
    return low, wide


def _passes(top: int, bins: int) -> list[int]:
    """Bin widths of the passes, down to 1, when scores lie within -top .. top."""
    widths = [-(-(2 * top + 1) // bins)]
    while widths[-1] > 1:
        widths.append(-(-widths[-1] // bins))
    return widths


def select_topk(queries: DataFrame, candidates: DataFrame, k: int, bins: int = BINS) -> DataFrame:
    """For each distinct query vector: key, vec_id, score of its k best, from distinct vectors (vector, ids, key)."""
    q = stored(_blocks(queries, QUERY_BLOCK), "topk-queries")
    c = stored(_blocks(candidates, CANDIDATE_BLOCK), "topk-candidates")
    norms = candidates.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    others = queries.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    top = math.isqrt(math.ceil((norms or 0.0) * (others or 0.0))) + 1
    if top >= 1 << 53:
        raise ValueError("scores may pass 2 ** 53, where doubles are no longer exact")
    states = None
    widths = _passes(top, bins)
    ranges: DataFrame | None = None
    for number, wide in enumerate(widths):
        pairs = _pairs(q, c, states)

        def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    yield _counts(row, k, bins, top)

        counts = pairs.mapInPandas(counted, "width int, block int, key long, bin int, n long").groupBy("width", "block", "key", "bin").agg(F.sum("n").alias("n"))
        if ranges is None:
            known = counts.withColumn("low", F.lit(float(top + 1 - wide * bins))).withColumn("above", F.lit(0).cast("long"))
        else:
            known = counts.hint("merge").join(ranges, ["width", "block", "key"])
        running = F.sum("n").over(Window.partitionBy("width", "block", "key").orderBy("bin")) + F.col("above")
        # The bin in which the kth score lies; the last one that has scores, where there are fewer than k.
        reached = known.withColumn("upto", running).withColumn("before", running - F.col("n"))
        found = reached.filter(F.col("before") < k).groupBy("width", "block", "key").agg(F.max(F.struct("bin", "before", "low")).alias("s"))
        low = F.col("s.low") + (bins - 1 - F.col("s.bin")) * wide
        ranges = stored(found.select("width", "block", "key", low.alias("low"), F.col("s.before").alias("above")), f"topk-range-{number}")
        finer = widths[min(number + 1, len(widths) - 1)]
        # Low stays; the next pass's bins cover at least the bin found, from its top downwards.
        ranges = ranges.withColumn("low", F.col("low") + wide - finer * bins) if number + 1 < len(widths) else ranges
        states = _states(q, ranges, finer)
    assert states is not None

    def kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield _kept(row, k)

    near = _pairs(q, c, states).mapInPandas(kept, "key long, q_row int, width int, block int, vec_id long, score long")
    first = F.row_number().over(Window.partitionBy("width", "block", "key").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("_n", first).filter(F.col("_n") <= k).select("width", "key", "vec_id", "score")


def _states(queries: DataFrame, ranges: DataFrame, wide: int) -> DataFrame:
    """By block of queries: the range of each, in the order of the block's keys."""

    def ordered(queries: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(queries["keys"].iloc[0], np.int64)
        low = ranges.set_index("key")["low"].reindex(keys).fillna(np.inf).to_numpy(np.float64)
        states = np.stack([low, np.full(len(keys), float(wide))], axis=1)
        return pd.DataFrame({"width": [queries["width"].iloc[0]], "block": [queries["block"].iloc[0]], "states": [states.tobytes()]})

    heads = queries.select("width", "block", "keys").groupBy("width", "block")
    return stored(heads.cogroup(ranges.groupBy("width", "block")).applyInPandas(ordered, "width int, block int, states binary"), "topk-states")


def _kept(row, k: int) -> pd.DataFrame:
    """The scores of one pair of blocks that are not below the query's kth, at most k a query."""
    keys = np.frombuffer(row.q_keys, np.int64)
    least, _ = np.frombuffer(row.states, np.float64).reshape(-1, 2).T
    q, c = _matrix(row.q_vectors, len(keys), row.width), _matrix(row.c_vectors, len(row.c_ids), row.width)
    found = []
    for i in range(0, len(keys), QUERY_SLICE):
        scores = _scores(q[i : i + QUERY_SLICE], c)
        at = np.nonzero(scores >= least[i : i + QUERY_SLICE, None])
        found.append((at[0] + i, at[1], scores[at]))
    q_row, c_row, scores = map(np.concatenate, zip(*found, strict=True))
    ids = [row.c_ids[c] for c in c_row]
    times = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([np.asarray(x, np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
    q_row, score = np.repeat(q_row, times), np.repeat(scores, times).astype(np.int64)
    order = np.lexsort((flat, -score, q_row))
    q_row, score, flat = q_row[order], score[order], flat[order]
    place = np.arange(len(q_row)) - np.searchsorted(q_row, q_row)
    some = place < k
    return pd.DataFrame({"key": keys[q_row[some]], "q_row": q_row[some], "width": row.width, "block": row.block, "vec_id": flat[some], "score": score[some]})


def ranked(query_rows: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: what was found for each query's vector, without the query's own row."""
    own = query_rows.select(F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("key"), F.size("vector").alias("width")).distinct()
    lists = found.groupBy("width", "key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))).alias("near"))
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.join(lists, ["width", "key"]).select("query_id", F.posexplode(near).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def is_query(every: int = EVERY) -> Column:
    return F.pmod(F.col("vec_id"), F.lit(every)) == 0


def exact_topk(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long) of the k best candidates of each query."""
    rows = quantised(embeddings)
    queries = rows.filter(is_query(every))
    candidates = stored(distinct_vectors(rows, k + 1), "topk-distinct")
    of_queries = stored(distinct_vectors(queries, 1), "topk-asked")
    return ranked(queries, select_topk(of_queries, candidates, k + 1), k)


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
