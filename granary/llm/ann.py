"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample by k-means that charges full clusters more, so that lists come out of like
length: about the square root of the number of vectors, as is their number. Every vector goes to its nearest list and, if
it lies near a boundary, to some more: lists whose centroid is not much further and does not lie close by one already
taken. A graph over the centroids, held in memory, is searched from fixed entry points to find the lists of a vector or
a query; a query then reads the lists whose distance is within a ratio of the nearest one's. What the lists hold is
scored exactly, on the original vectors.

Lists are read in rounds, nearest first, each round twice as many as all before. Only what is not below the kth score
found so far leaves a list, so that a query gathers a few times k rows however much the index holds.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M the greatest norm, 0 for queries.

Every vector is indexed; only the centroids come from the sample (at most SAMPLE distinct vectors and SAMPLE_BYTES, by
hash; there are at most a quarter as many lists). Vectors that are null, zero, or hold null or non-finite components take
no part; neither do rows without an id. Equal vectors are indexed once with their smallest ids (see `vectors`). Vectors of
different lengths are never compared: each length has its own index. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import stored, table
from granary.llm.exact_topk import is_query, ranked
from granary.llm.vectors import BLOCK, distinct_vectors, matrix, packed, usable

K = 20
EVERY = 20
SAMPLE, SAMPLE_BYTES = 32_768, 64 << 20
REPLICAS, BOUNDARY = 4, 0.12
SAME_SIDE = 0.35
#: How much further than the nearest list a query reads: RATIO, and more where lists are few and so lie far apart.
RATIO, RATIO_OF_FEW = 0.12, 2.0
#: Lists kept in sight while walking the graph; a query's grow until the ratio leaves some of them out.
BEAM_ASSIGN, BEAM_SEARCH = 32, 128
DEGREE = 24
#: The first round reads so many lists of each query, each further one GROWTH times as many as all before.
FIRST, GROWTH = 4, 2
PART_VECTORS, PART_QUERIES = 2048, 512
BATCH = 512
#: By what scores of one matrix product may differ from sums in a fixed order, as a part of the norms' product.
ROUNDING = 1e-12


@dataclass(frozen=True)
class Index:
    """Centroids of one vector length (with the added component), and their neighbours in the search graph."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    norm: float

    @property
    def reach(self) -> float:
        """The distance up to which lists are read, in distances of the nearest."""
        return 1 + RATIO + RATIO_OF_FEW / len(self.centroids)

    def points(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0.0))
        return np.concatenate([vectors, rest[:, None]], axis=1)

    @staticmethod
    def questions(vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1)

    def nearest(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists and distances, nearest first, that a best-first walk over the graph finds for each point."""
        found = [self._walk(points[i : i + BATCH], min(beam, len(self.centroids))) for i in range(0, len(points), BATCH)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _walk(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, c = len(points), self.centroids
        norms = (c**2).sum(axis=1)
        rows = np.arange(n)[:, None]
        at = np.broadcast_to(self.entries[:beam], (n, min(beam, len(self.entries)))).copy()
        far = norms[at] - 2 * np.einsum("nd,nkd->nk", points, c[at])
        seen = np.zeros((n, len(c) + 1), bool)
        seen[rows, at] = True
        seen[:, -1] = True
        done = np.zeros_like(at, bool)
        while True:
            waiting = np.where(done, np.inf, far)
            best = waiting.argmin(axis=1)
            open_ = np.isfinite(waiting[rows[:, 0], best])
            if not open_.any():
                break
            done[rows[:, 0], best] = True
            next_ = np.where(open_[:, None], self.graph[at[rows[:, 0], best]], len(c))
            new = ~seen[rows, next_]
            seen[rows, next_] = True
            seen[:, -1] = True
            safe = np.where(new, next_, 0)
            distance = np.where(new, norms[safe] - 2 * np.einsum("nd,nkd->nk", points, c[safe]), np.inf)
            at, far, done = np.concatenate([at, safe], axis=1), np.concatenate([far, distance], axis=1), np.concatenate([done, ~new], axis=1)
            if at.shape[1] > beam:
                keep = np.argpartition(far, beam - 1, axis=1)[:, :beam]
                at, far, done = at[rows, keep], far[rows, keep], done[rows, keep]
        order = np.argsort(far, axis=1)
        squared = far[rows, order] + (points**2).sum(axis=1, keepdims=True)
        return np.where(np.isfinite(squared), at[rows, order], -1), np.sqrt(np.maximum(squared, 0.0))


def _balanced_means(points: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Centroids by k-means in which a point's way to a cluster gets longer as the cluster holds more than its share."""
    rng = np.random.default_rng(11)
    centroids = points[rng.choice(len(points), lists, replace=False)].copy()
    share, fine = len(points) / lists, np.zeros(lists)
    for _ in range(rounds):
        home = np.concatenate([((centroids**2).sum(axis=1) - 2 * p @ centroids.T + fine).argmin(axis=1) for p in np.array_split(points, max(1, len(points) // 2048))])
        counts = np.bincount(home, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, points)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], points[rng.integers(len(points), size=lists)])
        spread = ((points - centroids[home]) ** 2).sum(axis=1).mean()
        fine = np.clip(fine + 0.05 * spread * (counts / share - 1), -spread, spread)
    return centroids


def build_index(sample: np.ndarray, norm: float, total: int) -> Index:
    """Centroids for `total` vectors from a sample of them, with a graph of near neighbours and a few random far ones."""
    lists = max(1, min(math.isqrt(total), len(sample) // 4))
    rest = np.sqrt(np.maximum(norm**2 - (sample**2).sum(axis=1), 0.0))
    centroids = _balanced_means(np.concatenate([sample, rest[:, None]], axis=1), lists)
    rng = np.random.default_rng(5)
    near = min(DEGREE, lists - 1)
    rows = []
    for block in np.array_split(np.arange(lists), max(1, lists // 512)):
        far = (centroids**2).sum(axis=1) - 2 * centroids[block] @ centroids.T
        far[np.arange(len(block)), block] = np.inf
        rows.append(np.argsort(far, axis=1)[:, :near])
    links = np.sort(np.concatenate([np.concatenate(rows), rng.integers(lists, size=(lists, 8))], axis=1), axis=1)
    # A neighbour drawn twice counts once: `lists` stands for none.
    links[:, 1:][links[:, 1:] == links[:, :-1]] = lists
    return Index(centroids, links, rng.choice(lists, min(lists, 16), replace=False), norm)


def _homes(index: Index, vectors: np.ndarray) -> list[list[int]]:
    """The lists of each vector: the nearest, and boundary ones that lie another way from it (see SAME_SIDE)."""
    lists, far = index.nearest(index.points(vectors), BEAM_ASSIGN)
    out = []
    for row, distance in zip(lists, far, strict=True):
        chosen = [int(row[0])]
        for c, d in zip(row[1:], distance[1:], strict=True):
            if c < 0 or d > (1 + BOUNDARY) * distance[0] or len(chosen) == REPLICAS:
                break
            if ((index.centroids[chosen] - index.centroids[c]) ** 2).sum(axis=1).min() > (SAME_SIDE * d) ** 2:
                chosen.append(int(c))
        out.append(chosen)
    return out


def _within(index: Index, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists and distances of points of which the last are beyond the ratio, unless there are no more."""
    beam = BEAM_SEARCH
    lists, far = index.nearest(points, beam)
    while beam < len(index.centroids) and (short := np.isfinite(far[:, -1]) & (far[:, -1] <= index.reach * far[:, 0])).any():
        beam *= 2
        more, further = index.nearest(points[short], beam)
        wider = ((0, 0), (0, more.shape[1] - lists.shape[1]))
        lists, far = np.pad(lists, wider, constant_values=-1), np.pad(far, wider, constant_values=np.inf)
        lists[short], far[short] = more, further
    return lists, far


def _choose(index: Index, sizes: np.ndarray, vectors: np.ndarray, k: int) -> list[np.ndarray]:
    """The lists that each query reads, nearest first: within the ratio, and on until they must hold k candidates."""
    lists, far = _within(index, index.questions(vectors))
    out = []
    for row, distance in zip(lists, far, strict=True):
        row, distance = row[row >= 0], distance[row >= 0]
        held = np.cumsum(sizes[row]) - sizes[row]
        some = (distance <= index.reach * distance[0]) | (held < (k + 1) * REPLICAS)
        if held[-1] + sizes[row[-1]] < (k + 1) * REPLICAS:
            row, some = np.flatnonzero(sizes > 0), np.ones((sizes > 0).sum(), bool)
        out.append(row[some])
    return out


def _sample(vectors: DataFrame, width: int) -> np.ndarray:
    """The vectors whose keys come first, no more than the bounds allow."""

    def as_bytes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"v": [np.asarray(x, np.float64).tobytes() for x in frame["vector"]]})

    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    first = vectors.select("vector", "key").orderBy("key").limit(most).mapInPandas(as_bytes, "v binary")
    return np.frombuffer(b"".join(r.v for r in first.collect()), np.float64).reshape(-1, width)


def _spread(df: DataFrame) -> DataFrame:
    """Dealt over as many tasks as a shuffle has, however few bytes there are: the work is in the graph."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")


def _in_parts(rows: DataFrame, size: int) -> DataFrame:
    """rows with part, so that about `size` rows share a list and a part. There is a count a list, and few lists."""
    counts = rows.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    return rows.join(F.broadcast(counts), "list").withColumn("part", F.pmod("key", "parts").cast("int")).drop("parts")


def _of_width(vectors: DataFrame, queries: DataFrame, width: int, k: int) -> DataFrame:
    """width, key, vec_id, score of the k nearest found of each query vector of one length."""
    spark = vectors.sparkSession
    mine = vectors.filter(F.size("vector") == width)
    total, norm = mine.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()
    sent = spark.sparkContext.broadcast(build_index(_sample(mine, width), norm, total))  # as many lists as a quarter of the sample, at most

    def assigned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(list=_homes(sent.value, np.array(frame["vector"].tolist(), dtype=np.float64)))

    homes = stored(_spread(mine).mapInPandas(assigned, "vector array<double>, ids array<long>, key long, list array<int>"), "ann-homes")
    sizes = np.zeros(len(sent.value.centroids), np.int64)
    for r in homes.select(F.explode("list").alias("list")).groupBy("list").count().collect():  # one row a list
        sizes[r["list"]] = r["count"]

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(list=_choose(sent.value, sizes, np.array(frame["vector"].tolist(), dtype=np.float64), k))

    asked = _spread(queries.filter(F.size("vector") == width)).mapInPandas(routed, "vector array<double>, ids array<long>, key long, list array<int>")
    asked = stored(asked.select("key", "vector", F.col("list").alias("lists")), "ann-asked")
    # A list is cut into parts of bounded size; each part of its vectors meets each part of its queries.
    cut = _in_parts(homes.withColumn("list", F.explode("list")), PART_VECTORS)
    blocks = cut.withColumn("block", F.col("list")).groupBy("list", "part").applyInPandas(lambda f: packed(f, "key"), BLOCK)
    blocks = stored(blocks, "ann-blocks")

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield _nearest_of(row, k, norm)

    best: DataFrame | None = None
    at, step, most = 0, FIRST, asked.agg(F.max(F.size("lists"))).first()[0]
    while at < most:
        now = asked.filter(F.size("lists") > at).select("key", "vector", F.explode(F.slice("lists", at + 1, step)).alias("list"))
        least = F.lit(float("-inf"))
        if best is not None:
            known = best.groupBy("key").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
            now, least = now.join(known, "key", "left"), F.coalesce("kth", least)
        now = _in_parts(now.withColumn("least", least), PART_QUERIES)
        questions = now.withColumn("block", F.col("list")).groupBy("list", "part").applyInPandas(_questions, "block int, q_keys binary, q_vectors binary, q_least binary")
        found = blocks.join(questions, "block").mapInPandas(scored, "key long, vec_id long, score double")
        if best is not None:
            found = found.unionByName(best)
        # A vector may be found in several lists.
        once = found.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
        nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
        best = stored(once.withColumn("_n", nth).filter(F.col("_n") <= k).drop("_n"), "ann-best")
        at, step = at + step, (at + step) * GROWTH
    return best.withColumn("width", F.lit(width))


def _questions(frame: pd.DataFrame) -> pd.DataFrame:
    """One row that holds the queries of a part: their keys, vectors and the scores that they have no use below."""
    vectors = np.array(frame["vector"].tolist(), dtype=np.float64)
    arrays = {"q_keys": frame["key"].to_numpy(np.int64), "q_vectors": vectors, "q_least": frame["least"].to_numpy(np.float64)}
    return pd.DataFrame({"block": [frame["block"].iloc[0]], **{name: [x.tobytes()] for name, x in arrays.items()}})


def _nearest_of(row, k: int, norm: float) -> pd.DataFrame:
    """The k best of one part of a list for each query that reads it, as far as they reach what the query has."""
    keys, q, c = np.frombuffer(row.q_keys, np.int64), matrix(row.q_vectors, row.width), matrix(row.vectors, row.width)
    least = np.frombuffer(row.q_least, np.float64)
    near = q @ c.T
    few = min(k, near.shape[1])
    kth = -np.partition(-near, few - 1, axis=1)[:, few - 1]
    slack = ROUNDING * row.width * np.linalg.norm(q, axis=1) * norm
    q_row, c_row = np.nonzero(near >= (np.maximum(kth, least) - slack)[:, None])
    # Summed in one order, so that a vector scores the same wherever it is found.
    scores = (q[q_row] * c[c_row]).sum(axis=1)
    some = scores >= least[q_row]
    q_row, c_row, scores = q_row[some], c_row[some], scores[some]
    ids = [row.ids[x] for x in c_row]
    times = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([np.asarray(x, np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
    return pd.DataFrame({"key": np.repeat(keys[q_row], times), "vec_id": flat, "score": np.repeat(scores, times)})


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for each row whose id is divisible by `every`."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & usable()).select("vec_id", vector.alias("vector")).filter(F.exists("vector", lambda x: x != 0))
    vectors = stored(distinct_vectors(rows, k + 1), "ann-vectors")
    asked = rows.filter(is_query(every))
    queries = stored(distinct_vectors(asked, 1), "ann-queries")
    widths = [r[0] for r in queries.select(F.size("vector")).distinct().collect()]
    found = None
    for width in widths:
        one = _of_width(vectors, queries, width, k + 1)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return ranked(asked, found, k)


def op6_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
