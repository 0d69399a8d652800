"""Compressing vectors to product codes: each part of a vector becomes the number of its nearest codebook entry.

Parts that are equal count once, with a weight. They are dealt out in lexicographic order, so that every task holds whole
stretches of the trie that they form. The trie is walked depth first: a node keeps, for every entry, the squared distance
gathered along its prefix of dimensions, and its children add their own dimension to that; so a prefix that many parts
share is paid for once. Below a node with a single part the rest of its path is added at once. Leaves take the nearest
entry (ties to the lower index), and their weighted sums make the next codebook. The codes themselves come from the same
walk, over rows instead of different parts.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors of different lengths have codebooks of
their own; a length that 8 doesn't divide is cut at floor(i * length / 8), and empty vectors have empty parts (code 0,
error 0). Fewer different ids than entries give fewer entries. Rows that repeat an id are coded each; for the first codebook
an id counts once, with its least vector, and a null id comes last. Equal entries: the lower index takes all. Components so
large that a distance could pass 63 bits raise an error. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import discard, stored, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Sums of errors by label are sent to all tasks up to so many labels; more are joined by a shuffle.
MOST_SENT = 100_000

Codebooks = dict[int, list[np.ndarray]]


def bounds(width: int) -> list[int]:
    return [i * width // PARTS for i in range(PARTS + 1)]


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of each part; parts differ and are in lexicographic order."""
    n, depth_of_leaves = parts.shape
    index, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def leaves(rows: np.ndarray, gathered: np.ndarray) -> None:
        index[rows] = gathered.argmin(1)
        distance[rows] = gathered.min(1)

    stack = [(0, n, 0, np.zeros(len(entries), np.int64))] if n and depth_of_leaves else []
    while stack:
        begin, end, depth, gathered = stack.pop()
        values = parts[begin:end, depth]
        heads = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        below = gathered + (values[heads, None] - entries[:, depth]) ** 2
        sizes = np.diff(np.append(heads, end - begin))
        alone = sizes == 1
        rows = begin + heads[alone]
        rest = below[alone]
        for d in range(depth + 1, depth_of_leaves):
            rest += (parts[rows, d, None] - entries[:, d]) ** 2
        leaves(rows, rest)
        stack.extend((begin + h, begin + h + s, depth + 1, g) for h, s, g in zip(heads[~alone].tolist(), sizes[~alone].tolist(), below[~alone], strict=True))
    return index, distance


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """width, pos, rows and their parts (a matrix) of a batch with columns width, pos and part."""
    width, pos = batch.column("width").to_numpy(), batch.column("pos").to_numpy()
    lists = batch.column("part")
    begins, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    for w, p in np.unique(np.stack([width, pos], 1), axis=0).tolist():
        rows = np.flatnonzero((width == w) & (pos == p))
        d = bounds(w)[p + 1] - bounds(w)[p]
        yield w, p, rows, values[begins[rows][:, None] + np.arange(d)]


def _distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows in lexicographic order, and which one each row is."""
    if not parts.shape[1]:
        return parts[:1], np.zeros(len(parts), np.int64)
    order = np.lexsort(parts.T[::-1])
    new = np.append(True, (parts[order][1:] != parts[order][:-1]).any(1))
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(new) - 1
    return parts[order][new], place


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """row, vec_id, label, width, v (whole components) of the rows that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept = rows.filter(F.coalesce(finite, F.lit(False))).select("vec_id", "label", x.alias("v"))
    scaled = F.transform("v", lambda c: c.cast("double") * SCALE)
    # Far beyond what is coded; so that larger ones reach the check and don't fail here.
    whole = F.transform(scaled, lambda c: F.floor(F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), c))).cast("long"))
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("v").cast("long").alias("width"), whole.alias("v"))


def _parts(rows: DataFrame, *others: str) -> DataFrame:
    """A row for each part: width, pos, part and other columns."""
    cut = lambda i: F.floor(i * F.col("width") / PARTS).cast("int")
    parts = F.array(*(F.slice("v", cut(F.lit(i)) + 1, cut(F.lit(i + 1)) - cut(F.lit(i))) for i in range(PARTS)))
    return rows.select("width", *others, F.posexplode(parts).alias("pos", "part")).withColumn("pos", F.col("pos").cast("long"))


def first_codebooks(rows: DataFrame) -> Codebooks:
    """The parts of the vectors with the smallest ids, by width."""
    ids = rows.select("width", "vec_id").distinct()
    first = ids.withColumn("n", F.row_number().over(Window.partitionBy("width").orderBy(F.col("vec_id").asc_nulls_last()))).filter(F.col("n") <= ENTRIES)
    same = F.col("r.width").eqNullSafe(F.col("i.width")) & F.col("r.vec_id").eqNullSafe(F.col("i.vec_id"))
    chosen = rows.alias("r").join(F.broadcast(first.alias("i")), same).groupBy("r.width", "n").agg(F.min("v").alias("v")).orderBy("width", "n")
    found: dict[int, list[list[int]]] = {}
    for r in chosen.collect():  # at most ENTRIES rows a length
        found.setdefault(r["width"], []).append(r["v"])
    return {w: [np.array(v, np.int64).reshape(len(v), w)[:, b:e] for b, e in zip(bounds(w), bounds(w)[1:], strict=False)] for w, v in found.items()}


def _next(parts: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = batch.column("n").to_numpy()
            for w, p, rows, values in _runs(batch):
                distinct, place = _distinct(values)
                index = nearest_entries(distinct, books[w][p])[0][place]
                used = np.unique(index)
                for e in used.tolist():
                    mine = rows[index == e]
                    sums = (values[index == e] * weights[mine, None]).sum(0).tolist()
                    sums.append(int(weights[mine].sum()))
                    m = len(sums)
                    yield pa.RecordBatch.from_pydict({"width": [w] * m, "pos": [p] * m, "entry": [e] * m, "at": list(range(m)), "total": sums})

    totals = parts.mapInArrow(summed, "width long, pos long, entry long, at long, total long").groupBy("width", "pos", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums: dict[tuple[int, int, int], dict[int, int]] = {}
    for r in totals.collect():  # one number a component of the codebooks
        sums.setdefault((r["width"], r["pos"], r["entry"]), {})[r["at"]] = int(r["total"])
    out = {w: [entries.copy() for entries in book] for w, book in books.items()}
    for (w, p, e), by in sums.items():
        *components, count = (by[i] for i in range(len(by)))
        out[w][p][e] = [c // count for c in components]
    return out


def _digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for entries in book for x in entries.ravel().tolist()).encode()).hexdigest()


def fitted_codebooks(rows: DataFrame) -> Codebooks:
    """The codebooks of `whole_vectors` rows after all rounds."""
    books = first_codebooks(rows)
    parts = _parts(rows).groupBy("width", "pos", "part").agg(F.count("*").alias("n"))
    parts = stored(parts.repartitionByRange("width", "pos", "part").sortWithinPartitions("width", "pos", "part"), "parts")
    for _ in range(ROUNDS):
        books = _next(parts, books)
    discard(parts)
    return books


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, width, code, error of `whole_vectors` rows."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, distance = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for w, p, mine, values in _runs(batch):
                distinct, place = _distinct(values)
                found = nearest_entries(distinct, books[w][p])
                index[mine], distance[mine] = found[0][place], found[1][place]
            names = ["row", "vec_id", "label", "width", "pos"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(index), pa.array(distance)], [*names, "entry", "distance"])

    dealt = _parts(rows, "row", "vec_id", "label").repartitionByRange("width", "pos", "part", "row").sortWithinPartitions("width", "pos", "part")
    walk = dealt.mapInArrow(walked, f"row long, vec_id {kinds['vec_id']}, label {kinds['label']}, width long, pos long, entry long, distance long")
    digits = F.array_sort(F.collect_list(F.struct("pos", F.lpad(F.lower(F.hex("entry")), 2, "0").alias("digit"))))
    whole = walk.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.first("width").alias("width"), digits.alias("digits"), F.sum("distance").alias("error"))
    return whole.select("vec_id", "label", "width", F.array_join(F.transform("digits", lambda x: x["digit"]), "").alias("code"), "error")


def compressed(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that takes part."""
    rows = stored(whole_vectors(vectors, vector), "vectors")
    widest, largest = rows.agg(F.max("width"), F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()
    if largest and 4 * largest * largest * max(widest, 1) >= 1 << 63:
        raise ValueError("components so large that distances could pass 63 bits")
    books = fitted_codebooks(rows)
    codes = stored(coded(rows, books), "codes")
    discard(rows)
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    few = F.broadcast(sums) if sums.count() <= MOST_SENT else sums
    digests: Column = F.lit(None).cast("string")
    for w, book in books.items():
        digests = F.when(F.col("width") == w, _digest(book)).otherwise(digests)
    same = F.col("c.label").eqNullSafe(F.col("s.label"))
    return codes.alias("c").join(few.alias("s"), same).select("vec_id", "code", "error", "label_error", digests.alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Chained rounds over components in long form."""
    nearest = "SELECT pos, row, min({{'d': d, 'e': e}}) AS b FROM (SELECT x.pos, x.row, c.e, sum((x.x - c.y) * (x.x - c.y)) AS d FROM x JOIN {book} c ON c.pos = x.pos AND c.j = x.j GROUP BY ALL) GROUP BY ALL"
    ctes = [
        f"v AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda t: floor({SCALE} * t::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda t: t IS NULL OR NOT isfinite(t))) = 0)",
        f"x AS MATERIALIZED (SELECT row, vec_id, (j * {PARTS}) // len(v) AS pos, j, v[j + 1] AS x FROM v, unnest(range(len(v))) AS t(j))",
        f"s AS (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < {ENTRIES})",
        "c0 AS MATERIALIZED (SELECT x.pos, s.e, x.j, x.x AS y FROM x JOIN s USING (row))",
    ]
    for i in range(ROUNDS):
        ctes.append(f"a{i} AS MATERIALIZED ({nearest.format(book=f'c{i}')})")
        ctes.append(f"m{i} AS (SELECT x.pos, a.b.e AS e, x.j, sum(x.x) AS t, count(*) AS n FROM x JOIN a{i} a ON a.pos = x.pos AND a.row = x.row GROUP BY ALL)")
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c.pos, c.e, c.j, CASE WHEN m.n IS NULL THEN c.y ELSE ((m.t - ((m.t % m.n) + m.n) % m.n) // m.n)::BIGINT END AS y FROM c{i} c LEFT JOIN m{i} m ON m.pos = c.pos AND m.e = c.e AND m.j = c.j)")
    ctes.append(f"f AS MATERIALIZED ({nearest.format(book=f'c{ROUNDS}')})")
    ctes.append("r AS (SELECT row, string_agg(printf('%02x', b.e), '' ORDER BY pos) AS code, sum(b.d)::BIGINT AS error FROM f GROUP BY row)")
    sha = f"(SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY pos, e, j)) FROM c{ROUNDS})"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, {sha} AS codebooks_sha256 FROM v JOIN r USING (row)"


OP11_SQL = _sql()
