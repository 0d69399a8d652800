"""Near-duplicate documents by SimHash fingerprints, found through an index of the bytes at each position.

A fingerprint has 8 bytes. Two that differ in at most 3 bits share the bytes of at least 5 positions. Each different
fingerprint is posted in an inverted index; candidates are pairs that share a list. A pair's shared positional bytes are
tallied, pairs with fewer than the guaranteed 5 go, and the others are verified bit by bit.

Lists of a single position and byte would each hold a 256th of all fingerprints. The index is therefore keyed by three
positions at once, all in the first or all in the second half: 5 shared positions leave 3 in one of the halves, so that no
pair is missed. A pair is taken only in the first list that it shares, so none comes twice.

No list is compared pair by pair where that is dear. Its members differ in v bits; what lies at one or two flipped bits
from a member are 1 + v + v(v-1)/2 points, at most 821. Members at 2 or fewer bits from a point all link with each member
at 1 bit or none, and any linked pair of the list has such a point between them: so one edge from each member around a point
to the least one beside it joins all that link. A list takes the way that makes fewer rows, which bounds the work for each
fingerprint, however large the list. Both ways are exact.

Shingles are hashed with repeats. Null texts and texts without words have the fingerprint 0 and link like any other; very
long texts are hashed a stretch at a time. Equal fingerprints count once. Rows that share a doc_id are separate documents
of equal name; a component is named by its smallest doc_id that is not null (null where it has none). An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import discard, stored, table
from granary.llm.components import connected_components

SHINGLE = 3
SEED = 42
MOST_BITS = 3
#: At most one byte a differing bit.
LEAST_BYTES = 8 - MOST_BITS
#: Shingles whose bits are counted at once.
STRETCH = 1 << 13
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


POSITIONS = [_signed(0xFF << 8 * p) for p in range(8)]
#: Three positions of either half.
KEYS = [_signed(sum(0xFF << 8 * p for p in three)) for half in (range(4), range(4, 8)) for three in combinations(half, 3)]


def fingerprint(text: bytes) -> int:
    """The SimHash of a text's shingles, unsigned; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins, ends = (ends - sizes)[: max(1, len(words) - SHINGLE + 1)], ends[min(SHINGLE, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(begins), STRETCH):
        spans = zip(begins[at : at + STRETCH].tolist(), ends[at : at + STRETCH].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(line[b:e], SEED) for b, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begins), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (64 bits, as a signed number) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            found = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(hashed, f"doc_id {kind}, fp long")


def _lists(fps: DataFrame) -> DataFrame:
    """Members of the index's lists that hold more than one: list, shared (its bytes), fp, varied (the bits in which members differ), by_pairs (the cheaper way)."""
    posted = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(k)) for k in KEYS))).alias("list", "shared"))
    varied = F.bit_or("fp").bitwiseXOR(F.bit_and("fp"))
    lists = posted.groupBy("list", "shared").agg(F.count("*").alias("size"), varied.alias("varied")).filter("size > 1")
    v = F.bit_count("varied")
    return posted.join(lists, ["list", "shared"]).withColumn("by_pairs", (F.col("size") - 1) / 2 <= 1 + v + v * (v - 1) / 2).drop("size")


def _pairs(lists: DataFrame) -> DataFrame:
    """Linked pairs (a, b) of the lists that are compared pair by pair."""
    few = lists.filter("by_pairs")
    left, right = (few.select("list", "shared", F.col("fp").alias(side)) for side in "ab")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(k)) == 0, i) for i, k in enumerate(KEYS)))
    tally: Column = reduce(Column.__add__, ((apart.bitwiseAND(F.lit(p)) == 0).cast("int") for p in POSITIONS))
    met = left.join(right, ["list", "shared"]).filter((F.col("a") < F.col("b")) & (first == F.col("list")))
    return met.filter(tally >= LEAST_BYTES).filter(F.bit_count(apart) <= MOST_BITS).select("a", "b")


def _around_points(lists: DataFrame) -> DataFrame:
    """Edges (a, b) that join all that link within the other lists: of each point, its members and the least beside it."""
    bits = F.expr("filter(transform(sequence(0, 63), i -> shiftleft(1L, i)), bit -> (varied & bit) <> 0)")
    many = lists.filter("not by_pairs").select("list", "fp", bits.alias("bits"))
    beside = F.expr("concat(array(fp), transform(bits, x -> fp ^ x))")
    further = F.expr("flatten(transform(bits, (x, i) -> transform(slice(bits, i + 2, size(bits)), y -> fp ^ x ^ y)))")
    points = many.select("list", "fp", F.explode(beside).alias("point"), F.lit(True).alias("near"))
    points = points.unionByName(many.select("list", "fp", F.explode(further).alias("point"), F.lit(False).alias("near")))
    # A point has no more members than there are points around a member.
    least = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("list", "point"))
    return points.select("fp", least.alias("b")).filter("fp <> b").select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")).distinct()


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs."""
    rows = stored(fingerprints(docs), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints-distinct")
    lists = stored(_lists(fps), "fingerprint-lists")
    edges = stored(_pairs(lists).unionByName(_around_points(lists)), "fingerprint-links")
    discard(lists)
    found = connected_components(edges).withColumnRenamed("node", "fp")
    discard(edges)
    linked = stored(fps.join(found, "fp"), "fingerprint-components")
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    others = linked.join(named, "component").select("fp", "component_id")
    alone = fps.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return rows.join(others.unionByName(alone), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
