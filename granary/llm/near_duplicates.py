"""Near-duplicate documents: an exact Jaccard join of word shingle sets with adaptive multi-match prefixes.

Sets are ordered by the shingles' hashes. If two sets reach the threshold, the first l tokens that they share lie within
the first |x| - least overlap + l tokens of each: a longer prefix is paid for by more tokens that must be shared in it.

1. Each document posts a prefix that asks for l = 1 + |x| / 16 shared tokens. Tokens that no other document posted are
   dropped, and then documents with fewer than l tokens left: they have no partner. Equal sets count as one.
2. The tokens left are ordered by how many documents post them. A document keeps all but its l - 1 commonest: any partner
   shares one of those kept. What they would cost in candidates is estimated from the same counts; documents for which
   that is much lengthen their prefixes until all that a partner must share is asked for, and are filtered again among
   themselves: they stay only if other such documents share three quarters of their tokens.
3. Candidates come from the posting lists, but only as far as they can still join two components: first each list's
   document that shares most with others is compared with the rest of the list, and components are formed; then, in the
   lists that still hold several components, every document outside the list's largest component is compared with all
   documents of other components. So a large group of near copies costs about a comparison a document. If the last step
   would be dear, the first is repeated with other documents first. No link is lost that joins two components.
4. A candidate pair must share l tokens of the prefixes; then its whole sets are compared.

Hashes have 64 bits for equal sets and set sizes, 48 for comparing sets. Null and empty texts have an empty set and link
with nothing: each is its own component. Rows that share a doc_id are separate documents of equal name. A component is
named by its smallest doc_id that is not null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import DOCUMENT_COLUMNS, discard, null_safe, stored, table
from granary.llm.components import connected_components
from granary.llm.shingles import from_planes, set_hash, shingle_sets, slices, to_planes

SIMILARITY = 75  # per cent
SHINGLE = 5
#: At first 1 + n // RUNG shared tokens are asked for; at the level FULL the prefix is the whole set.
RUNG = 16
FULL = 1
#: A document's candidates are estimated from the documents that share a kept token, on average and at most (a long list
#: counts one for each LONG_LIST of it); those dearer than DEAR get a longer prefix.
DEAR, LONG_LIST = 4.0, 16
#: Up to so many surviving documents (under 64 bytes each, 64 MB) are sent to where the sets are; more are joined by a shuffle.
MOST_SENT = 1_000_000
#: The comparison of all components in all lists begins when it costs at most so many candidates for each posted token,
#: or when comparing one document with the rest no longer makes it much cheaper.
FINAL_COST = 25.0
GAIN = 0.7


def _least_overlap(n, of=SIMILARITY):
    return -(-of * n // 100)


def asked(n, level: int):
    """How many shared tokens the prefix of a set of n asks for; numbers or arrays."""
    return _least_overlap(n) if level == FULL else np.minimum(1 + n // RUNG, _least_overlap(n))


def prefix_length(n, level: int):
    return n - _least_overlap(n) + asked(n, level)


def asked_column(n: Column, level: int, of: int = SIMILARITY) -> Column:
    """What is shared with any partner at least. A partner may have no more than the least overlap, and ask for less; in
    whole sets all that is shared shows."""
    small = F.ceil(n * of / 100)
    return small if level == FULL else F.least(1 + F.floor(small / RUNG), F.ceil(small * of / 100))


def document_sets(docs: DataFrame, size: int = SHINGLE, tie: Column | None = None) -> DataFrame:
    """row, doc_id, tie (0 where none is given), n (set size), sig (hash of the set), planes (its keys)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig, planes = [], [], []
            for keys in shingle_sets(batch.column("text"), size):
                n.append(len(keys))
                sig.append(set_hash(keys))
                planes.append(to_planes(keys))
            found = [pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(planes, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), *found], ["doc_id", "tie", "n", "sig", "planes"])

    tie = F.lit(0) if tie is None else tie
    rows = docs.select("doc_id", "text", tie.cast("long").alias("tie")).mapInArrow(sets, f"doc_id {kind}, tie long, n long, sig long, planes binary")
    return rows.withColumn("row", F.monotonically_increasing_id())


def _postings(sets: DataFrame, level: int) -> DataFrame:
    """token and row of the prefixes; of equal sets in one batch only that of the smallest row posts, so that of all does."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, planes = batch.column("row").to_numpy(), slices(batch.column("planes"))
            # A batch can span files that are read in another order than they were written.
            order = np.argsort(rows)
            firsts = order[np.unique(batch.column("sig").to_numpy()[order], return_index=True)[1]]
            for some in np.array_split(np.sort(firsts), max(1, len(firsts) // 256)):
                keys = [from_planes(planes[i]) for i in some.tolist()]
                keys = [k[: int(prefix_length(len(k), level))] for k in keys]
                if keys:
                    owners = np.repeat(rows[some], [len(k) for k in keys])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(owners)], ["token", "row"])

    return sets.filter("n > 0").select("row", "sig", "planes").mapInArrow(posted, "token long, row long")


def _shared(postings: DataFrame) -> DataFrame:
    """The postings of tokens that more than one document posts, with their number."""
    counts = postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    return postings.join(counts.hint("merge"), "token")


def _kept(postings: DataFrame, sizes: DataFrame, level: int) -> DataFrame:
    """For documents with enough shared tokens: row, n, central, cost, kept tokens (all but the commonest)."""
    lists = postings.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"), F.sum(F.log("df")).alias("weight"))
    lists = lists.join(sizes, "row")
    need = asked_column(F.col("n"), level)
    lists = lists.filter(F.size("tokens") >= need)
    kept = F.slice("tokens", F.lit(1), F.greatest(F.lit(0), F.size("tokens") - need + 1).cast("int"))
    others = F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x["df"] - 1) / F.size(kept)
    cost = others + F.try_element_at(kept, F.lit(-1))["df"] / LONG_LIST
    # What the set can share with another at most: the tokens found shared, and all that the prefix leaves out.
    least = F.ceil(F.col("n") * SIMILARITY / 100)
    left_out = F.lit(0) if level == FULL else least - F.least(1 + F.floor(F.col("n") / RUNG), least)
    most = F.size("tokens") + left_out
    return lists.select("row", "n", most.alias("most"), (F.col("weight") / F.col("n")).alias("central"), cost.alias("cost"), F.transform(kept, lambda x: x["token"]).alias("kept"))


def _lists(kept: DataFrame, level: int) -> DataFrame:
    """The posting lists; rank puts documents that share much with others first, and no two alike.

    Where a token is the first that two documents share, they share none before it: `most` counts from there.
    """
    rank = F.floor(F.col("central") * (1 << 16)) * F.lit(1 << 40) + F.pmod(F.xxhash64("row"), F.lit(1 << 40))
    rows = kept.select(F.lit(level).alias("level"), "kept", "row", "n", "most", rank.alias("rank"), (F.col("rung") == level).alias("own"), F.col("row").alias("component"))
    return rows.select("*", F.posexplode("kept").alias("pos", "token")).withColumn("most", F.col("most") - F.col("pos")).drop("kept", "pos")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("level").to_pylist(), slices(batch.column("x")), slices(batch.column("y"))
            good = np.fromiter((_linked(from_planes(x), from_planes(y), level) for level, x, y in zip(*columns, strict=True)), bool, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], ["a", "b"])

    x = sets.select(F.col("row").alias("a"), F.col("planes").alias("x"))
    y = sets.select(F.col("row").alias("b"), F.col("planes").alias("y"))
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "level", "x", "y").mapInArrow(checked, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, level: int) -> bool:
    ask = min(asked(len(x), level), asked(len(y), level))
    ahead = np.intersect1d(x[: prefix_length(len(x), level)], y[: prefix_length(len(y), level)], assume_unique=True)
    if len(ahead) < ask:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= SIMILARITY * (len(x) + len(y) - both)


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs of rows of one list, of different components, of sizes and shared tokens that may link; a document of the list's own level is in each."""
    other = right.select("level", "token", F.col("row").alias("row2"), F.col("n").alias("n2"), F.col("most").alias("most2"), F.col("own").alias("own2"), F.col("component").alias("component2"))
    both = left.select("level", "token", "row", "n", "most", "own", "component").join(other, ["level", "token"]).filter("component <> component2 and (own or own2)")
    both = both.filter((F.least("n", "n2") * 100 >= F.greatest("n", "n2") * SIMILARITY) & (F.least("most", "most2") * (100 + SIMILARITY) >= (F.col("n") + F.col("n2")) * SIMILARITY))
    return both.select("level", F.least("row", "row2").alias("a"), F.greatest("row", "row2").alias("b")).groupBy("a", "b").agg(F.min("level").alias("level"))


def _open(lists: DataFrame, first: bool) -> DataFrame:
    """The lists that hold several components and a document of their own level, with the list's size and largest component."""
    if first:
        counts = lists.groupBy("level", "token").agg(F.count("*").alias("size"), F.count("*").alias("parts"), F.max("row").alias("largest"), F.bool_or("own").alias("any_own"))
    else:
        parts = lists.groupBy("level", "token", "component").agg(F.count("*").alias("here"), F.bool_or("own").alias("any_own"))
        counts = parts.groupBy("level", "token").agg(F.sum("here").alias("size"), F.count("*").alias("parts"), F.max_by("component", "here").alias("largest"), F.bool_or("any_own").alias("any_own"))
    return lists.join(counts.filter("parts > 1 and any_own").drop("parts", "any_own"), ["level", "token"])


def _star_pairs(open_: DataFrame, first: bool) -> DataFrame:
    """Pairs of each list's first document (after the first round, of those outside the largest component) with the others."""
    leaders = open_.filter("own") if first else open_.filter("component <> largest")
    chosen = leaders.groupBy("level", "token").agg(*(F.max_by(c, "rank").alias(c) for c in ("row", "n", "most", "own", "component")))
    return _pairs(chosen, open_)


def _final_pairs(open_: DataFrame) -> DataFrame:
    """All pairs of different components: none has both in the largest, and each has a document of the list's own level."""
    minor = F.col("component") != F.col("largest")
    first = _pairs(open_.filter(minor & F.col("own")), open_)
    rest = _pairs(open_.filter(~minor & F.col("own")), open_.filter(minor & ~F.col("own")))
    return first.unionByName(rest).groupBy("a", "b").agg(F.min("level").alias("level"))


def _final_cost(open_: DataFrame) -> int:
    """How many rows those pairs are drawn from."""
    minor = F.col("component") != F.col("largest")
    n = lambda test: F.count(F.when(test, 1))
    lists = open_.groupBy("level", "token").agg(F.max("size").alias("size"), n(minor & F.col("own")).alias("a"), n(~minor & F.col("own")).alias("b"), n(minor & ~F.col("own")).alias("c"))
    return lists.agg(F.sum(F.col("a") * F.col("size") + F.col("b") * F.col("c"))).first()[0] or 0


def _candidates(sets: DataFrame, kept: DataFrame) -> DataFrame:
    """The sets of the documents kept, with their rung."""
    few = kept.select("row", "rung")
    if few.count() <= MOST_SENT:
        few = F.broadcast(few)
    return sets.select("row", "sig", "n", "planes").join(few, "row")


def links(sets: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stored edges (a, b) between rows with different sets that reach the threshold, enough of them to join all that
    link, and the scratch tables that they no longer need. The table `sets` itself is gone after this."""
    sizes = stored(sets.select("row", "n"), "sizes")
    firsts = sets.filter("n > 0").groupBy("sig").agg(F.min("row").alias("row")).select("row")
    posted = stored(_shared(_postings(sets, 0)).select("token", "row").join(firsts, "row"), "postings")
    kept = stored(_kept(_shared(posted), sizes, 0).withColumn("rung", (F.col("cost") > DEAR).cast("int")), "kept")
    candidates = stored(_candidates(sets, kept), "candidates")
    discard(posted, sets)
    dear = candidates.filter("rung = 1")
    longer_posted = stored(_postings(dear, FULL), "postings-longer")
    longer = _kept(_shared(longer_posted), sizes, FULL).withColumn("rung", F.lit(FULL))
    lists = stored(_lists(kept, 0).unionByName(_lists(longer, FULL)), "lists")
    discard(kept, longer_posted)
    posted_tokens = lists.count()
    edges: list[DataFrame] = []
    used: list[DataFrame] = [lists]
    last = float("inf")
    while True:
        open_ = stored(_open(lists, not edges), "open")
        discard(*used)
        cost = _final_cost(open_)
        if cost == 0:
            return edges, [open_, candidates, sizes]
        if edges and (cost <= FINAL_COST * posted_tokens or cost > GAIN * last):
            break
        last = cost
        edges.append(stored(_verified(_star_pairs(open_, not edges), candidates), "links"))
        # A list with one component stays so: later rounds see the open lists only.
        found = connected_components(reduce(DataFrame.unionByName, edges)).withColumnRenamed("node", "row")
        lists = open_.drop("size", "largest", "component").join(found, "row", "left").withColumn("component", F.coalesce("component", "row"))
        used = [open_]
    edges.append(stored(_verified(_final_pairs(open_), candidates), "links"))
    return edges, [open_, candidates, sizes]


def grouped(docs: DataFrame, tie: Column | None = None) -> DataFrame:
    """doc_id, tie, n, group of every row of docs; the group is null where there are no words."""
    sets = stored(document_sets(docs, tie=tie), "sets")
    rows = stored(sets.select("doc_id", "tie", "row", "sig", "n"), "rows")
    classes = rows.filter("n > 0").groupBy("sig").agg(F.min("row").alias("first"))
    edges, used = links(sets)
    discard(*used)
    named = rows.filter("n > 0").join(classes, "sig")
    if edges:
        components = stored(connected_components(reduce(DataFrame.unionByName, edges)), "components")
        discard(*edges)
        named = named.join(components.withColumnRenamed("node", "first"), "first", "left").withColumn("group", F.coalesce("component", "first"))
    else:
        named = named.withColumn("group", F.col("first"))
    alone = rows.filter("n = 0").withColumn("group", F.lit(None).cast("long"))
    return named.select("doc_id", "tie", "n", "group").unionByName(alone.select("doc_id", "tie", "n", "group"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    rows = grouped(docs)
    named = rows.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    linked = rows.filter("group is not null").join(named, "group").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter("group is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents' columns of one document of each group, that with the smallest doc_id (null last, ties to the
    smaller hash of the row), and of all without words. Rows that are equal throughout count as one document."""
    rows = docs.select(*DOCUMENT_COLUMNS)
    tie = F.xxhash64(*DOCUMENT_COLUMNS)
    found = grouped(rows, tie).withColumn("key", null_safe("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "key")).alias("first")
    chosen = found.filter("group is not null").groupBy("group").agg(first).select("first.key", "first.tie")
    kept = chosen.unionByName(found.filter("group is null").select("key", "tie"))
    # One shuffle of the texts serves the join and the search for equal rows.
    keyed = rows.withColumn("key", null_safe("doc_id")).withColumn("tie", tie)
    return keyed.join(kept, ["key", "tie"], "left_semi").dropDuplicates(["key", "tie"]).select(*DOCUMENT_COLUMNS)


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Shared shingles are counted in one join; components are the least ids that spread along links.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (h) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.id = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""
