"""Mixing sources to target weights.

The words of each source form blocks of fixed length. A source's target says how many words the mix takes from it, and
so how many slots of one block each it fills: whole passes over its blocks, then a part of one more pass, whose last
slot is cut so that the words taken equal the target. All slots of all sources are dealt to output shards of equal
length through a pseudorandom permutation: the source counts of a shard are a multinomial draw, given the totals (draws
that ignore the totals would let a small source miss its target by the sampling noise). Within a source, slot k of a
pass stands for block pi(k), pi being a pseudorandom permutation of the source's blocks; slots and blocks meet in a
join on (source, block). The shard and the place of each slot go with what it takes: documents come with their first and
last shard, pieces of the mix with shard and place.

Everything is a DataFrame expression. Running sums are taken within buckets of documents, over the buckets of a group and
over the groups' totals, so that a source that holds most rows is spread over many tasks.

Null and empty texts have size 0 and are never taken; a null source is a source of its own (the last); repeated rows
are separate documents; with no words at all every target is 0. Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import DOCUMENT_COLUMNS, WORD, null_safe, stored, table, text_or_empty

ROUNDS = 24
#: Slots made from one row, and tasks that make them.
SLOTS_A_CHUNK, MOST_TASKS = 4096, 20_000
DOCS_A_BUCKET, BUCKETS_A_GROUP = 256, 1024


@dataclass(frozen=True)
class Mix:
    """Parameters: weights repeat over the sources by code point; share is of all words; cap is of a source's words."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: float = 2.0
    block: int = 1024
    shard_slots: int = 1024
    seed: int = 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def word_count(text: Column) -> Column:
    """Number of words, without cutting them out: starts of words in the text with every blank turned into a space."""
    blanks = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(blanks, " ", -1), "")).cast("long")


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The place of x in a pseudorandom permutation of 0 .. n-1 named by key: rounds of swap-or-not."""

    def step(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        return F.when(F.xxhash64(key, -r, F.greatest(at, partner)) % 2 == 0, partner).otherwise(at)

    return F.aggregate(F.array(*(F.lit(r) for r in range(1, rounds + 1))), x, step)


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """A row for each source: key, source_size, target, and where its slots begin among all slots.

    The windows over all sources see a row a source, not a row a document.
    """
    every, by_name = Window.partitionBy(F.lit(0)), Window.orderBy(F.asc_nulls_last("source"))
    out = sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    weights = F.array(*(F.lit(float(w)) for w in mix.weights))
    out = out.withColumn("weight", F.element_at(weights, (F.row_number().over(by_name) - 1) % len(mix.weights) + 1))
    out = out.withColumn("most", mix.cap * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    left = mix.share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(by_ratio), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    # The level is what a weight of 1 gets once all sources before this one stop at their most.
    out = out.withColumn("level", left / weight_left).withColumn("stops", F.col("most") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(every)
    out = out.withColumn("target", F.when(F.col("stops"), F.col("most")).otherwise(level * F.col("weight")))
    n, take = F.col("source_size"), F.col("take")
    out = out.withColumn("take", F.least(F.round("target").cast("long"), F.floor(F.col("most")).cast("long")))
    out = out.withColumn("whole_blocks", F.floor(n / mix.block)).withColumn("blocks", F.ceil(n / mix.block))
    out = out.withColumn("passes", F.when(n > 0, F.floor(take / n)).otherwise(0)).withColumn("rest", take - F.col("passes") * n)
    out = out.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / mix.block))
    out = out.withColumn("first_slot", F.sum("slots").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) - F.col("slots"))
    return out.withColumn("all_slots", F.sum("slots").over(every))


def slots(targets: DataFrame, mix: Mix) -> DataFrame:
    """Output slots: shard, place, source_key, pass, block, words (from the block's beginning)."""
    chunks = targets.filter("slots > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / SLOTS_A_CHUNK))))
    # Few bytes, but much work for each: as many tasks as chunks.
    tasks = targets.agg(F.sum(F.ceil(F.col("slots") / SLOTS_A_CHUNK))).first()[0] or 1
    chunks = chunks.repartition(min(int(tasks), MOST_TASKS), "source_key", "chunk")
    first = F.col("chunk") * SLOTS_A_CHUNK
    out = chunks.withColumn("slot", F.explode(F.sequence(first, F.least(first + SLOTS_A_CHUNK, F.col("slots")) - 1)))
    out = out.withColumn("pass", F.floor(F.col("slot") / F.col("blocks"))).withColumn("k", F.col("slot") % F.col("blocks"))
    whole = F.col("whole_blocks")
    pi = permuted(F.col("k"), whole, F.xxhash64(F.lit(mix.seed), "source_key", "pass"))
    out = out.withColumn("block", F.when(F.col("k") < whole, pi).otherwise(whole))
    length = F.least(F.lit(mix.block), F.col("source_size") - F.col("block") * mix.block)
    out = out.withColumn("words", F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - F.col("k") * mix.block)))
    dealt = permuted(F.col("first_slot") + F.col("slot"), F.col("all_slots"), F.xxhash64(F.lit(mix.seed), F.lit("shards")))
    out = out.withColumn("shard", F.floor(dealt / mix.shard_slots)).withColumn("place", dealt % mix.shard_slots)
    return out.select("shard", "place", "source_key", "pass", "block", "words")


def shard_counts(slots: DataFrame) -> DataFrame:
    """How many slots of each shard each source fills: the multinomial draws."""
    return slots.groupBy("shard", "source_key").agg(F.count("*").alias("slots"))


def sized(docs: DataFrame, *carried: str) -> DataFrame:
    size = word_count(text_or_empty())
    return docs.select("doc_id", "source", null_safe("source").alias("source_key"), size.alias("size"), F.xxhash64("doc_id", "text").alias("tie"), *carried)


def laid_out(sizes: DataFrame, totals: DataFrame, buckets: int) -> DataFrame:
    """Adds bucket and start, the document's first word among its source's; totals: words by (source_key, bucket)."""
    before = lambda *keys: Window.partitionBy("source_key", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("group", F.floor(F.col("bucket") / BUCKETS_A_GROUP))
    groups = totals.groupBy("source_key", "group").agg(F.sum("bucket_words").alias("group_words"))
    groups = groups.select("source_key", "group", F.coalesce(F.sum("group_words").over(before("group")), F.lit(0)).alias("group_base"))
    base = F.coalesce(F.sum("bucket_words").over(before("group", "bucket")), F.lit(0))
    totals = totals.withColumn("base", base).join(groups, ["source_key", "group"]).select("source_key", "bucket", (F.col("base") + F.col("group_base")).alias("base"))
    within = Window.partitionBy("source_key", "bucket").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = sizes.withColumn("bucket", _bucket(buckets)).withColumn("start", F.sum("size").over(within) - F.col("size"))
    return out.join(totals.hint("merge"), ["source_key", "bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("base")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets))


def _plan(docs: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Sizes, targets by source, words by (source, bucket), number of buckets."""
    sizes = stored(sized(docs), "mix-sizes")
    buckets = max(1, sizes.count() // DOCS_A_BUCKET)
    targets = stored(source_targets(sizes, mix), "mix-targets")
    totals = sizes.groupBy("source_key", _bucket(buckets).alias("bucket")).agg(F.sum("size").alias("bucket_words"))
    return sizes, targets, totals, buckets


def block_parts(layout: DataFrame, mix: Mix) -> DataFrame:
    """A row for each block that a document reaches into: block, and lo to hi, the document's words in it by place in the source."""
    b = mix.block
    last = F.floor((F.col("start") + F.col("size") - 1) / b)
    out = layout.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), last)))
    return out.withColumn("lo", F.greatest("start", F.col("block") * b)).withColumn("hi", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b))


def mix_counts(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes; pieces,
    first_shard, last_shard: the slots that take some, and the shards among which they lie (null where nothing is taken)."""
    sizes, targets, totals, buckets = _plan(docs, mix)
    layout = laid_out(sizes, totals, buckets)
    parts = block_parts(layout, mix).select("doc_id", "source", "source_key", "size", "start", "block", "lo", "hi")
    taken = F.greatest(F.lit(0), F.least(F.col("hi"), F.col("block") * mix.block + F.coalesce("words", F.lit(0))) - F.col("lo"))
    joined = parts.join(slots(targets, mix).hint("merge"), ["source_key", "block"], "left").withColumn("taken", taken)
    some = F.when(F.col("taken") > 0, F.col("shard"))
    by_doc = joined.groupBy("source_key", "start").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.sum("taken").alias("taken"), F.count(some).alias("pieces"), F.min(some).alias("first_shard"), F.max(some).alias("last_shard"))
    none = [F.lit(0).cast("long").alias(c) for c in ("taken", "pieces")] + [F.lit(None).cast("long").alias(c) for c in ("first_shard", "last_shard")]
    empty = sizes.filter("size = 0").select("source_key", F.lit(0).cast("long").alias("start"), "doc_id", "source", "size", *none)
    of_source = targets.select("source_key", "source_size", "target")
    return by_doc.unionByName(empty).join(of_source, "source_key").select("doc_id", "source", "size", "source_size", "target", "taken", "pieces", "first_shard", "last_shard")


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: for each slot the words that it takes, a row for each document in it, with the documents' columns
    and the slot's shard and place; `in_shards` lays it out.

    A document taken whole keeps its text as it was; a part has its words with single blanks between them. A document
    that is taken twice comes twice; n_chars is counted anew.
    """
    sizes, targets, totals, buckets = _plan(docs, mix)
    layout = laid_out(sized(docs, "text", "lang"), totals, buckets)
    parts = block_parts(layout, mix)
    whole = (F.col("lo") == F.col("start")) & (F.col("hi") - F.col("lo") == F.col("size"))
    piece = F.when(whole, F.col("text")).otherwise(_words_of(F.col("lo") - F.col("start"), F.col("hi") - F.col("lo")))
    parts = parts.select("doc_id", "lang", "source", "source_key", "block", "lo", "hi", piece.alias("text"))
    cut = F.least(F.col("hi"), F.col("block") * mix.block + F.col("words")) - F.col("lo")
    taken = parts.join(slots(targets, mix).hint("merge"), ["source_key", "block"]).withColumn("n", cut).filter("n > 0")
    text = F.when(F.col("n") == F.col("hi") - F.col("lo"), F.col("text")).otherwise(_words_of(F.lit(0), F.col("n")))
    return taken.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS, "shard", "place")


def in_shards(mixed: DataFrame) -> DataFrame:
    """The mix with each shard in one partition, in the order of its slots. A shard has a bounded number of words."""
    return mixed.repartition("shard").sortWithinPartitions("shard", "place", "doc_id")


def _words_of(first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words(F.col("text")), (first + 1).cast("int"), n.cast("int")), " ")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).drop("source")
