"""Recall, fusion, reranking and merging of hits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import scoring, text
from granary.operators import rules, trees


@dataclass(frozen=True)
class Search:
    """Limits and weights of a hybrid search, drawn into their bounds."""

    top_k: int = 10
    rerank_n: int = 30
    vector_k: int | None = None
    keyword_k: int | None = None
    vector_weight: float = 0.65
    lexical_weight: float = 0.35
    vector_threshold: float = 0.0
    lexical_threshold: float = 0.0
    threshold: float = 0.0
    kind: str = "document"
    scopes: dict[str, float] = field(default_factory=dict)

    def clamped(self) -> Search:
        rerank = min(max(1, self.rerank_n), 200)
        top = min(max(1, self.top_k), rerank)
        vector = min(max(1, self.vector_k or 6 * top), 500)
        keyword = min(max(1, self.keyword_k or 4 * top), 500)
        return Search(top, rerank, vector, keyword, self.vector_weight, self.lexical_weight, self.vector_threshold, self.lexical_threshold, self.threshold, self.kind, self.scopes or scoring.scope_weights(self.kind))


def vector_recall(rows: DataFrame, query: list[float], k: int, vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The k rows nearest to a query vector by cosine, with score."""
    q = F.array(*map(F.lit, query)).cast("array<double>")
    scored = rows.filter(F.size(vector) == len(query)).withColumn("score", F.round(scoring.cosine(F.col(vector), q), 6))
    return scored.orderBy(F.desc_nulls_last("score"), tie).limit(k)


def best_of_each(rows: DataFrame, by: str, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each group, with rank from 1."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def lexical_recall(rows: DataFrame, strict: list[str], loose: list[str], phrases: list[tuple[str, float]], words: list[tuple[str, float]], k: int, body: str = "text", tie: str = "doc_id") -> DataFrame:
    """Rows that hold all strict or any loose token; phrases and words only add to the score.

    Tokens are made once, behind a generator, for the test and for the score."""
    once = rows.select("*", F.explode(F.array(F.struct(text.lexical_tokens(body).alias("tokens"), F.lower(body).alias("lowered")))).alias("_x"))
    wanted = F.array(*map(F.lit, dict.fromkeys([*strict, *loose]))).cast("array<string>")
    score = text.lexical_score(scoring.weighted_terms(F.col("_x.lowered"), F.col("_x.tokens"), strict, loose, phrases, words))
    return once.filter(F.arrays_overlap("_x.tokens", wanted)).withColumn("score", F.round(score, 4)).orderBy(F.desc("score"), tie).limit(k).drop("_x")


def fuse(hits: DataFrame, search: Search) -> DataFrame:
    """Groups of hits with their fused score and anchor.

    hits: seq (vector hits by rank, then lexical ones), backend, group_key, chunk, scope, score, boost, bonus. Hits below
    their backend's threshold go. Each hit is scored with the best scores of its group so far and its own scope's weight;
    the best one, the last of equals, is the group's anchor. Groups are cut to rerank_n before the final threshold.
    """
    least = F.when(F.col("backend") == "vector", search.vector_threshold).otherwise(search.lexical_threshold)
    kept = hits.filter(F.col("score") >= least)
    so_far = Window.partitionBy("group_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    of_scope = Window.partitionBy("group_key", "scope").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("v", F.max(F.when(F.col("backend") == "vector", F.col("score"))).over(so_far))
    kept = kept.withColumn("k", F.max(F.when(F.col("backend") == "lexical", F.col("score"))).over(so_far))
    kept = kept.withColumn("scopes", F.size(F.collect_set("scope").over(so_far))).withColumn("backends", F.size(F.collect_set("backend").over(so_far)))
    kept = kept.withColumn("weight", scoring.lookup(F.col("scope"), search.scopes or scoring.scope_weights(search.kind), scoring.OTHER_SCOPE))
    bonus = scoring.repeated_hit_bonus(F.col("scope"), F.count("*").over(of_scope)) + F.col("bonus")
    score = scoring.group_score(F.col("v"), F.col("k"), search.vector_weight, search.lexical_weight, F.col("weight"), F.col("scopes"), F.col("backends"), bonus, F.col("boost"))
    kept = kept.withColumn("fused", F.round(score, 6))
    groups = kept.groupBy("group_key").agg(F.min("seq").alias("first_seq"), F.max(F.struct("fused", "seq", "chunk", "scope")).alias("best"), F.max("v").alias("vector_score"), F.max("k").alias("lexical_score"), F.count("*").alias("hits"))
    out = groups.select("group_key", F.col("best.fused").alias("score"), F.col("best.chunk").alias("anchor"), F.col("best.scope").alias("scope"), "vector_score", "lexical_score", "hits", "first_seq")
    return out.orderBy(F.desc("score"), "first_seq").limit(search.rerank_n).filter(F.col("score") >= search.threshold)


def rerank(items: DataFrame, score: Column, k: int, tie: str) -> DataFrame:
    """The k best items by a score, with rank from 1."""
    best = items.withColumn("rerank_score", F.round(score, 6)).orderBy(F.desc("rerank_score"), tie).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rerank_score"), tie)))


def merge_collections(items: DataFrame, query: str, search: Search, body: str = "text", tie: str = "doc_id", least: float = 0.0) -> DataFrame:
    """Hits of several collections: cut to rerank_n, rescored with a tenth for the query's terms in them, cut to top_k."""
    cut = items.orderBy(F.desc("score"), tie).limit(max(search.rerank_n, search.top_k))
    wanted = text.terms(F.lit(query))
    final = F.round(0.9 * F.col("score") + 0.1 * text.contained_share(wanted, F.lower(F.col(body))), 6)
    return cut.withColumn("final", final).filter(F.col("final") >= least).orderBy(F.desc("final"), tie).limit(max(1, search.top_k))


def neighbours(rows: DataFrame, by: str, order: str, body: str, k: int) -> DataFrame:
    """Adds previous and next: the k texts before and after each row of its group, in order."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("previous", F.collect_list(body).over(w.rowsBetween(-k, -1))).withColumn("next", F.collect_list(body).over(w.rowsBetween(1, k)))


def tag_boosts(bindings: DataFrame, signals: DataFrame, most: float = 0.10, each: float = 0.04) -> DataFrame:
    """Boost of each target from the tags that it shares with signals (tag, confidence, source), at most `most`."""
    gain = each * F.col("confidence") * scoring.signal_weight(F.col("source")) * scoring.distance_decay(F.col("distance"))
    per_tag = bindings.join(signals, "tag").groupBy("target", "tag").agg(F.max(gain).alias("gain"))
    return per_tag.groupBy("target").agg(F.round(F.least(F.lit(most), F.sum("gain")), 4).alias("boost"))


def ancestor_tags(docs: DataFrame, folder_tags: DataFrame) -> DataFrame:
    """(target, tag, distance) of documents (target, folder as a dotted path) from the tags of their folders and all above
    them (folder, tag): distance 0 for the own folder; the nearest counts."""
    up = docs.select("target", F.posexplode(F.reverse(trees.prefixes("folder"))).alias("distance", "folder"))
    return up.join(folder_tags, "folder").groupBy("target", "tag").agg(F.min("distance").alias("distance"))


def summary_units(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """A unit of each document's usable summary (doc, summary), hung on its first chunk (doc, chunk_id)."""
    # Exploded, so that a summary is judged once, not for the filter and for the column.
    usable = summaries.select("doc", F.explode(F.array(rules.usable_summary("summary"))).alias("search_text")).filter("search_text is not null")
    first = chunks.groupBy("doc").agg(F.min("chunk_id").alias("chunk_id"))
    return usable.join(first, "doc").select("chunk_id", F.lit("doc_summary").alias("search_scope"), "search_text", F.lit(35).alias("priority"), F.lit(False).alias("vectorize"))
