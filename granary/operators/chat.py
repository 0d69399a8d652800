"""Chats: what a rewritten query sees of them, how messages are listed, and synonyms put into queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import udfs
from granary.functions.text import strip
from granary.operators.analysis import contained

# Messages looked at, and kept in all.
RECENT, MOST_CONTEXT, MOST_EXPANSIONS = 6, 12, 6
ROLES = ("user", "assistant")
#: Terms that go with the rows.
MOST_SENT = 10_000


def rewrite_context(messages: DataFrame, manual: DataFrame, turn: Column) -> DataFrame:
    """session_id and context: the latest six visible, finished messages of each session but for those of its current turn,
    oldest first, after what was given by hand; blank ones go, and the last twelve stay.

    messages: session_id, turn_id, role, content, status, visible, created; manual: session_id, place, role, content.
    """
    fit = F.col("visible") & F.col("role").isin(*ROLES) & F.col("status").isin("completed", "streaming") & (F.col("turn_id").isNull() | (F.col("turn_id") != turn))
    newest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created"), F.desc("turn_id")))
    recent = messages.filter(fit).withColumn("n", newest).filter(F.col("n") <= RECENT)
    rows = recent.select("session_id", F.lit(1).alias("part"), (-F.col("n")).cast("long").alias("place"), "role", "content")
    given = manual.select("session_id", F.lit(0).alias("part"), F.col("place").cast("long").alias("place"), F.lower(strip(F.col("role"))).alias("role"), "content").filter(F.col("role").isin(*ROLES))
    both = given.unionByName(rows).withColumn("content", strip(F.coalesce("content", F.lit("")))).filter("content <> ''")
    items = F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    context = items.alias("context")
    out = both.groupBy("session_id").agg(context)
    return out.withColumn("context", F.slice("context", F.greatest(F.lit(1), F.size("context") - MOST_CONTEXT + 1), F.lit(MOST_CONTEXT)))


def listed_messages(messages: DataFrame, citations: DataFrame) -> DataFrame:
    """Messages in the order of their sessions (created, turn, the user's before the answer's) with place and their citations in order."""
    rank = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    cited = citations.groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]).alias("citations"))
    w = Window.partitionBy("session_id").orderBy("created", F.coalesce("turn_id", "message_id"), rank, "message_id")
    out = messages.withColumn("place", F.row_number().over(w)).join(cited, "message_id", "left")
    return out.withColumn("citations", F.coalesce("citations", F.array().cast("array<string>")))


def synonym_map(rules: DataFrame) -> DataFrame:
    """user_term, professional_term, scope and expansions of rules (synonym_id, professional_term, own, variant_id, user_term,
    priority): of rules with one user term that of the own collection comes first, then the higher priority, then the id.
    A rule's expansions are its term and its variants, six at most."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    r = rules.withColumn("professional_term", clean("professional_term")).withColumn("user_term", clean("user_term")).filter("professional_term <> '' and user_term <> ''")
    variants = F.transform(F.array_sort(F.collect_list(F.struct("variant_id", "user_term"))), lambda x: x["user_term"])
    grown = r.groupBy("synonym_id").agg(variants.alias("v"), F.first("professional_term").alias("p"))
    grown = grown.select("synonym_id", F.slice(F.array_distinct(F.concat(F.array("p"), "v")), 1, MOST_EXPANSIONS).alias("expansions"))
    first = F.row_number().over(Window.partitionBy("user_term").orderBy(F.desc("own"), F.desc("priority"), "synonym_id", "variant_id"))
    once = r.withColumn("_n", first).filter("_n = 1")
    return once.join(grown, "synonym_id").select("user_term", "professional_term", F.when(F.col("own"), "kb").otherwise("tenant").alias("scope"), "expansions")


def rewritten(queries: DataFrame, key: str, query: str, mapping: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """queries with `rewritten`: user terms replaced by professional ones, the longest at each place, in one pass.

    A map of up to `most_sent` terms goes with the rows, after a count. Of a larger one each query (of a unique `key`) gets the terms
    that it contains, by a join on windows of letters; terms of one letter, of which there are no more than letters, go with the rows."""
    terms = mapping.select("user_term", "professional_term").filter("user_term <> ''")
    few = terms.limit(most_sent + 1).collect()
    if len(few) <= most_sent:
        return queries.withColumn("rewritten", udfs.replace_longest(F.col(query), {r["user_term"]: r["professional_term"] for r in few}))
    letters = {r["user_term"]: r["professional_term"] for r in terms.filter(F.length("user_term") == 1).collect()}
    found = contained(queries.select(key, query), key, query, terms, "user_term").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("user_term", "professional_term"))).alias("_terms"))
    return queries.join(found, key, "left").withColumn("rewritten", udfs.replace_own(F.col(query), F.col("_terms"), letters)).drop("_terms")
