"""Cutting unspaced script into the words of a weighted dictionary, and the terms that an index or a query takes from it.

A run of ideographs is a graph: its letters are the nodes, the dictionary's words found in it are the edges. Words are found by
an equality join of all stretches up to the longest word, both sides dealt out and merged, so that a dictionary of any size will
do and stretches, many times their texts, are never sent to all tasks. Equal runs are cut once. The best path has the
greatest sum of log frequencies; weights are whole millionths of e-folds, so that sums are exact, and of equal paths the one
with the longer first word counts. A letter that is no word stands for itself with the weight of a word seen once.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from granary.functions import text
from granary.operators.lexical import unstopped_windows
from granary.sources.scratch import scratch_path

# Frequency of a word that a collection adds, letters of a term, terms and windows by mode, scores.
OWN_FREQUENCY = 20_000
LEAST_LETTERS, MOST_LETTERS = 2, 64
MOST_TERMS = {"index": 256, "query": 48}
MOST_WINDOWS = {"index": 80, "query": 16}
OWN_SCORE, KNOWN_SCORE, PLAIN_SCORE = 1.0, 0.94, 1.0

WEIGHT_UNIT = 1_000_000
_PLACES = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("own", T.BooleanType())]))


def weighted_dictionary(words: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """word, weight, own: from counted words (word, n) and words that a collection adds (word). A word of both is the collection's.

    Words are normalised; those without letters or longer than a term may be don't count, counts below one count as one. The
    merged words are a scratch table, so that what they were counted from is read once, however often the dictionary is."""
    normal = text.normalize_lexical("word")
    counted = words.select(normal.alias("word"), F.greatest(F.col("n"), F.lit(1)).cast("long").alias("n"), F.lit(False).alias("own"))
    if own is not None:
        counted = counted.unionByName(own.select(normal.alias("word"), F.lit(OWN_FREQUENCY).cast("long").alias("n"), F.lit(True).alias("own")))
    counted = counted.filter(F.length("word").between(1, MOST_LETTERS))
    merged = counted.groupBy("word").agg(F.max(F.struct("own", "n")).alias("top"), F.sum("n").alias("n"))
    merged = merged.select("word", "top.own", F.when(F.col("top.own"), F.col("top.n")).otherwise(F.col("n")).alias("n"))
    path = scratch_path(words.sparkSession, "dictionary")
    merged.write.parquet(path)
    merged = words.sparkSession.read.schema(merged.schema).parquet(path)
    total = merged.agg(F.sum("n")).first()[0] or 1
    return merged.select("word", F.round((F.log("n") - F.lit(math.log(total))) * WEIGHT_UNIT).cast("long").alias("weight"), "own", F.lit(round(-math.log(total) * WEIGHT_UNIT)).cast("long").alias("unknown"))


def best_path(n: int, edges: list[tuple[int, int, int, bool]], unknown: int) -> list[tuple[int, int, bool]]:
    """(at, size, own) of the words on the best path through n letters; edges are (at, size, weight, own), at from 1."""
    best, step = [0] * (n + 2), [(1, False)] * (n + 2)
    starting: list[list[tuple[int, int, bool]]] = [[] for _ in range(n + 2)]
    for at, size, weight, own in edges:
        starting[at].append((size, weight, own))
    for at in range(n, 0, -1):
        options = [(w + best[at + s], s, o) for s, w, o in starting[at]]
        if not any(s == 1 for s, _, _ in starting[at]):
            options.append((unknown + best[at + 1], 1, False))
        best[at], *chosen = max(options)
        step[at] = (chosen[0], chosen[1])
    out, at = [], 1
    while at <= n:
        size, own = step[at]
        out.append((at, size, own))
        at += size
    return out


@pandas_udf(T.StructType([T.StructField("path", _PLACES), T.StructField("search", _PLACES)]))
def _cut(n: pd.Series, edges: pd.Series, unknown: pd.Series) -> pd.DataFrame:
    """The best path, and the known words of two and three letters inside its longer words, before each such word."""
    paths, searches = [], []
    for letters, found, least in zip(n, edges, unknown, strict=True):
        found = [(e["at"], e["size"], e["weight"], e["own"]) for e in found]
        path = best_path(letters, found, least)
        short = {(at, size): own for at, size, _, own in found if size in (2, 3)}
        search = []
        for at, size, own in path:
            for inner in (2, 3):
                if size > inner:
                    search += [(i, inner, short[i, inner]) for i in range(at, at + size - inner + 1) if (i, inner) in short]
            search.append((at, size, own))
        paths.append([dict(at=a, size=s, own=o) for a, s, o in path])
        searches.append([dict(at=a, size=s, own=o) for a, s, o in search])
    return pd.DataFrame({"path": paths, "search": searches})


def runs_of(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, run_no, run: the runs of ideographs of each row's normalised text."""
    found = F.regexp_extract_all(text.normalize_lexical(body), F.lit(r"([㐀-䶿一-鿿]+)"), F.lit(1))
    return rows.select(key, F.posexplode(found).alias("run_no", "run"))


def word_graph(runs: DataFrame, keys: list[str], dictionary: DataFrame) -> DataFrame:
    """The keys, at, size, weight, own: a row for each dictionary word in each run.

    Spark takes exploded rows for no larger than what they come from, and would else send all stretches of all runs to every task."""
    longest = dictionary.agg(F.max(F.length("word"))).first()[0] or 1
    inside = F.expr(f"flatten(transform(sequence(1, length(run)), i -> transform(sequence(1, least({longest}, length(run) - i + 1)), n -> named_struct('at', i, 'word', substring(run, i, n)))))")
    keyed = runs.select(*keys, F.explode(inside).alias("_e")).select(*keys, F.col("_e.at").alias("at"), F.col("_e.word").alias("word"))
    words = dictionary.select("word", F.length("word").alias("size"), "weight", "own")
    return keyed.hint("merge").join(words, "word").select(*keys, "at", "size", "weight", "own")


def segmented(rows: DataFrame, key: str, body: str, dictionary: DataFrame) -> DataFrame:
    """key, run_no, run, words (its best path), search (these with the short words inside them, each with own) of each run of ideographs.

    `key` must be unique. Rows without ideographs give none."""
    runs = runs_of(rows, key, body)
    once = runs.select("run").distinct()
    unknown = dictionary.agg(F.max("unknown")).first()[0] or 0
    edges = word_graph(once, ["run"], dictionary).groupBy("run").agg(F.collect_list(F.struct("at", "size", "weight", "own")).alias("edges"))
    none = F.array().cast("array<struct<at int, size int, weight long, own boolean>>")
    cut = _cut(F.length("run"), F.coalesce("edges", none), F.lit(unknown).cast("long"))
    # The left joins keep Spark from sending the runs.
    paths = once.join(edges, "run", "left").select("run", cut.alias("cut"))
    found = runs.join(paths, "run", "left").select(key, "run_no", "run", "cut")
    word = lambda p: F.col("run").substr(p["at"], p["size"])
    return found.select(key, "run_no", "run", F.transform("cut.path", word).alias("words"), F.transform("cut.search", lambda p: F.struct(word(p).alias("word"), p["own"].alias("own"))).alias("search"))


def analyzed(rows: DataFrame, key: str, body: str, dictionary: DataFrame, stopwords: list[str] = (), mode: str = "index") -> DataFrame:
    """key, terms (text, score, source), windows and ignored words of every row: what an index keeps of a text, or a query asks for.

    Words of the best paths come first, then the short words inside them, then terms of letters and digits, all once and up to the
    mode's limit; stopwords are ignored. Two-letter windows fill in what is no term, in a query only if fewer than two words are known.
    """
    stops = F.array(*map(F.lit, stopwords)).cast("array<string>")
    runs = segmented(rows, key, body, dictionary).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("run_no", "words", "search"))).alias("_runs"))
    out = rows.select(key, body).join(runs, key, "left")
    searched = F.coalesce(F.flatten(F.transform("_runs", lambda r: r["search"])), F.array().cast("array<struct<word string, own boolean>>"))
    own = F.array_distinct(F.transform(F.filter(searched, lambda w: w["own"]), lambda w: w["word"]))
    paths = F.coalesce(F.flatten(F.transform("_runs", lambda r: r["words"])), F.array().cast("array<string>"))
    cut = F.array_distinct(F.concat(paths, F.transform(searched, lambda w: w["word"])))
    usable = F.filter(cut, lambda w: F.length(w).between(LEAST_LETTERS, MOST_LETTERS))
    known = F.slice(F.array_except(usable, stops), 1, MOST_TERMS[mode])
    out = out.withColumn("_own", own).withColumn("_ignored", F.array_intersect(usable, stops)).withColumn("_known", known)
    plain: Column = F.array_except(F.array_except(text.ascii_terms(body), stops), F.col("_known"))
    terms = F.concat(
        F.transform("_known", lambda w: F.when(F.array_contains("_own", w), _term(w, OWN_SCORE, "own_word")).otherwise(_term(w, KNOWN_SCORE, "word"))),
        F.transform(plain, lambda w: _term(w, PLAIN_SCORE, "letters")),
    )
    out = out.withColumn("terms", F.slice(terms, 1, MOST_TERMS[mode]))
    windows = F.slice(F.array_except(unstopped_windows(body, list(stopwords)), F.transform("terms", lambda t: t["text"])), 1, MOST_WINDOWS[mode])
    if mode == "query":
        windows = F.when(F.size("_known") >= 2, F.array().cast("array<string>")).otherwise(windows)
    return out.select(key, "terms", windows.alias("windows"), F.col("_ignored").alias("ignored"))


def _term(word: Column, score: float, source: str) -> Column:
    return F.struct(word.alias("text"), F.lit(score).alias("score"), F.lit(source).alias("source"))
