"""Lexical recall: a query becomes a plan of strict, loose and fallback tokens with weighted terms and phrases."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import scoring, text

_MARKS = str.maketrans(dict.fromkeys(text.LEXICAL_PUNCTUATION, " "))
_TERM = re.compile(r"[A-Za-z0-9][A-Za-z0-9_./:-]*")
_IDEOGRAPHS = re.compile(r"[㐀-䶿一-鿿]+")
MOST_WEIGHTED = 3


@dataclass(frozen=True)
class QueryPlan:
    """Words that must all be there, words of which any may be, two-letter windows that also recall, and boosts."""

    text: str = ""
    strict: tuple[str, ...] = ()
    loose: tuple[str, ...] = ()
    fallback: tuple[str, ...] = ()
    terms: tuple[tuple[str, float], ...] = ()
    phrases: tuple[tuple[str, float], ...] = ()


def plain(s: str) -> str:
    """A query's own text as the index has it."""
    return " ".join(str(s or "").lower().translate(_MARKS).split())


def distinct(items) -> list[str]:
    return list(dict.fromkeys(x for x in map(plain, items) if x))


def merged_stopwords(*lists) -> list[str]:
    """Stopwords of several sources, each once, in order; lines that are comments don't count."""
    return list(dict.fromkeys(w for words in lists for w in (str(x).strip().lower() for x in words or ()) if w and not w.startswith("#")))


def windows(s: str, stopwords: list[str]) -> list[str]:
    """Runs of ideographs that aren't stopwords, and their two-letter windows that touch none."""
    out = []
    for run in _IDEOGRAPHS.findall(plain(s)):
        if len(run) < 2:
            continue
        spans = [(m.start(), m.start() + len(w)) for w in stopwords for m in re.finditer(f"(?={re.escape(w)})", run)]
        out += [run] if run not in stopwords else []
        out += [run[i : i + 2] for i in range(len(run) - 1) if len(run) > 2 and not any(i < e and i + 2 > b for b, e in spans)]
    return list(dict.fromkeys(out))


def lexical_query(raw: str, rewritten: str = "", synonyms: list[tuple[str, list[str]]] = (), stopwords: list[str] = ()) -> str:
    """Distinct words of the rewritten and the raw query, then synonyms (standard term, at most six expansions), without stopwords."""
    words = [w for source in (rewritten, raw) for w in str(source).split()]
    words += [w for term, more in synonyms for w in (term, *list(more)[:6])]
    first = {}
    for w in words:
        first.setdefault(w.strip().lower(), w.strip())
    return " ".join(w for key, w in first.items() if key and key not in set(stopwords))


def priority_hints(matches: list[dict], glossary: list[str], most_terms: int = 12, most_phrases: int = 8) -> tuple[list[str], list[str], dict[str, float]]:
    """Terms and phrases to favour, and their weights, from matched lexicon items and glossary terms.

    A match counts under its term and under what the query has of it; a glossary term of four letters is a phrase, too."""
    terms: dict[str, float] = {}
    phrases: dict[str, None] = {}
    for m in matches:
        for word in dict.fromkeys((m["term"], m["matched_text"])):
            terms[word] = max(terms.get(word, 0.0), m["weight"])
            if m.get("is_phrase"):
                phrases[word] = None
    for word in (g for g in glossary if len(g) >= 2):
        terms.setdefault(word, 1.0)
        if len(word) >= 4:
            phrases[word] = None
    return list(terms)[:most_terms], list(phrases)[:most_phrases], terms


def query_plan(query: str, priority_terms=(), priority_phrases=(), synonyms=(), glossary=(), stopwords=(), weights: dict[str, float] | None = None) -> QueryPlan:
    """How a query is recalled: its phrase, favoured phrases, favoured and own terms must all be there (or any of them,
    for less); windows of ideographs recall for less still. Stopwords go first."""
    stops, weights = distinct(stopwords), weights or {}
    whole = plain(" ".join(w for w in plain(query).split() if w not in stops))
    if not whole:
        return QueryPlan()
    phrases = distinct([*([whole] if len(whole) >= 2 else []), *priority_phrases])
    favoured = distinct([*priority_terms, *glossary])
    own = [t for t in (m.strip(".:/-_") for m in _TERM.findall(whole)) if len(t) >= 2]
    aliases = distinct(synonyms)
    words = dict.fromkeys(w for t in [*phrases, *favoured, *own, *aliases] for w in t.split())
    known = {*phrases, *favoured, *own, *aliases}
    first = [p for p in phrases if p in set(distinct(priority_phrases)) and p != whole]
    ranked = [*first, *(p for p in phrases if p not in first)]
    weigh = lambda items: tuple((x, float(weights.get(x, 1.0))) for x in items[:MOST_WEIGHTED])
    return QueryPlan(whole, tuple(words), tuple(words), tuple(w for w in windows(whole, stops) if w not in known), weigh(list(dict.fromkeys([*favoured, *aliases]))), weigh(ranked))


def recall(rows: DataFrame, plan: QueryPlan, k: int, body: str = "text", tie: str = "doc_id") -> DataFrame:
    """The k rows that rank highest. A row's tokens are made once, behind a generator, for the test and for the rank."""
    if not plan.text:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    tokens = F.array_union(text.lexical_tokens(body), text.cjk_terms(body)) if plan.fallback else text.lexical_tokens(body)
    once = rows.select("*", F.explode(F.array(F.struct(tokens.alias("tokens"), F.lower(body).alias("lowered")))).alias("_x"))
    found = F.array(*map(F.lit, dict.fromkeys([*plan.loose, *plan.strict, *plan.fallback]))).cast("array<string>")
    hits = once.filter(F.arrays_overlap("_x.tokens", found))
    raw = scoring.weighted_terms(F.col("_x.lowered"), F.col("_x.tokens"), list(plan.strict), list(plan.loose), list(plan.phrases), list(plan.terms))
    if plan.fallback:
        shared = F.size(F.array_intersect(F.col("_x.tokens"), F.array(*map(F.lit, plan.fallback)).cast("array<string>")))
        raw = raw + scoring.FALLBACK_WEIGHT * shared / len(plan.fallback)
    return hits.withColumn("score", F.round(text.lexical_score(raw), 4)).drop("_x").orderBy(F.desc("score"), tie).limit(k)


def unstopped_windows(c: Column | str, stopwords: list[str]) -> Column:
    """Runs of ideographs and two-letter windows of a text column, without stopwords and windows that touch one."""
    runs = F.filter(F.regexp_extract_all(text.normalize_lexical(c), F.lit(r"([㐀-䶿一-鿿]+)"), F.lit(1)), lambda r: F.length(r) >= 2)
    stops = F.array(*map(F.lit, stopwords)).cast("array<string>")

    def near(run: Column, i: Column, w: Column) -> Column:
        begin = F.greatest(F.lit(1), i - F.length(w) + 1)
        return F.contains(F.substring(run, begin, i + F.length(w) - begin + 1), w)

    def of_run(run: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.length(run) - 1), lambda i: (F.length(run) > 2) & ~F.exists(stops, lambda w: near(run, i, w)))
        whole = F.when(F.array_contains(stops, run), F.array().cast("array<string>")).otherwise(F.array(run))
        return F.concat(whole, F.transform(at, lambda i: F.substring(run, i, F.lit(2))))

    return F.array_distinct(F.flatten(F.transform(runs, of_run)))
