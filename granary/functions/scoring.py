"""Scores, weights and times as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of a hit by what was searched.
SCOPE_WEIGHTS = {"default": 1.00, "question": 0.96, "answer": 0.94, "summary": 0.90, "doc_summary": 0.72, "keyword": 0.76, "row": 0.92, "row_group": 0.88, "row_fragment": 0.84, "page_body": 0.88}
TABLE_SCOPE_WEIGHTS = {"row": 1.0, "row_group": 0.94, "row_fragment": 0.9, "summary": 0.82, "default": 0.84}
OTHER_SCOPE = 0.82


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def scope_weights(kind: str = "document", query_weight: float = 1.0, answer_weight: float = 0.0) -> dict[str, float]:
    """Weights by scope for a kind of collection: document, table or qa."""
    weights = dict(SCOPE_WEIGHTS)
    if kind == "table":
        weights |= TABLE_SCOPE_WEIGHTS
    if kind == "qa":
        most = max(query_weight, answer_weight, 0.0001)
        weights["question"] *= query_weight / most
        weights["answer"] *= max(0.0, answer_weight) / most
    return weights


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def effective_boost(vector: Column, lexical: Column, vector_weight: float, lexical_weight: float, scope_weight: Column, boost: Column) -> Column:
    """A tag boost of at most .1, halved for weak hits and dropped for very weak ones."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(0.10), boost))
    meaning = (F.greatest(F.lit(0.0), vector) * vector_weight + F.greatest(F.lit(0.0), lexical) * lexical_weight) * scope_weight
    return F.when(meaning < 0.20, 0.0).when(meaning < 0.35, F.round(clamped * 0.5, 4)).otherwise(F.round(clamped, 4))


def group_score(vector: Column, lexical: Column, vector_weight: float, lexical_weight: float, scope_weight: Column, scopes: Column, backends: Column, bonus: Column, boost: Column) -> Column:
    """Weighted best scores of a group, with bounded bonuses for scopes, backends and repeats."""
    v, k = F.coalesce(vector, F.lit(0.0)), F.coalesce(lexical, F.lit(0.0))
    weighted = F.greatest(F.lit(0.0), v) * vector_weight + F.greatest(F.lit(0.0), k) * lexical_weight
    coverage = F.least(F.lit(0.12), F.greatest(F.lit(0), scopes - 1) * 0.03) + F.when(backends >= 2, 0.05).otherwise(0.0)
    total = F.least(F.lit(0.20), coverage + bonus + effective_boost(v, k, vector_weight, lexical_weight, scope_weight, boost))
    return F.least(F.lit(1.0), weighted * scope_weight + total)


def repeated_hit_bonus(scope: Column, hits: Column) -> Column:
    """For the nth hit of one scope in a group."""
    return F.when(scope == "answer", F.least(F.lit(0.08), (hits - 1) * 0.02)).when(scope == "row_fragment", F.least(F.lit(0.05), (hits - 1) * 0.015)).otherwise(0.0)


def intent_bonus(kind: Column, scope: Column, traits: Column, n_terms: Column) -> Column:
    """Small additions where the query's traits ask for a scope."""
    qa, tab = kind == "qa", kind == "table"
    return (
        F.when(qa & (scope == "question") & traits["question_like"], 0.035)
        .when(qa & (scope == "answer") & traits["answer_like"], 0.03)
        .when(qa & (scope == "question") & traits["short_query"], 0.015)
        .when(tab & (scope == "row") & traits["table_like"], 0.035)
        .when(tab & (scope == "row_group") & traits["table_like"], 0.025)
        .when(tab & (scope == "row_fragment") & (n_terms >= 3), 0.02)
        .otherwise(0.0)
    )


def metadata_bonus(query_terms: Column, text: Column) -> Column:
    """A hundredth for each query term in the projected metadata, at most four."""
    return F.least(F.lit(0.04), F.size(F.filter(query_terms, lambda t: F.contains(F.lower(text), t))) * 0.01)


def distance_decay(distance: Column) -> Column:
    """Weight of a tag by how many folders up it was set."""
    return F.when(distance <= 0, 1.0).when(distance == 1, 0.75).when(distance == 2, 0.55).otherwise(F.greatest(F.lit(0.30), F.pow(F.lit(0.75), distance)))


def signal_weight(source: Column) -> Column:
    return F.when(source == "llm", 1.0).when(source == "alias", 0.90).otherwise(0.95)


def topology(has_parent: Column, has_children: Column) -> Column:
    return F.when(~has_parent & ~has_children, "root_leaf").when(~has_parent, "root").when(~has_children, "leaf").otherwise("intermediate")


def group_key(scope: Column, content_group: Column, parent: Column, chunk: Column) -> Column:
    """What hits are drawn together by: the document for summaries, else the content group, the parent, the chunk."""
    return F.when(scope == "doc_summary", F.concat(F.lit("doc:"), chunk)).otherwise(F.coalesce(F.concat(F.lit("group:"), content_group), F.concat(F.lit("parent:"), parent), F.concat(F.lit("chunk:"), chunk)))


def folder_ids(path: Column) -> Column:
    """Ids in a dotted folder path, without their prefixes."""
    parts = F.filter(F.split(path, r"\."), lambda p: p.startswith("f_"))
    return F.transform(parts, lambda p: F.substring(p, F.lit(3), F.length(p)))


# Fixed value: what windows of ideographs are worth in a rank.
FALLBACK_WEIGHT = 0.08


def weighted_terms(text: Column, tokens: Column, strict: list[str], loose: list[str], phrases: list[tuple[str, float]], words: list[tuple[str, float]]) -> Column:
    """A lexical rank: all strict tokens, any loose tokens (by the share found), and boosts for up to three phrases and terms."""
    found = lambda wanted: F.size(F.array_intersect(tokens, F.array(*map(F.lit, wanted)).cast("array<string>")))
    score = F.when(F.lit(bool(strict)) & (found(strict) == len(strict)), 0.72).otherwise(0.0)
    score = score + found(loose) / max(1, len(loose)) * 0.28
    boosts = [(p, w * x) for (p, w), x in zip(phrases, (0.9, 0.45, 0.25), strict=False)] + [(t, w * x) for (t, w), x in zip(words, (0.08, 0.04, 0.03), strict=False)]
    return reduce(lambda s, b: s + F.when(F.contains(F.lower(text), F.lit(b[0].lower())), b[1]).otherwise(0.0), boosts, score)


def next_trigger(kind: Column, base: Column, now: Column, every: Column, unit: Column, run_time: Column, weekday: Column, month_day: Column, zone: str = "UTC") -> Column:
    """When a schedule fires next, in UTC: interval, once, daily, weekly (1 Monday) or monthly; null for manual and past ones."""
    local = F.from_utc_timestamp(now, zone)
    minutes = F.when(unit == "minute", every).when(unit == "hour", every * 60).when(unit == "day", every * 1440).otherwise(every * 10080)
    at = lambda day: F.to_timestamp(F.concat_ws(" ", day.cast("string"), run_time), "yyyy-MM-dd HH:mm")
    today = F.to_date(local)
    daily = F.when(at(today) > local, at(today)).otherwise(at(F.date_add(today, 1)))
    ahead = F.pmod(weekday - 1 - F.weekday(today), F.lit(7))
    this_week = at(F.date_add(today, ahead.cast("int")))
    weekly = F.when(this_week > local, this_week).otherwise(at(F.date_add(today, (ahead + 7).cast("int"))))
    of_month = lambda first: at(F.date_add(first, (F.least(month_day, F.day(F.last_day(first))) - 1).cast("int")))
    first = F.trunc(today, "month")
    monthly = F.when(of_month(first) > local, of_month(first)).otherwise(of_month(F.add_months(first, 1)))
    in_zone = F.when(kind == "daily", daily).when(kind == "weekly", weekly).when(kind == "monthly", monthly)
    return F.when(kind == "interval", F.timestamp_add("MINUTE", minutes, base)).when((kind == "once") & (base > now), base).otherwise(F.to_utc_timestamp(in_zone, zone))
