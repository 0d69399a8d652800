"""Rule chains: what is enhanced, what summaries are kept, how candidates of a query are judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import any_of, ascii_terms, cjk_terms, col, collapse, let, mixed_units, numeric_density


def enhancement(content: Column, kind: Column, is_leaf: Column, least: int = 40, most: int = 2000, most_numeric: float = 0.45) -> Column:
    """eligible and the reason of the first rule that speaks: not a leaf, empty, tables, short, long, mostly numbers."""
    n = mixed_units(content)
    reason = F.when(~F.coalesce(is_leaf, F.lit(True)), "not_leaf").when(collapse(col(content)) == "", "empty").when(kind.isin("table", "row"), "table").when(n < least, "short").when(n > most, "long").when(numeric_density(content) > most_numeric, "numeric")
    return F.struct(reason.isNull().alias("eligible"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def usable_summary(c: Column | str, excluded: tuple[str, ...] = (), most: int = 1200) -> Column:
    """A document's summary if it says enough: 24 characters, 8 units, 3 different terms, none of the excluded phrases; cut to `most`."""

    def judged(text: Column) -> Column:
        terms = F.size(F.array_union(ascii_terms(text), cjk_terms(text)))
        bad = any_of(F.lower(text), tuple(map(str.lower, excluded))) if excluded else F.lit(False)
        return F.when(~bad & (F.length(text) >= 24) & (mixed_units(text) >= 8) & (terms >= 3), F.substring(text, 1, most))

    return let(collapse(col(c)), judged)


def candidate_status(confidence: Column, evidence: Column, conflicts: Column, allowed: Column, least: float = 0.5) -> Column:
    """accepted, or why not: no value of the field, an explicit filter says otherwise, no evidence in the query, too unsure."""
    return F.when(~F.coalesce(allowed, F.lit(False)), "invalid_value").when(F.coalesce(conflicts, F.lit(False)), "conflict").when(F.coalesce(evidence, F.lit("")) == "", "no_evidence").when(confidence < least, "low_confidence").otherwise("accepted")


def first_evidence(value: Column, *texts: tuple[str, Column]) -> Column:
    """The name of the first text that contains the value."""
    return F.coalesce(*(F.when(F.contains(F.lower(t), F.lower(value)), name) for name, t in texts))


def upgraded(candidates: DataFrame, target: str, confidence: str, tie: str, least: float, most: int) -> DataFrame:
    """The surest candidate of each target above a threshold, the surest `most` of all."""
    first = F.row_number().over(Window.partitionBy(target).orderBy(F.desc(confidence), tie))
    best = candidates.filter(F.col(confidence) >= least).withColumn("_n", first).filter("_n = 1").drop("_n")
    return best.orderBy(F.desc(confidence), tie).limit(most)


def merged_lists(explicit: Column, inherited: Column) -> Column:
    """An explicit list if it has anything, else the inherited one."""
    return F.when(F.size(F.coalesce(explicit, F.array().cast("array<string>"))) > 0, explicit).otherwise(inherited)


def merged_maps(inherited: Column, explicit: Column) -> Column:
    """Both maps, the explicit one's values where both have a key."""
    kept = F.map_filter(inherited, lambda k, _: ~F.map_contains_key(explicit, k))
    return F.map_concat(kept, explicit)


def merged_config(*layers: dict) -> dict:
    """Nested settings, later layers over earlier ones, key by key."""
    out: dict = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
