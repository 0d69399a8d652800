"""Functions that expressions can't say, and the registries through which chunkers and scorers are found by name."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import text
from granary.operators import chunking, lexical, page_elements, retrieval
from granary.sources import files

CHUNKERS: dict[str, Callable[..., Column]] = {
    "fixed": lambda c, size=500, overlap=50: F.transform(chunking.windows(c, size, overlap), lambda x: x["content"]),
    "sentence": lambda c, size=600, overlap=1: chunking.sentence_chunks(c, size, overlap),
    "recursive": lambda c, size=400, overlap=0: chunking.recursive_chunks(c, size),
    "paragraph": lambda c, size=120, overlap=0: chunking.paragraph_chunks(c, size, overlap),
}


class Registry:
    """Things found by name: parsers, enhancers, search backends, analyzers. One of them is the default."""

    def __init__(self, kind: str, default: str | None = None):
        self.kind, self.default, self._known = kind, default, {}

    def register(self, name: str, thing: Callable) -> Callable:
        self._known[name] = thing
        return thing

    def get(self, name: str | None = None) -> Callable:
        key = name or self.default
        if key not in self._known:
            raise ValueError(f"no {self.kind} {key}; there are {sorted(self._known)}")
        return self._known[key]


PARSERS, ENHANCERS = Registry("parser"), Registry("enhancer")
VECTOR_BACKENDS, LEXICAL_BACKENDS, ANALYZERS = Registry("vector backend", "exact"), Registry("lexical backend", "tokens"), Registry("analyzer", "rules")
VECTOR_BACKENDS.register("exact", retrieval.vector_recall)
LEXICAL_BACKENDS.register("tokens", lexical.recall)
ANALYZERS.register("rules", lexical.query_plan)
PARSERS.register("delimited", files.read_delimited)
PARSERS.register("page", page_elements.page_sections)
ENHANCERS.register("keywords", text.keywords)
ENHANCERS.register("questions", text.questions)


def register_chunker(name: str, chunker: Callable[..., Column]) -> None:
    """A chunker takes a column and gives an array of texts."""
    CHUNKERS[name] = chunker


def chunked(df: DataFrame, body: str, strategy: str, **options: int) -> DataFrame:
    if strategy not in CHUNKERS:
        raise ValueError(f"no chunker {strategy}; there are {sorted(CHUNKERS)}")
    return df.select("*", F.posexplode(CHUNKERS[strategy](F.col(body), **options)).alias("position", "content"))


def replace_longest(c: Column, terms: dict[str, str]) -> Column:
    """Each dictionary term in the text replaced, the longest at each place, in one pass: what was put in isn't looked at again."""
    if not terms:
        return c
    pattern = re.compile("|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))))

    @F.pandas_udf(T.StringType())
    def replaced(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pattern.sub(lambda m: terms[m.group()], t), na_action="ignore")

    return replaced(c)


def replace_own(c: Column, terms: Column, also: dict[str, str]) -> Column:
    """As `replace_longest`, with the terms of each row's own map and those that are for all."""

    @F.pandas_udf(T.StringType())
    def replaced(texts: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for text_, found in zip(texts, own, strict=True):
            known = {**also, **dict(found if found is not None else {})}
            # A single pattern a row: few terms are in one text.
            here = sorted((t for t in known if text_ is not None and t in text_), key=lambda t: (-len(t), t))
            out.append(text_ if text_ is None or not here else re.sub("|".join(map(re.escape, here)), lambda m, known=known: known[m.group()], text_))
        return pd.Series(out, dtype=object)

    return replaced(c, terms)


def stopword_hits(c: Column, stopwords: list[str], most: int = 80) -> Column:
    """Stopwords found in the text, longest first at each place, without overlap."""
    pattern = "(" + "|".join(re.escape(s) for s in sorted(set(stopwords), key=lambda s: (-len(s), s))) + ")"
    return F.slice(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), 1, most)


#: Rows whose texts are taken out of a batch at once.
MOST_EMBEDDED = 256


def embed(df: DataFrame, body: str, dimensions: int = 64) -> DataFrame:
    """Adds a vector of hashed words of length 1: a stand-in for a model, the same at every run."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        # By slices of a batch, so that few texts are Python's at once.
        for batch in (b.slice(at, MOST_EMBEDDED) for b in batches for at in range(0, b.num_rows, MOST_EMBEDDED)):
            rows = np.zeros((batch.num_rows, dimensions))
            for row, text in zip(rows, batch.column(body), strict=True):
                for word in (text.as_py() or "").lower().split():
                    h = zlib.crc32(word.encode())
                    row[h % dimensions] += 1.0 if h >> 31 else -1.0
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
            places = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dimensions)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(places, pa.array(rows.ravel()))], names=[*batch.schema.names, "vector"])

    return df.mapInArrow(vectors, T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))]))


_FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def cron_fields(expression: str) -> list[set[int]]:
    """Minutes, hours, days of the month, months and days of the week (0 and 7: Sunday) of a cron expression."""
    parts = expression.split()
    if len(parts) != 5:
        raise ValueError(f"not a cron expression: {expression}")
    out = []
    for part, (low, high) in zip(parts, _FIELDS, strict=True):
        found: set[int] = set()
        for item in part.split(","):
            span, _, step = item.partition("/")
            first, _, last = span.partition("-")
            a, b = (low, high) if span == "*" else (int(first), int(last or (high if step else first)))
            if not low <= a <= b <= high:
                raise ValueError(f"not a cron field: {part}")
            found |= set(range(a, b + 1, int(step or 1)))
        out.append(found)
    out[4] = {d % 7 for d in out[4]}
    return out


def next_cron(expression: str, after: datetime) -> datetime | None:
    """The first minute after a time at which a cron expression fires, within five years. Where both days are given, either will do."""
    minutes, hours, days, months, weekdays = cron_fields(expression)
    any_day, any_weekday = (x == "*" for x in (expression.split()[2], expression.split()[4]))
    day = after.replace(hour=0, minute=0, second=0, microsecond=0)
    for _ in range(5 * 366):
        by_date, by_week = day.day in days, (day.isoweekday() % 7) in weekdays
        fits = by_date and by_week if any_day or any_weekday else by_date or by_week
        if day.month in months and fits:
            for h in sorted(hours):
                for m in sorted(minutes):
                    if (at := day.replace(hour=h, minute=m)) > after:
                        return at
        day += timedelta(days=1)
    return None


def next_cron_trigger(expression: Column, after: Column) -> Column:
    """next_cron of each row, in the times' own zone; null for a null expression."""

    @F.pandas_udf(T.TimestampNTZType())
    def fires(expressions: pd.Series, times: pd.Series) -> pd.Series:
        found = [next_cron(e, t.to_pydatetime()) if e is not None and t is not pd.NaT else None for e, t in zip(expressions, times, strict=True)]
        return pd.Series(pd.to_datetime(found)).astype("datetime64[us]")

    return fires(expression, after.cast("timestamp_ntz"))


def register_all(spark: SparkSession) -> None:
    """SQL names for functions that have none of their own: fixed_chunks(text, size, overlap), windows of a text, for LATERAL."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION fixed_chunks(body STRING, size INT, overlap INT) RETURNS TABLE (position INT, content STRING)
        RETURN SELECT p, substring(body, p * (size - overlap) + 1, size) FROM (SELECT explode(IF(length(body) > 0, sequence(0, CAST((length(body) - 1) DIV (size - overlap) AS INT)), CAST(array() AS ARRAY<INT>))) AS p)"""
    )
