"""Line deduplication by how many different sites a line stands on.

Each line's hash gets a HyperLogLog sketch of the sites (sources) of the documents that have it; sketches merge by
aggregation. A line whose estimate is clearly at or above the threshold is boilerplate, one clearly below is not, and
the few near the threshold get an exact distinct count. Of a boilerplate line one copy stays, the first by doc_id, so
that nothing vanishes from the corpus; all others are cut out.

A line is what lies between line feeds, without blanks at its ends; lines of fewer than `least_words` words are left
alone, as they recur by chance. A null source is a site of its own. Null texts have no lines and stay null; empty texts
stay empty. A text all of whose lines are cut becomes empty; no document is dropped. Rows with equal doc_id and text are
treated alike. Extra columns are not read. Lines are told apart by hashes of 64 bits: two lines with one hash, of which a
billion different ones hold about 0.03 pairs, would count as one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import DOCUMENT_COLUMNS, WORD, null_safe, stored, table


@dataclass(frozen=True)
class Spread:
    """A line on at least `sites` sites is boilerplate; `band` is the relative error within which sites are counted."""

    sites: int = 3
    least_words: int = 5
    log_registers: int = 8
    band: float = 0.35


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _lines(docs: DataFrame, spread: Spread) -> DataFrame:
    """A row for each line that counts: doc_id, tie (hash of the text), site, place, line (its hash)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), null_safe("source").alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("place", "raw"))
    many = F.col("raw").rlike(rf"^(?:[\x20\x09-\x0D]*+{WORD}+){{{spread.least_words}}}")
    return rows.filter(many).select("doc_id", "tie", "site", "place", F.xxhash64(trimmed(F.col("raw"))).alias("line"))


def boilerplate(lines: DataFrame, spread: Spread) -> DataFrame:
    """The hashes of lines on at least `sites` sites: line, sites (estimated, or exact near the threshold)."""
    sketches = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(spread.log_registers)).alias("sketch"))
    spreads = sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= spread.sites * (1 - spread.band))
    spreads = stored(spreads, "lines-spread")
    sure = F.col("sites") > spread.sites * (1 + spread.band)
    near = spreads.filter(~sure).select("line")
    exact = lines.join(near, "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("sites")).filter(F.col("sites") >= spread.sites)
    return spreads.filter(sure).unionByName(exact)


def dedup_lines(docs: DataFrame, spread: Spread = Spread()) -> DataFrame:
    """The documents' columns with text cut, and n_lines, n_removed."""
    lines = stored(_lines(docs, spread), "lines")
    # Written before it is grouped by line again: a join may be split where one line is hot, an aggregate's input may not.
    found = stored(lines.select("line", "doc_id", "tie", "place").join(boilerplate(lines, spread).select("line"), "line"), "lines-found")
    first = found.groupBy("line").agg(F.min(F.struct("doc_id", "tie", "place")).alias("first")).select("first.*", F.lit(True).alias("stays"))
    places = found.select("doc_id", "tie", "place", F.lit(False).alias("stays")).unionByName(first).groupBy("doc_id", "tie")
    cut = places.agg(F.array_except(F.collect_set("place"), F.collect_set(F.when(F.col("stays"), F.col("place")))).alias("cut")).filter(F.size("cut") > 0)
    keyed = docs.select(*DOCUMENT_COLUMNS).withColumn("tie", F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.tie") == F.col("c.tie"))
    joined = keyed.join(cut.alias("c"), same, "left").select("d.*", "cut")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("cut", i)), "\n")
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    out = joined.select("doc_id", text.alias("text"), "lang", "source", n_lines.alias("n_lines"), F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_removed"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP10_SQL = r"""
WITH raw AS (SELECT doc_id, text, coalesce('=' || source, 'null') AS site, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, text, site, unnest(range(len(parts))) AS place, unnest(parts) AS raw FROM raw WHERE text IS NOT NULL),
t AS (SELECT doc_id, text, site, place, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l
      WHERE len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) >= 5),
b AS (SELECT line FROM t GROUP BY line HAVING count(DISTINCT site) >= 3),
f AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS n FROM t SEMI JOIN b USING (line)),
c AS (SELECT doc_id, list(place) AS cut FROM f WHERE n > 1 GROUP BY doc_id)
SELECT raw.doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(len(cut), 0)::BIGINT AS n_removed,
  CASE WHEN cut IS NULL THEN text ELSE array_to_string(list_filter(parts, lambda x, i: NOT list_contains(cut, i - 1)), chr(10)) END AS text
FROM raw LEFT JOIN c USING (doc_id)
"""
