"""A kept lexical index: an inverted index on disk that is built once, changed in part and read by partition.

Postings (a row for each token of each unit) lie by generation and by bucket, the token's hash; units (their lowered text and
content hash) by generation and by the key's hash. A change writes a new generation: the postings and units of rows that are new
or whose content differs, and a row for each key that it touches, deleted ones included. What an older generation says of such
a key no longer counts. `compacted` draws all that counts into one new generation.

A generation counts once its row in `commits` is written, the last thing that a change does: a change that fails half way leaves
nothing that anyone reads, and the next one writes over it. Two changes at once end with an error in the second to commit. A
search reads only the buckets of its tokens, and joins them with all queries at once by equality.

Keys are the columns `KEYS`; a null key or a text without tokens is not indexed. Rows that repeat a key count once, the one with
the greatest text. Generations to read are collected to the driver: as many as there were changes since it was compacted last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text

KEYS = ("unit_id", "scope")
# Weights of all words, of the share of words found, of two-letter windows, and of up to three phrases and terms.
ALL_WORDS, ANY_WORDS, ANY_WINDOWS = 0.72, 0.28, 0.08
PHRASE_WEIGHTS, TERM_WEIGHTS = (0.9, 0.45, 0.25), (0.08, 0.04, 0.03)

_KEY_SCHEMA = "unit_id long, scope string"
_SCHEMAS = {
    "postings": f"{_KEY_SCHEMA}, token string, generation int, bucket int",
    "units": f"{_KEY_SCHEMA}, body string, content_hash string, generation int, bucket int",
    "changes": f"{_KEY_SCHEMA}, generation int",
    "commits": "base boolean, generation int",
}
_BOOST = "array<struct<text string, weight double>>"


class LexicalIndex:
    """An index in the folder `path`; `buckets` must stay the same for its life."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    # Reading

    def generations(self) -> list[int]:
        """The committed generations from the last compacted one on."""
        rows = self._table("commits").collect() if self._exists("commits") else []
        base = max((r.generation for r in rows if r.base), default=0)
        return sorted(r.generation for r in rows if r.generation >= base)

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def _live(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a table that no later generation says otherwise of."""
        kept = self.generations()
        if not kept:
            return self.spark.createDataFrame([], _SCHEMAS[name])
        rows = self._table(name).filter(F.col("generation").isin(kept))
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        if len(kept) == 1:
            return rows
        later = self._table("changes").filter(F.col("generation").isin(kept[1:])).select(*(F.col(k).alias(f"_{k}") for k in KEYS), F.col("generation").alias("_later"))
        same = [F.col(k) == F.col(f"_{k}") for k in KEYS]
        return rows.join(later, [*same, F.col("_later") > F.col("generation")], "left_anti")

    def units(self) -> DataFrame:
        """unit_id, scope, body, content_hash of all that is indexed."""
        return self._live("units").select(*KEYS, "body", "content_hash")

    def postings(self, tokens: DataFrame | None = None) -> DataFrame:
        """token, unit_id, scope of all that is indexed, or of the tokens in `tokens`: only their buckets are read."""
        if tokens is None:
            return self._live("postings").select("token", *KEYS)
        wanted = tokens.select("token").distinct()
        buckets = [r[0] for r in wanted.select(self._bucket("token")).distinct().collect()]  # no more than there are buckets
        return self._live("postings", buckets).join(wanted, "token", "left_semi").select("token", *KEYS)

    # Changing

    def _bucket(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, name: str, generation: int, *order: str) -> None:
        # Rebalanced: a bucket that is too large for one task goes to several tasks and files, and rows are made once, without a sample of ranges before.
        rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/generation={generation}")

    def _commit(self, generation: int, base: bool) -> None:
        self.spark.createDataFrame([(base,)], "base boolean").write.mode("errorifexists").parquet(f"{self.path}/commits/generation={generation}")

    def _next(self) -> int:
        return max(self.generations(), default=0) + 1

    def _write_units(self, units: DataFrame, generation: int) -> DataFrame:
        """Writes units (with body and content_hash) and their postings; returns the units as written."""
        self._write(units.withColumn("bucket", self._bucket(*KEYS)), "units", generation, *KEYS)
        written = self._table("units").filter(F.col("generation") == generation).select(*KEYS, "body")
        tokens = F.explode(F.array_union(text.lexical_tokens("body"), text.cjk_terms("body")))
        self._write(written.select(*KEYS, tokens.alias("token")).withColumn("bucket", self._bucket("token")), "postings", generation, "token", *KEYS)
        return written

    def upsert(self, rows: DataFrame) -> int | None:
        """Indexes rows (unit_id, scope, text) that are new or whose content is another; the number of the generation, None if nothing changed."""
        body = F.lower(F.trim(F.coalesce(F.col("text"), F.lit(""))))
        new = rows.select(F.col("unit_id").cast("long").alias("unit_id"), F.col("scope").cast("string").alias("scope"), body.alias("body"))
        new = new.filter("unit_id is not null and scope is not null").groupBy(*KEYS).agg(F.max("body").alias("body"))
        new = new.withColumn("content_hash", F.sha2("body", 256))
        generation = self._next()
        if self.generations():
            known = self._live("units").select(*KEYS, F.col("content_hash").alias("_hash"))
            new = new.join(known, list(KEYS), "left").filter(~F.col("content_hash").eqNullSafe(F.col("_hash"))).drop("_hash")
        written = self._write_units(new, generation)
        if written.isEmpty():
            return None
        written.select(*KEYS).write.mode("overwrite").parquet(f"{self.path}/changes/generation={generation}")
        self._commit(generation, False)
        return generation

    def delete(self, keys: DataFrame) -> int | None:
        """Takes rows (unit_id, scope) out; keys that aren't there don't count."""
        gone = keys.select(*KEYS).distinct().join(self._live("units").select(*KEYS), list(KEYS), "left_semi")
        generation = self._next()
        gone.write.mode("overwrite").parquet(f"{self.path}/changes/generation={generation}")
        if self._table("changes").filter(F.col("generation") == generation).isEmpty():
            return None
        self._commit(generation, False)
        return generation

    def compacted(self) -> int:
        """Writes all that counts as one generation; earlier ones are no longer read, `cleaned` removes them."""
        generation = self._next()
        live = self._live("units").select(*KEYS, "body", "content_hash").withColumn("bucket", self._bucket(*KEYS))
        self._write(live, "units", generation, *KEYS)
        self._write(self._live("postings").select(*KEYS, "token", "bucket"), "postings", generation, "token", *KEYS)
        self._commit(generation, True)
        return generation

    def cleaned(self) -> None:
        """Deletes the files of generations that were compacted; for when no search that began before runs any more."""
        least = min(self.generations(), default=0)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for name in ("postings", "units", "changes", "commits"):
            if self._exists(name):
                folder = hadoop.Path(f"{self.path}/{name}")
                files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
                for found in files.listStatus(folder):
                    part = found.getPath().getName()
                    if part.startswith("generation=") and int(part.split("=")[1]) < least:
                        files.delete(found.getPath(), True)

    # Searching

    def search(self, plans: DataFrame, k: int) -> DataFrame:
        """query_id, unit_id, scope, score, rank: the k highest of each query in `query_plans` rows; ties by key.

        A unit is found by any word. Only units that could still be among the k highest with all boosts are read as texts."""
        tokens = plans.select("query_id", F.explode(F.array_distinct(F.concat("words", "windows"))).alias("token"))
        met = self.postings(tokens).join(tokens, "token").join(plans.select("query_id", "words", "windows"), "query_id")
        hits = met.groupBy("query_id", *KEYS).agg(F.count(F.when(F.array_contains("words", F.col("token")), 1)).alias("found"), F.count(F.when(F.array_contains("windows", F.col("token")), 1)).alias("seen"))
        hits = hits.join(plans.withColumn("most", F.aggregate(F.concat("phrases", "terms"), F.lit(0.0), lambda s, b: s + b["weight"])), "query_id")
        base = F.when(F.col("found") == F.size("words"), ALL_WORDS).otherwise(0.0) + F.col("found") / F.greatest(F.size("words"), F.lit(1)) * ANY_WORDS
        base = base + F.when(F.size("windows") > 0, ANY_WINDOWS * F.col("seen") / F.size("windows")).otherwise(0.0)
        hits = hits.withColumn("base", base)
        best = Window.partitionBy("query_id").orderBy(F.desc("base"), *KEYS)
        kth = hits.select("query_id", "base", *KEYS).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
        kth = kth.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("base")).otherwise(0.0).alias("least"))
        near = hits.join(kth, "query_id").filter(F.col("base") + F.col("most") >= F.col("least"))
        read = near.join(self.units().select(*KEYS, "body"), list(KEYS))
        boosts = F.aggregate(F.concat("phrases", "terms"), F.lit(0.0), lambda s, b: s + F.when(F.contains(F.col("body"), b["text"]), b["weight"]).otherwise(0.0))
        scored = read.select("query_id", *KEYS, F.round(text.lexical_score(F.col("base") + boosts), 4).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), *KEYS)
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _boosts(texts: Column, weights: tuple[float, ...]) -> Column:
    shares = F.array(*map(F.lit, weights))
    return F.transform(F.slice(texts, 1, len(weights)), lambda t, i: F.struct(t.alias("text"), F.get(shares, i).alias("weight"))).cast(_BOOST)


def query_plans(queries: DataFrame, stopwords: list[str] = (), body: str = "text") -> DataFrame:
    """query_id, words, windows, phrases, terms of queries (query_id, text, and optional arrays favoured_phrases and favoured_terms).

    Words of favoured texts are sought, too; the favoured phrases are boosted before the whole query. Queries without words are left out."""
    array = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in queries.columns else F.array().cast("array<string>")
    normal = lambda c: F.filter(F.array_distinct(F.transform(array(c), text.normalize_lexical)), lambda t: t != "")
    stops = F.array(*map(F.lit, stopwords)).cast("array<string>")
    whole = F.array_join(F.filter(F.split(text.normalize_lexical(body), " "), lambda w: ~F.array_contains(stops, w)), " ")
    rows = queries.select("query_id", whole.alias("whole"), normal("favoured_phrases").alias("fp"), normal("favoured_terms").alias("ft")).filter("whole <> ''")
    phrases = F.array_distinct(F.concat("fp", F.filter(F.array("whole"), lambda p: F.length(p) >= 2)))
    everything = F.concat_ws(" ", "whole", F.array_join("fp", " "), F.array_join("ft", " "))
    rows = rows.withColumn("words", F.array_remove(F.array_distinct(F.split(everything, " ")), ""))
    windows = F.array_except(F.filter(text.cjk_terms("whole"), lambda w: ~F.array_contains(stops, w)), F.array_union("words", F.array_union("fp", "ft")))
    return rows.select("query_id", "words", windows.alias("windows"), _boosts(phrases, PHRASE_WEIGHTS).alias("phrases"), _boosts(F.col("ft"), TERM_WEIGHTS).alias("terms"))
