"""Streams drained to tables, held against the same result in one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.registry import query
from granary.sources.scratch import scratch_path
from granary.sources.tables import table
from granary.streaming import events as streams
from granary.streaming import state


@query("WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the event stream, of windows that the watermark has closed."""
    return streams.drained(streams.counts_by_window(streams.stream_of(spark, sf_dir, "events")), "hourly")


@query("SELECT DISTINCT user_id, date_trunc('minute', ts) AS minute FROM events")
def stream_minute_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run for each user and minute. The table comes in one batch, in order, so that no event is later than a day."""
    return streams.drained(streams.one_a_minute(streams.stream_of(spark, sf_dir, "events"), "1 day"), "minutes")


@query(
    """SELECT page_id AS key, sha256(html) AS hash, 1::BIGINT AS version FROM pages UNION ALL SELECT page_id, sha256(html || '<!-- 2 -->'), 2 FROM pages WHERE page_id % 3 = 0
    UNION ALL SELECT page_id, sha256(html), 3 FROM pages WHERE page_id % 6 = 0 UNION ALL SELECT page_id + 1000000, sha256(html), 1 FROM pages WHERE page_id % 5 = 0"""
)
def stream_page_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of pages by content, from a stream that stops after each batch and goes on from its checkpoint: first all pages,
    then changed, unchanged and new ones, then some that change back. The last batch comes twice."""
    inbox, checkpoint, out = (scratch_path(spark, f"versions-{x}") for x in ("inbox", "offsets", "table"))
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    new = pages.filter("page_id % 5 = 0").withColumn("page_id", F.col("page_id") + 1_000_000)
    changed = pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("<!-- 2 -->"))).otherwise(F.col("html")))
    back = pages.filter("page_id % 6 = 0 or page_id % 3 = 1")
    for seen, batch in ((1, pages), (2, changed.unionByName(new)), (3, back), (3, back)):
        batch.withColumn("seen", F.lit(seen)).write.mode("append").parquet(inbox)
        arrived = state.state_session(spark).readStream.schema(pages.withColumn("seen", F.lit(0)).schema).parquet(inbox)
        streams.continued(state.page_versions(arrived, "page_id", "html", "seen"), checkpoint, out)
    return spark.read.parquet(out).select("key", "hash", "version")


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS limiter, (epoch_us(ts) // 1000) AS at_ms, event_type || '-' || event_id % 3 AS id, CASE WHEN value < 60 THEN 'give' ELSE 'take' END AS action, (event_id % 2)::VARCHAR AS scope FROM events),
    k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY limiter ORDER BY at_ms, id, action, scope) AS n FROM e WHERE at_ms <= (SELECT max((epoch_us(ts) // 1000)) FROM events) - 86400000),
    r AS (SELECT DISTINCT limiter, 0::BIGINT AS n, 0::BIGINT AS at_ms, '' AS id, '' AS action, '' AS scope, [{'id': '', 'scope': '', 'expires': 0::BIGINT}] AS held, '' AS answer FROM k
      UNION ALL SELECT limiter, n, at_ms, id, action, scope, CASE WHEN answer = 'returned' THEN list_filter(alive, lambda x: x.id <> id) WHEN answer = 'granted' THEN list_append(alive, {'id': id, 'scope': scope, 'expires': at_ms + 43200000}) ELSE alive END, answer FROM (
        SELECT *, CASE WHEN action = 'give' THEN CASE WHEN mine > 0 THEN 'returned' ELSE 'unknown' END WHEN mine > 0 THEN 'held' WHEN len(alive) < 3 AND len(list_filter(alive, lambda x: x.scope = scope)) < 2 THEN 'granted' ELSE 'refused' END AS answer FROM (
          SELECT *, len(list_filter(alive, lambda x: x.id = id)) AS mine FROM (
            SELECT k.*, list_filter(r.held, lambda x: x.expires > k.at_ms) AS alive FROM r JOIN k ON k.limiter = r.limiter AND k.n = r.n + 1))))
    SELECT limiter, at_ms AS at, id, action, scope, answer, len(held)::INT AS held FROM r WHERE n > 0"""
)
def stream_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases of each user's limiter: at most three at once and two of a scope, for twelve hours, unless they are given back."""
    events = streams.stream_of(state.state_session(spark), sf_dir, "events")
    id_ = F.concat_ws("-", "event_type", (F.col("event_id") % 3).cast("string"))
    acts = events.select("user_id", "ts", id_.alias("lease"), F.when(F.col("value") < 60, "give").otherwise("take").alias("action"), (F.col("event_id") % 2).alias("scope"))
    answers = state.leases(acts, "user_id", "ts", "lease", "action", "scope", 3, 12 * 3_600_000, "1 day", most_of_scope=2)
    return streams.drained(answers, "leases")


@query(
    """WITH RECURSIVE k AS MATERIALIZED (SELECT user_id || ':' || event_type AS arguments, (epoch_us(ts) // 1000) AS at_ms, event_id::VARCHAR AS id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (epoch_us(ts) // 1000), event_id::VARCHAR) AS n
      FROM events WHERE (epoch_us(ts) // 1000) <= (SELECT max((epoch_us(ts) // 1000)) FROM events) - 86400000),
    r AS (SELECT arguments, n, at_ms, id, false AS hit, at_ms AS made FROM k WHERE n = 1
      UNION ALL SELECT k.arguments, k.n, k.at_ms, k.id, k.at_ms < r.made + 172800000, CASE WHEN k.at_ms < r.made + 172800000 THEN r.made ELSE k.at_ms END FROM r JOIN k ON k.arguments = r.arguments AND k.n = r.n + 1)
    SELECT arguments, at_ms AS at, id, hit, made FROM r"""
)
def stream_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that find a result made less than two days before, and those that make one."""
    events = streams.stream_of(state.state_session(spark), sf_dir, "events")
    calls = events.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("arguments"), "ts", "event_id")
    return streams.drained(state.memo(calls, "arguments", "ts", "event_id", 2 * 86_400_000, "1 day"), "memo")


@query(
    """WITH p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
    b AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM p),
    w AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM b GROUP BY user_id, s)
    SELECT * FROM w WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the event stream that the watermark has closed."""
    closed = streams.drained(streams.sessions(streams.stream_of(spark, sf_dir, "events")), "sessions")
    return closed.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
