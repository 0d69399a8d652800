"""Streams of events: counts by window, one run a minute, and sessions' counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.scratch import scratch_path


def stream_of(spark: SparkSession, sf_dir: str, name: str, files_a_batch: int = 8) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{sf_dir}/{name}.parquet*")


def continued(stream: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """Writes what is new in a stream's source to the table `out`, from where the checkpoint stands; the whole table."""
    writer = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint)
    writer.format("parquet").option("path", out).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream writes until its source has nothing left: a table in the scratch folder."""
    return continued(stream, scratch_path(stream.sparkSession, f"offsets-{name}"), scratch_path(stream.sparkSession, f"stream-{name}"))


def counts_by_window(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their sum by type and tumbling window; windows close `late` after the newest event."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def one_a_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first event of each user and minute; others of the same key within the watermark go."""
    keyed = events.withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp")).withWatermark("minute", late)
    return keyed.dropDuplicatesWithinWatermark(["user_id", "minute"]).select("user_id", F.col("minute").cast("timestamp_ntz").alias("minute"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of a user's events with no gap longer than `gap`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
