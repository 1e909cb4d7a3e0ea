"""Streams: deduplicated appends, daily counts, windows, sessions, jobs in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """New files of a folder, as they come."""
    return spark.readStream.schema(schema).parquet(path)


def once_each(events: DataFrame, key: str = "event_id", when: str = "ts", late: str = "1 hour") -> DataFrame:
    """Appends that are idempotent by key, as far as rows are not later than late."""
    return events.withWatermark(when, late).dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, when: str = "ts", late: str = "1 day") -> DataFrame:
    w = F.window(F.col(when), "1 day")
    return events.withWatermark(when, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def windows(events: DataFrame, length: str, slide: str | None = None, when: str = "ts", late: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling or sliding window."""
    w = F.window(F.col(when), length, slide or length)
    return events.withWatermark(when, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "4 hours", when: str = "ts", late: str = "1 day") -> DataFrame:
    """A user's events that follow each other within gap: what a cache with a time to live that each touch extends would hold."""
    return events.withWatermark(when, late).groupBy("user_id", F.session_window(F.col(when), gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def cached_records(records: DataFrame, extensions: DataFrame, ttl: str = "4 hours") -> DataFrame:
    """session, record, cached_at, expires of each record of a cache whose entries live for ttl.

    records: session, record, at (a later write starts the time anew); extensions: session, at; each gives every record
    of its session that is still alive ttl from then on. Extensions that follow each other within ttl are one session window, so a
    record joins one row or none: the window that begins before the record ends and has an extension after it was written.
    """
    last = records.groupBy("session", "record").agg(F.max("at").alias("cached_at")).withColumn("ends", F.col("cached_at") + F.expr(f"interval {ttl}"))
    kept = extensions.groupBy("session", F.session_window("at", ttl).alias("w")).agg(F.max("at").alias("last")).select(F.col("session").alias("own"), F.col("w.start").alias("first"), "last", F.col("w.end").alias("until"))
    alive = (F.col("session") == F.col("own")) & (F.col("first") < F.col("ends")) & (F.col("last") > F.col("cached_at"))
    return last.join(kept, alive, "left").select("session", "record", "cached_at", F.coalesce("until", "ends").alias("expires"))


def run_jobs(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Work on queued jobs in micro-batches: at least once by the checkpoint, exactly once in the output by the batch's own folder."""

    def step(batch: DataFrame, n: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return jobs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(stream: DataFrame, out: str, checkpoint: str):
    """All that is there now, appended to a Parquet table."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
