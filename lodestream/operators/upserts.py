"""Writes as whole-table steps: change detection, versions, keyed merges, deletions, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detect_changes(incoming: DataFrame, stored: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """incoming with content_hash and change: new, updated or unchanged against stored (keys, content_hash)."""
    old = stored.select(*keys, F.col("content_hash").alias("old_hash"))
    h = F.sha2(F.coalesce(F.col(content), F.lit("")), 256)
    both = incoming.withColumn("content_hash", h).join(old, keys, "left")
    return both.withColumn("change", F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") != F.col("content_hash"), "updated").otherwise("unchanged")).drop("old_hash")


def versions(history: DataFrame, key: str, when: str, content_hash: str = "content_hash") -> DataFrame:
    """Rows of a history whose hash differs from the one before, numbered from 1 for each key."""
    w = Window.partitionBy(key).orderBy(when)
    before = F.lag(content_hash).over(w)
    changed = history.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(content_hash))).drop("before")
    return changed.withColumn("version", F.row_number().over(w))


def insert_new(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not stored yet, once each."""
    return rows.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def delete_keys(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(*keys).distinct(), keys, "left_anti")


def add_up(stored: DataFrame, delta: DataFrame, keys: list[str], sums: list[str], latest: str) -> DataFrame:
    """Counters of both added by key; latest is the one that delta brings, if any."""
    both = stored.withColumn("o", F.lit(0)).unionByName(delta.withColumn("o", F.lit(1)))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.max(F.struct("o", latest))[latest].alias(latest))


def patch(stored: DataFrame, delta: DataFrame, key: str, fields: list[str], tags: str | None = None) -> DataFrame:
    """stored with the fields that delta has for its key; tags are united, so appending one twice changes nothing."""
    new = delta.select(key, *[F.col(f).alias(f"new_{f}") for f in fields], *([F.col(tags).alias("new_tags")] if tags else []))
    both = stored.join(new, key, "left")
    for f in fields:
        both = both.withColumn(f, F.coalesce(f"new_{f}", f))
    if tags:
        both = both.withColumn(tags, F.when(F.col("new_tags").isNull(), F.col(tags)).otherwise(F.array_union(F.coalesce(tags, F.array().cast("array<string>")), "new_tags")))
    return both.select(*stored.columns)


def touch(last: Column, now: Column, seconds: int = 60) -> Column:
    """now where there was no touch, or one longer than seconds ago."""
    return F.when(last.isNull() | (last < now - F.make_dt_interval(secs=F.lit(seconds))), now).otherwise(last)


def unexpired(df: DataFrame, expires: str, now: Column, grace_days: int = 0) -> DataFrame:
    """Rows without an expiry, or whose expiry and grace lie ahead."""
    return df.where(F.col(expires).isNull() | (F.col(expires) + F.make_dt_interval(days=F.lit(grace_days)) >= now))


RETENTION = {"24h": 24, "7d": 7 * 24, "30d": 30 * 24, "forever": None}


def expiry(created: Column, policy: str) -> Column:
    """When an event of a retention policy expires; null if never."""
    hours = RETENTION[policy]
    return F.lit(None).cast("timestamp") if hours is None else created + F.make_dt_interval(hours=F.lit(hours))
