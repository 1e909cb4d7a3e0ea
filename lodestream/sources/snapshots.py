"""Snapshots of record tables: written as gzip JSON lines with a manifest, verified, restored, compared."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(records: DataFrame) -> tuple[int, str]:
    """(rows, digest): the digest is the same for the same rows in any order."""
    line = F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"})
    h = records.select(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))
    r = h.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("a"), F.lit(0)).alias("a"), F.coalesce(F.sum(F.col("b") % 1_000_003), F.lit(0)).alias("b")).first()
    return r.n, f"{r.a & (2**64 - 1):016x}{r.b & (2**64 - 1):016x}"


def create(records: DataFrame, path: str, label: str) -> dict:
    """Write records under path/data and what they are under path/manifest; returns the manifest."""
    records.write.mode("overwrite").json(f"{path}/data", compression="gzip", ignoreNullFields=False)
    n, digest = fingerprint(records)
    manifest = {"label": label, "record_count": n, "content_hash": digest, "schema": records.schema.json()}
    records.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The records of a snapshot; fails if they are not those that were written."""
    from pyspark.sql.types import StructType

    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    records = spark.read.schema(StructType.fromJson(json.loads(manifest["schema"]))).json(f"{path}/data")
    if fingerprint(records) != (manifest["record_count"], manifest["content_hash"]):
        raise ValueError(f"the snapshot {path} was changed")
    return records


def diff(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, removed or changed. Of rows with one key the one of greatest content counts."""
    one = lambda df, name: df.groupBy(key).agg(F.max(content).alias(name), F.lit(True).alias(f"in_{name}"))
    both = one(before, "a").join(one(after, "b"), key, "full")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def replace_agent(stored: DataFrame, restored: DataFrame, agent: str) -> DataFrame:
    """stored with all rows of an agent replaced by the restored ones."""
    return stored.where(~F.col("agent_id").eqNullSafe(F.lit(agent))).unionByName(restored.where(F.col("agent_id") == agent))
