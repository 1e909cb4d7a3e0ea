"""Keyed tables in storage: upserts, patches and deletions that rewrite the partitions they touch and no others.

A stored table is a folder of Parquet files partitioned by a bucket, a hash of its key. A change names its keys, so Spark
knows its buckets; only these are read (by partition pruning), merged by an equi-join on the key, written to a staging table and
put in their place by dynamic partition overwrite. All other files stay as they are. A change that is lost on the way
is applied again whole: the same change twice gives the same table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.storage import discard, shared_dir, written

#: Name of the partition column; buckets of a table that is made without a number.
BUCKET, BUCKETS = "lodestream_bucket", 64


def point_id(*parts: Column) -> Column:
    """An id that follows from what it names: the SHA-256 of the parts, in the form of a UUID."""
    h = F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


class StoredTable:
    """A folder with rows that are known by key, a row a key."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    @classmethod
    def create(cls, rows: DataFrame, key: str, buckets: int = BUCKETS, path: str | None = None) -> StoredTable:
        """A new table of rows; of rows with one key the last in the order of all columns stays."""
        path = path or f"{shared_dir(rows.sparkSession)}/stored-{uuid.uuid4().hex}"
        out = cls(rows.sparkSession, path, key, buckets)
        out._put(out._with_bucket(out._once(rows)).repartition(min(buckets, 200), BUCKET), "errorifexists")
        return out

    def rows(self) -> DataFrame:
        return self._read().drop(BUCKET)

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace those of the same key or are added. Returns the number of rewritten buckets."""
        new = self._once(rows)
        return self._change(new.select(self.key), lambda old: old.join(new.select(self.key), self.key, "left_anti").unionByName(new.select(*old.columns)))

    def patch(self, delta: DataFrame, fields: list[str]) -> int:
        """Fields that delta (key, fields) has replace those of stored rows; null fields and unknown keys change nothing."""
        own = self._once(delta).select(self.key, *[F.col(f).alias(f"new_{f}") for f in fields])

        def merge(old: DataFrame) -> DataFrame:
            both = old.join(own, self.key, "left")
            return both.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns])

        return self._change(own.select(self.key), merge)

    def delete(self, keys: DataFrame) -> int:
        """Rows of these keys go."""
        gone = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        return self._change(gone, lambda old: old.join(gone, self.key, "left_anti"))

    def _read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, self._bucket())

    def _once(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c != self.key]
        if not others:
            return rows.where(F.col(self.key).isNotNull()).distinct()
        return rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(*others)).alias("row")).select(self.key, "row.*").select(*rows.columns)

    def _change(self, keys: DataFrame, merge) -> int:
        touched = sorted(r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect())  # as many as there are buckets at most
        if not touched:
            return 0
        old = self._read().where(F.col(BUCKET).isin(touched))
        after = written(self._with_bucket(merge(old.drop(BUCKET))))
        left = {r[0] for r in after.select(BUCKET).distinct().collect()}
        if left:
            self._put(after.repartition(len(left), BUCKET), "overwrite")
        for b in set(touched) - left:  # a bucket that has lost its last row
            self._remove(f"{self.path}/{BUCKET}={b}")
        discard(after)
        return len(touched)

    def _put(self, rows: DataFrame, mode: str) -> None:
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
