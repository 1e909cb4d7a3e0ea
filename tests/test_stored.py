"""Stored tables: what a change touches, and what it leaves as it is."""

import pathlib

from pyspark.sql import functions as F

from lodestream.operators import stored


def files(path):
    return {str(p.relative_to(path)) for p in pathlib.Path(path).rglob("*.parquet")}


def test_changes_rewrite_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.range(5_000).select("id", F.concat(F.lit("v"), "id").alias("v"), F.lit(0).alias("n"))
    t = stored.StoredTable.create(base, "id", 40, path)
    expected = {r.id: (r.v, r.n) for r in base.collect()}
    before = files(path)
    delta = spark.createDataFrame([(7, "new", 1), (7, "newer", 1), (9_999, "added", 2), (None, "no key", 3)], "id long, v string, n int")
    assert t.upsert(delta) == 2 == len({f.split("/")[0] for f in before - files(path)})
    assert t.upsert(delta) == 2  # again: the same table
    expected |= {7: ("newer", 1), 9_999: ("added", 2)}
    assert {r.id: (r.v, r.n) for r in t.rows().collect()} == expected and t.rows().columns == base.columns
    before = files(path)
    assert t.patch(spark.createDataFrame([(8, None, 5), (70_000, "unknown", 5)], "id long, v string, n int"), ["v", "n"]) == 2
    expected[8] = ("v8", 5)
    assert t.delete(spark.createDataFrame([(11,), (12,), (80_000,)], "id long")) <= 3
    del expected[11], expected[12]
    assert {r.id: (r.v, r.n) for r in t.rows().collect()} == expected
    assert len({f.split("/")[0] for f in before - files(path)}) <= 5 and before & files(path)
    assert t.upsert(delta.limit(0)) == 0 and t.delete(delta.where("id is null").select("id")) == 0


def test_a_bucket_that_is_emptied(spark, tmp_path):
    t = stored.StoredTable.create(spark.range(3).select("id", F.lit("x").alias("v")), "id", 50, str(tmp_path / "t"))
    t.delete(spark.range(2))
    assert [r.id for r in t.rows().collect()] == [2]
    t.upsert(spark.range(1).select("id", F.lit("y").alias("v")))
    assert sorted((r.id, r.v) for r in t.rows().collect()) == [(0, "y"), (2, "x")]


def test_point_ids_follow_from_their_parts(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a,1", None)], "doc string, n int").select(stored.point_id(F.col("doc"), F.col("n")).alias("p")).collect()
    assert rows[0].p == rows[1].p and len({r.p for r in rows}) == 3 and all(len(r.p) == 36 for r in rows)
