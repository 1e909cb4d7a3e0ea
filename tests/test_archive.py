"""Archives: every entry once, shards and manifest, and nothing of a job that fails."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from lodestream.sources import archive


def test_entries_come_back_once(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = [(f"w/documents/d{k}.md", "é" * k if k % 7 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "name string, content string").repartition(3)
    manifest = archive.export(df, path, note="all of it", shard_bytes=20_000)
    assert manifest["entries"] == 300 and len(manifest["shards"]) > 3 and manifest["note"] == "all of it"
    assert sorted(p.name for p in pathlib.Path(path).iterdir()) == sorted(["manifest.json", *[s["file"] for s in manifest["shards"]]])
    assert sorted(map(tuple, archive.read(spark, path).collect())) == sorted((n, c or "") for n, c in rows)
    again = archive.export(df.limit(5), path)  # replaces the old one
    assert again["entries"] == 5 == archive.read(spark, path).count() and json.loads((tmp_path / "a" / "manifest.json").read_text()) == again
    assert archive.export(df.limit(0), path)["entries"] == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = tmp_path / "b"
    rows = spark.range(100).repartition(4).select(F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") < 99, F.lit("x")).otherwise(F.raise_error(F.lit("broken"))).alias("content"))
    with pytest.raises(Exception, match="broken"):
        archive.export(rows, str(path))
    assert not path.exists() or list(path.iterdir()) == []
