"""Connectors as a data source: pages, cursors, pushed filters, streams that are resumed."""

import json

import pytest
from pyspark.sql import functions as F

from lodestream.sources import connectors, datasource

OBJECTS = {
    "jira": lambda k: {"key": f"J-{k}", "fields": {"summary": "s", "updated": f"2024-01-{k:02d}T00:00:00.000+0000"}},
    "confluence": lambda k: {"id": str(k), "title": "t", "body": {"storage": {"value": "<p>x</p>"}}, "version": {"when": f"2024-01-{k:02d}T00:00:00Z"}},
    "notion": lambda k: {"id": str(k), "title": "t", "blocks": [], "last_edited_time": f"2024-01-{k:02d}T00:00:00Z"},
    "github": lambda k: {"number": k, "title": "t", "repository": "r", "updated_at": f"2024-01-{k:02d}T00:00:00Z"},
    "gdrive": lambda k: {"id": str(k), "name": "t", "text": "x", "modifiedTime": f"2024-01-{k:02d}T00:00:00Z"},
}


def page(folder, name, objects):
    (folder / "pages").mkdir(exist_ok=True)
    (folder / "pages" / name).write_text("\n".join(json.dumps(o) for o in objects))


@pytest.mark.parametrize("kind", ["jira", "gdrive"])
def test_batches_by_cursor(spark, tmp_path, kind):
    """The next sync begins after the last; a cursor is kept by the caller; an empty source has none."""
    at = {"path": str(tmp_path / "pages")}
    docs, cursor = datasource.sync(spark, kind, at)
    assert docs.count() == 0 and cursor == ""
    page(tmp_path, "a.json", [OBJECTS[kind](k) for k in range(1, 6)])
    page(tmp_path, "b.json", [OBJECTS[kind](k) for k in range(6, 10)])
    docs, cursor = datasource.sync(spark, kind, at)
    page(tmp_path, "c.json", [OBJECTS[kind](11)])  # comes after the sync has begun
    assert docs.count() == 9 and docs.columns == connectors.COLUMNS
    later, end = datasource.sync(spark, kind, at, cursor)
    assert later.count() == 1 and end != cursor and datasource.sync(spark, kind, at, end)[0].count() == 0
    newer, _ = datasource.sync(spark, kind, at, since="2024-01-08 00:00:00")
    assert sorted(r.updated_at.day for r in newer.collect()) == [9, 11]


def test_filters_reach_the_reader(spark, tmp_path):
    """The plan has no filter of its own left, and objects without a time are not newer than any."""
    page(tmp_path, "a.json", [OBJECTS["github"](k) for k in range(1, 9)] + [{"number": 99}])
    datasource.register(spark)
    load = lambda: spark.read.format(datasource.FORMAT).options(connector="github", path=str(tmp_path / "pages")).load()
    newer = load().where(F.col("updated_at") > F.lit("2024-01-05").cast("timestamp")).select("value")
    plan = newer._jdf.queryExecution().executedPlan().toString()
    assert newer.count() == 3 and load().count() == 9 and "updated_at" not in plan.split("BatchScan")[0].replace("isnotnull(updated_at", "")
    with pytest.raises(Exception, match="no connector is called"):
        spark.read.format(datasource.FORMAT).options(connector="fax", path="x").load().count()


def test_stream_goes_on_from_its_cursor(spark, tmp_path):
    """Each page is read once, over restarts; broken lines give no document."""
    at, out, state = {"path": str(tmp_path / "pages")}, str(tmp_path / "out"), str(tmp_path / "state")
    page(tmp_path, "a.json", [OBJECTS["gdrive"](k) for k in range(1, 4)])
    datasource.follow(spark, "gdrive", at, out, state).awaitTermination()
    page(tmp_path, "b.json", [OBJECTS["gdrive"](k) for k in range(4, 6)])
    (tmp_path / "pages" / "c.json").write_text("{broken\n\n" + json.dumps(OBJECTS["gdrive"](7)))
    for _ in range(2):
        datasource.follow(spark, "gdrive", at, out, state).awaitTermination()
    got = spark.read.parquet(out).select("source_id", "batch").collect()
    assert sorted(r.source_id for r in got) == ["1", "2", "3", "4", "5", "7"]
    assert {r.batch for r in got if int(r.source_id) < 4}.isdisjoint({r.batch for r in got if int(r.source_id) > 3})
