"""Joins of tables that grow with the input are never broadcast, however small Spark takes them to be."""

import pytest
from pyspark.sql import functions as F

from lodestream.operators import entities, simhash
from lodestream.sources import connectors


@pytest.fixture
def plans(spark, monkeypatch):
    """The final plans, as text, of all tables that are written while a test runs."""
    from pyspark.sql import DataFrameWriter

    seen, put = [], DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return put(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return seen


def planned(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_alias_tiers(spark):
    people = spark.range(300).select(F.col("id").alias("person"), F.concat(F.lit("Anna B"), "id").alias("name"), F.concat(F.lit("u"), "id", F.lit("@example.org")).alias("email"))
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.concat(F.lit("U"), "id").alias("name"))
    custom = spark.range(0, 300, 10).select(F.concat(F.lit("u"), "id").alias("alias"), F.lit(-1).cast("long").alias("person"))
    out = entities.alias_tiers(asked, custom, people)
    assert "Broadcast" not in planned(out)
    assert {r.query_id: r.person for r in out.collect()} == {k: -1 if k % 10 == 0 else k for k in range(300)}


def test_greedy_dedup_and_components(spark, plans):
    """With rounds by joins and a chain that is replayed."""
    rows = [(k, k, f) for k, f in enumerate([1, 1, 3, 7, 0x3F, 0xFF, 0xFFF, 0xFFFF, 0x3FFFF, 0xFF << 40, 0xFF << 40])]
    out = simhash.keep_greedily(spark.createDataFrame(rows, "id long, doc long, fingerprint long"), rounds=1)
    assert [r.kept for r in out.orderBy("id").collect()] == [True, False, False, False, True, False, True, True, False, True, False]
    assert len(plans) > 5 and not [p for p in plans if "Broadcast" in p]


def test_rich_text(spark, plans):
    """Shallow trees need neither a join nor a table of their own; of deep ones no level is broadcast."""
    issue = '{"key":"A-%d","fields":{"summary":"s","description":DOC}}'
    page = '{"id":"%d","title":"t","blocks":[BLOCK]}'
    doc, block = '{"type":"paragraph","content":[{"type":"text","text":"told"}]}', '{"type":"quote","text":"so"}'
    for _ in range(2):
        raws = {"jira": issue.replace("DOC", doc), "notion": page.replace("BLOCK", block)}
        for kind, end in (("jira", "told\n"), ("notion", "> so")):
            out = connectors.read(kind, spark.createDataFrame([(raws[kind] % k,) for k in range(3)], "value string"))
            assert "Broadcast" not in planned(out)
            assert all(r.content.endswith(end) for r in out.collect()) and out.count() == 3
        if "told" in doc and len(doc) < 100:
            assert len(plans) == 2 and "Join" not in planned(out)  # what is looked for are deep trees
        for _ in range(8):
            doc, block = '{"type":"list","content":[%s]}' % doc, '{"type":"","children":[%s]}' % block if block.count("children") < 4 else block
        block = '{"type":"child","children":[%s]}' % block.replace("so", "far") + "," + '{"type":"quote","text":"so"}'
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]
