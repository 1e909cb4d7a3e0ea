"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline as pipeline
from lodestream.llm import decontam, jaccard, quality, secrets
from lodestream.llm.common import read_table, written


def test_stages(spark, sf):
    docs = read_table(spark, sf, "documents")
    labels, items = read_table(spark, sf, "labels"), read_table(spark, sf, "benchmark")
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "jaccard_join", "decontamination", "secret_scan", "source_mixing"]
    for name, stage in pipeline.STAGES:
        out = written(stage(spark, docs, sf))
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        if name == "quality_classifier":
            assert after == {r.doc_id for r in quality.score(docs, labels).where("predicted = 1").collect()}
            good = {r.doc_id for r in labels.where("quality = 1").collect()}
            assert len(good - after) <= 0.02 * len(good)
        elif name == "jaccard_join":
            assert after == {r.doc_id for r in jaccard.join(docs).where("doc_id = component_id").collect()}
        elif name == "decontamination":
            assert before - after == {r.doc_id for r in decontam.overlaps(docs, items).collect()}
        elif name == "secret_scan":
            assert after == before and secrets.digest(out).where("n_assign + n_access + n_hex > 0").count() == 0
        else:
            assert after == before and out.where("rate < 0").count() == 0
        if name != "source_mixing":
            assert out.columns == docs.columns
        docs = out


def test_run(spark, sf):
    got = pipeline.run(spark, sf)
    assert got.count() == got.select("doc_id").distinct().count() > 0
