"""Corpus pipeline: quality, near duplicates, benchmark leaks, secrets, source mix."""

from __future__ import annotations

from lodestream.llm import decontam, jaccard, mixing, quality, secrets
from lodestream.llm.common import discard, read_table, written


def classify(spark, docs, sf_dir):
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def one_of_each(spark, docs, sf_dir):
    """One document, that of least doc_id, of each group of near duplicates."""
    return jaccard.keep_first(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact(spark, docs, sf_dir):
    """All documents, with secrets in their texts replaced by their kinds."""
    return secrets.redact(docs)


def mix(spark, docs, sf_dir):
    """doc_id, source, n_tokens, posteriors, rate and copies of all documents."""
    return mixing.mix(docs, read_table(spark, sf_dir, "labels"), targets={"low": 0.0, "good": 0.98, "toxic": 0.02})


STAGES = [("quality_classifier", classify), ("jaccard_join", one_of_each), ("decontamination", decontaminate), ("secret_scan", redact), ("source_mixing", mix)]
#: Classifiers and the least-squares fit have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
