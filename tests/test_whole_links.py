"""Links and duplicates of all records against brute force."""

import numpy as np

from lodestream.operators import dense
from lodestream.plans import catalog


def test_every_record_is_linked_and_reconciled(spark, sf, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_BYTES", 100_000)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(x @ x.T, 9)
    np.fill_diagonal(score, -9)
    expected = {int(i): int(min(20, (s >= 0.1).sum())) for i, s in zip(ids, score)}
    assert {r.id: r.evidence_count for r in catalog.QUERIES["f1_linker"](spark, sf).collect()} == expected
    best = [(s.max(), min(ids[s == s.max()])) for s in score]
    pairs = {tuple(sorted((int(i), int(j)))) for i, (s, j) in zip(ids, best) if s >= 0.25}
    assert any(a % 100 and b % 100 for a, b in pairs)
    assert {(r.a, r.b) for r in catalog.QUERIES["f2_j13_reconciler"](spark, sf).collect()} == pairs
