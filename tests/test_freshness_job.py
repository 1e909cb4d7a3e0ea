"""The freshness job stage by stage against a loop over records."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from lodestream.functions.text import keywords
from lodestream.operators import lifecycle

NOW = dt.datetime(2024, 2, 1)
SCHEMA = "id long, agent_id string, vector array<float>, content string, status string, tags array<string>, updated_at timestamp, valid_until timestamp, superseded_by long, freshness_score double, last_freshness_run_at timestamp"


def rows():
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((12, 8))
    out = []
    for k in range(150):
        v = centre[k % 12] + 0.25 * rng.standard_normal(8)
        status = ["active", "candidate", "review_needed", "archived", None][k % 5]
        out.append((k, f"agent{k % 2}", v.astype(np.float32).tolist() if k % 17 else None, f"note about topic{k % 12}", status, ["old"] if k % 3 == 0 else [], NOW - dt.timedelta(days=int(k % 40)), NOW - dt.timedelta(days=1) if k % 11 == 0 else None, 5 if k % 13 == 0 else None, 0.5, None))
    return out


def by_hand(records, linked, duplicate, most=20):
    x = {r[0]: np.array(r[2]) / np.linalg.norm(r[2]) for r in records if r[2]}
    agent = {r[0]: r[1] for r in records}
    evidence, pairs, after = {}, {}, {}
    for r in records:
        hits = sorted(((-round(float(x[r[0]] @ x[o]), 9), o) for o in x if o != r[0] and agent[o] == r[1]) if r[0] in x else [])[:most]
        hits = [(-s, o) for s, o in hits if -s >= linked]
        evidence[r[0]] = len(hits)
        if hits and hits[0][0] >= duplicate:
            pairs[tuple(sorted((r[0], hits[0][1])))] = True
        status, tags = r[4], list(r[5])
        if r[7] and r[7] <= NOW:
            status = "archived"
        elif r[8]:
            status = "superseded"
        elif r[6] <= NOW - dt.timedelta(days=30):
            status = "stale"
        if status == "candidate" and evidence[r[0]] >= 1:
            status = "active"
            tags += ["auto_curated"]
        after[r[0]] = (status, evidence[r[0]], tags, status in ("active", "review_needed", "candidate"))
    return after, set(pairs)


def test_job_equals_a_loop(spark):
    records = rows()
    df = spark.createDataFrame(records, SCHEMA)
    words = {r.id: r.k for r in df.select("id", F.array_join(keywords(F.col("content")), ",").alias("k")).collect()}
    hand, pairs = by_hand(records, 0.6, 0.85)
    assert len({h[0] for h in hand.values()}) >= 6 and pairs and any("auto_curated" in h[2] for h in hand.values())
    for confidence, sure in ((0.55, False), (0.9, True)):
        after, links, reviews = lifecycle.job(df, F.lit(NOW), confidence=confidence)
        got = {r.id: (r.status, r.evidence_count, r.tags, r.outcome) for r in after.collect()}
        expected = {i: (s, n, t + ([words[i]] if sure and d and words[i] else []), ("applied" if sure else "review") if d else None) for i, (s, n, t, d) in hand.items()}
        assert got == expected
        found = reviews.collect()
        assert {(r.target_id, r.related_id) for r in found if r.reason == "possible_duplicate"} == pairs
        assert sorted(r.target_id for r in found if r.reason != "possible_duplicate") == sorted(i for i, h in hand.items() if h[3] and not sure)
        assert links.count() == sum(h[1] for h in hand.values())
    by_index, _, _ = lifecycle.job(df, F.lit(NOW), exact_rows=0, recall=1.0)
    assert abs(sum(r.evidence_count for r in by_index.collect()) - sum(h[1] for h in hand.values())) <= 0.05 * sum(h[1] for h in hand.values())
