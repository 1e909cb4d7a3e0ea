"""Registered plans against their SQL at the smallest scale."""

import datetime
import math

import duckdb
import pytest

from lodestream.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "None"
    v = v.item() if hasattr(v, "item") else v
    return repr(round(v, 6)) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.datetime) else str(v)


#: One plan a family keeps the suite short; the driver compares them all.
NAMES = [
    "t1_sentences", "t2_token_estimates", "t7_shingles", "t9_keyword_tokens", "t15_title_entities", "t20_keywords", "t27_slugs", "d1_dates_in_text", "d2_date_ranges", "r2_sparse_search", "r3_hybrid_search", "r4_adaptive_hybrid",
    "m4_m5_signal_scores", "m9_retrieval_metrics", "t8_simhash", "j8_near_pairs", "t6b_fixed_width", "w1_change_detection", "w2_n8_versions", "w6_fetch_stats", "g1_u2_aliases", "g2_relationships", "r8_graph_channel", "r9_pagerank",
    "r10_channel_merge", "r11_fast_search", "m6_k6_final_ranking", "u6_m3_overlap_and_k", "t32_split_texts", "d3_dates_between", "f1_linker", "e1_memory_search", "e2_e9_saves", "e8_j19_reviews", "f2_j13_reconciler", "f3_monitor", "a5_a6_daily_growth", "a9_time_savings", "a10_cost_summary", "j17_w17_snapshot_diff", "x1_w10_idempotent_append", "x8_sessions", "s6_jira_issues", "w13_issue_graph", "p18_result_shape", "x4_session_cache", "j20_mentions_in_text", "q20_tool_enrichment", "f6_whole_job", "f6_job_reviews", "m20_graph_facts",
]


@pytest.mark.parametrize("name", NAMES)
def test_plan_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*columns).collect())
    rel = duck.execute(catalog.ORACLE_SQL[name])
    own = [d[0] for d in rel.description]
    assert sorted(own) == columns
    at = [own.index(c) for c in columns]
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())


def test_every_sql_has_a_plan():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert catalog.FLAGSHIP in catalog.QUERIES
