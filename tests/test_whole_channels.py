"""Channels and keyword legs over all rows."""

from lodestream.operators import fusion
from lodestream.plans import catalog, retrieval_plans, search_plans


def test_channels_see_all_rows(spark, sf):
    label = {r.vec_id: r.label for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label").collect()}
    asked = [q for q in label if q % 100 == 0]
    got = {(r.query_id, r.id): r for r in catalog.QUERIES["r10_channel_merge"](spark, sf).collect()}
    for channel, fits in (("metadata", lambda q, i: label[q] == label[i]), ("exact", lambda q, i: label[q] == label[i] and q % 2 == i % 2), ("graph", lambda q, i: abs(q - i) == 1)):
        assert {k for k, r in got.items() if r[channel] is not None} == {(q, i) for q in asked for i in label if fits(q, i)}


def test_scores_and_ranking_see_all_rows_of_a_label(spark, sf):
    """Rows beyond the first ten of a label are scored and can be ranked."""
    label = {r.vec_id: r.label for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label").collect()}
    dated = {r.event_id for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect()}
    alike = {(q, i) for q in label if q % 100 == 0 for i in label if i in dated and label[q] == label[i]}
    first = {(q, i) for q in label if q % 100 == 0 for i in [*sorted(i for i in label if label[q] == label[i])[:10], *sorted(i for i in label if label[q] == label[i] and q % 2 == i % 2)[:10], q - 1, q + 1]}
    near = {(r.query_id, r.id) for r in catalog.QUERIES["r1_dense_search"](spark, sf).collect()}
    scored = {(r.query_id, r.id) for r in catalog.QUERIES["m4_m5_signal_scores"](spark, sf).collect()}
    assert alike - first - near and alike <= scored
    ranked = {(r.query_id, r.id) for r in catalog.QUERIES["m6_k6_final_ranking"](spark, sf).collect()}
    assert ranked & (alike - first - near)


def test_fast_search_ranks_all_rows_of_a_label(spark, sf, tmp_path):
    """Vectors that are unlike a query's leave its places to the rows of its label, not to the first ten alone."""
    rows = [(0, "a", [1.0, 0.0])] + [(k, "a", [-1.0, k / 1000]) for k in range(1, 60)] + [(100 + k, "b", [0.3, 1.0]) for k in range(1, 40)]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [r.id for r in catalog.QUERIES["r11_fast_search"](spark, str(tmp_path)).orderBy("rank").collect()]
    near = {r.id: r.score for r in catalog.QUERIES["r1_dense_search"](spark, str(tmp_path)).collect()}
    score = {i: near.get(i, 0.5) for i in {*near, *range(60)}}
    assert got == sorted(score, key=lambda i: (-score[i], i))[:20] and len(set(got) & set(range(11, 60))) > 0


def test_keys_are_cut_before_they_are_joined(spark):
    """The best rows of each key, whatever their order and number; a key of no row has no hits; a hot key makes queries x limit rows."""
    rows = [(k % 3, 900 - k, float(k % 7)) for k in range(900)]
    queries = [(q, q % 5) for q in range(40)]
    got = fusion.keyed_channel(spark.createDataFrame(queries, "query_id long, key int"), spark.createDataFrame(rows, "key int, id long, score double"), ["key"], "metadata")
    best = {k: sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))[:10] for k in range(3)}
    assert sorted((r.query_id, r.id, r.score) for r in got.collect()) == sorted((q, i, s) for q, k in queries for _, i, s in best.get(k, []))


def test_full_search_takes_all_channels(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(search_plans.search, "full", lambda hits, *a, **b: seen.append(hits) or hits.selectExpr("query_id", "id", "score", "1 as rank", "'' as text"))
    catalog.QUERIES["r12_full_search"](spark, sf)
    assert {r.channel for r in seen[0].select("channel").distinct().collect()} == {"dense", "metadata", "exact", "graph"}
    assert seen[0].where("channel = 'metadata' and id % 7 <> 0").count() > 0


def test_keyword_leg_sees_documents_without_vector(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 50").write.parquet(f"{tmp_path}/embeddings.parquet")
    words = retrieval_plans.hybrid_lists(spark, str(tmp_path)).where("channel = 'sparse'")
    assert words.where("id >= 50").count() > 0 and words.where("query_id = 100").count() > 0
