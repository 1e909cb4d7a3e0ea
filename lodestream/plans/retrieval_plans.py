"""Recall channels, fusion, scoring, context and metrics over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import dense, evaluation, fusion, ranking, sparse
from lodestream.plans.registry import query, table
from lodestream.plans.text_plans import TOKENS_SQL

# Benchmark items are the keyword queries; vectors and documents with ids divisible by 100 the others. All rows are the corpus.
POSTINGS_SQL = f"""
tok AS (SELECT doc_id AS id, {TOKENS_SQL} AS t FROM documents),
tf AS (SELECT id, len(t) AS n, unnest(t) AS term FROM tok), cnt AS (SELECT id, n, term, count(*) AS tf FROM tf GROUP BY ALL),
post AS (SELECT id, term, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 256.0)) AS weight FROM cnt)"""
QUERY_SQL = f"qtok AS (SELECT item_id AS query_id, unnest({TOKENS_SQL}) AS term FROM benchmark), q AS (SELECT query_id, term, count(*) AS tf FROM qtok GROUP BY ALL)"
SPARSE_SQL = f"{POSTINGS_SQL}, {QUERY_SQL}, sp AS (SELECT query_id, id, round(sum(q.tf * post.weight), 9) AS score FROM q JOIN post USING (term) GROUP BY ALL)"
DENSE_SQL = """
e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
dn AS (SELECT a.id AS query_id, b.id AS id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM e a, e b WHERE a.id % 100 = 0)"""
# For hybrid search the text of document i is asked for beside vector i; each leg sees all its rows.
HYBRID_SQL = f"""{POSTINGS_SQL}, {DENSE_SQL},
hq AS (SELECT id AS query_id, term, tf FROM cnt WHERE id % 100 = 0),
hs AS (SELECT query_id, id, round(sum(hq.tf * post.weight), 9) AS score FROM hq JOIN post USING (term) GROUP BY ALL),
lists AS (SELECT query_id, 'sparse' AS channel, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM hs) WHERE r <= 30
  UNION ALL SELECT query_id, 'dense', id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM dn) WHERE r <= 30),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, id) AS place FROM lists)"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark, sf_dir):
    return vectors(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


def corpus_postings(spark, sf_dir):
    return sparse.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


def dense_hits(spark, sf_dir, k):
    return dense.search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), k)


def hybrid_lists(spark, sf_dir, k=30):
    """Both legs over all their rows: documents without a vector and vectors without a document too."""
    docs = table(spark, sf_dir, "documents")
    asked = sparse.query_terms(docs.where("doc_id % 100 = 0"), "doc_id", "text")
    words = sparse.search(asked, docs, "doc_id", "text", k).select("query_id", F.lit("sparse").alias("channel"), "id", "score")
    return words.unionByName(dense_hits(spark, sf_dir, k).select("query_id", F.lit("dense").alias("channel"), "id", "score"))


@query("t10_term_weights", f"WITH {POSTINGS_SQL} SELECT id, term, round(weight, 6) AS weight FROM post")
def t10(spark, sf_dir):
    return corpus_postings(spark, sf_dir).select("id", "term", F.round("weight", 6).alias("weight"))


@query("a22_term_counts", f"WITH {POSTINGS_SQL} SELECT id, term, tf::BIGINT AS tf FROM cnt")
def a22(spark, sf_dir):
    return sparse.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text").select("id", "term", "tf")


@query("t11_query_terms", f"WITH {QUERY_SQL} SELECT query_id, term, tf::BIGINT AS tf FROM q")
def t11(spark, sf_dir):
    return sparse.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query("r2_sparse_search", f"WITH {SPARSE_SQL} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sp) WHERE rank <= 30")
def r2(spark, sf_dir):
    out = sparse.search(sparse.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text"), table(spark, sf_dir, "documents"), "doc_id", "text", 30)
    return out.withColumn("score", F.round("score", 6))


@query("m1_cosine", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), z AS (SELECT v AS z FROM e WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(v, z), 6) AS cosine, round((list_cosine_similarity(v, z) + 1) / 2, 6) AS relevancy FROM e, z")
def m1(spark, sf_dir):
    """Cosine with the first vector; M12 maps it to 0..1."""
    v = vectors(spark, sf_dir)
    z = v.where("id = 0").select(F.col("vector").alias("z"))
    return v.crossJoin(F.broadcast(z)).select(F.col("id").alias("vec_id"), F.round(dense.cosine(F.col("vector"), F.col("z")), 6).alias("cosine"), F.round((dense.cosine(F.col("vector"), F.col("z")) + 1) / 2, 6).alias("relevancy"))


@query("r1_dense_search", f"WITH {DENSE_SQL} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dn) WHERE rank <= 30")
def r1(spark, sf_dir):
    return dense_hits(spark, sf_dir, 30).withColumn("score", F.round("score", 6))


@query("j12_similar_records", f"WITH {DENSE_SQL} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dn WHERE query_id <> id AND score >= 0.6) WHERE rank <= 20")
def j12(spark, sf_dir):
    return dense.search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), 20, least=0.6, exclude_self=True).withColumn("score", F.round("score", 6))


@query("r3_hybrid_search", f"""WITH {HYBRID_SQL}, f AS (SELECT query_id, id, round(sum(1.0 / (60 + place)), 9) AS score FROM placed GROUP BY ALL)
SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""")
def r3(spark, sf_dir):
    return fusion.reciprocal_rank(hybrid_lists(spark, sf_dir), top=10).withColumn("score", F.round("score", 6))


_OVERLAP_SQL = """, o AS (SELECT query_id, count(*) FILTER (n = 2) / count(*)::DOUBLE AS overlap FROM (SELECT query_id, id, count(*) AS n FROM lists GROUP BY ALL) GROUP BY query_id),
k AS (SELECT query_id, overlap, CASE WHEN overlap >= 0.7 THEN 20 WHEN overlap <= 0.2 THEN 80 ELSE round_even(80 - (overlap - 0.2) / 0.5 * 60, 0) END::INT AS k FROM o)"""


@query("u6_m3_overlap_and_k", f"WITH {HYBRID_SQL} {_OVERLAP_SQL} SELECT query_id, round(overlap, 6) AS overlap, k FROM k")
def u6(spark, sf_dir):
    return overlaps(hybrid_lists(spark, sf_dir)).select("query_id", F.round("overlap", 6).alias("overlap"), "k")


def overlaps(lists):
    own = lambda c: F.collect_set(F.when(F.col("channel") == c, F.col("id")))
    sets = lists.groupBy("query_id").agg(own("dense").alias("a"), own("sparse").alias("b"))
    o = fusion.jaccard(F.col("a"), F.col("b"))
    return sets.select("query_id", o.alias("overlap"), fusion.adaptive_k(o).alias("k"))


@query("r4_adaptive_hybrid", f"""WITH {HYBRID_SQL} {_OVERLAP_SQL}, f AS (SELECT query_id, id, round(sum(1.0 / (k + place)), 9) AS score FROM placed JOIN k USING (query_id) GROUP BY ALL)
SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""")
def r4(spark, sf_dir):
    return adaptive(hybrid_lists(spark, sf_dir))


def adaptive(lists):
    return fusion.reciprocal_rank(lists.join(overlaps(lists).select("query_id", "k"), "query_id"), F.col("k"), 10).withColumn("score", F.round("score", 6))


@query("n3_min_max", "SELECT event_id, round(CASE WHEN max(value) OVER w = min(value) OVER w THEN 1.0 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6) AS scaled FROM events WINDOW w AS (PARTITION BY user_id)")
def n3(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(ranking.min_max(F.col("value"), ["user_id"]), 6).alias("scaled"))


# Channels for scoring: dense hits; exact ones share label and parity; metadata ones the label; graph ones a neighbouring id.
CHANNEL_SQL = f"""{DENSE_SQL}, dh AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM dn) WHERE r <= 30),
hits AS (SELECT query_id, 'dense' AS channel, id, score FROM dh
  UNION ALL SELECT a.id, 'metadata', b.id, 0.5 FROM e a JOIN e b ON a.label = b.label WHERE a.id % 100 = 0
  UNION ALL SELECT a.id, 'exact', b.id, 1.0 FROM e a JOIN e b ON a.label = b.label AND a.id % 2 = b.id % 2 WHERE a.id % 100 = 0
  UNION ALL SELECT a.id, 'graph', b.id, 0.8 FROM e a JOIN e b ON b.id IN (a.id - 1, a.id + 1) WHERE a.id % 100 = 0),
merged AS (SELECT query_id, id, max(score) FILTER (channel = 'dense') AS dense, max(score) FILTER (channel = 'exact') AS exact, max(score) FILTER (channel = 'metadata') AS metadata,
  max(score) FILTER (channel = 'graph') AS graph, arg_min(channel, (-score, CASE channel WHEN 'dense' THEN 1 WHEN 'exact' THEN 2 WHEN 'metadata' THEN 3 ELSE 4 END)) AS best_channel FROM hits GROUP BY ALL)"""


def channel_hits(spark, sf_dir):
    """All four channels of every query against all rows: label, label and parity, neighbouring ids."""
    v = vectors(spark, sf_dir).select("id", "label")
    a = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "label")
    near = dense_hits(spark, sf_dir, 30).select("query_id", F.lit("dense").alias("channel"), "id", "score")
    alike = a.join(v, "label")
    meta = alike.select("query_id", F.lit("metadata").alias("channel"), "id", F.lit(0.5).alias("score"))
    exact = alike.where("query_id % 2 = id % 2").select("query_id", F.lit("exact").alias("channel"), "id", F.lit(1.0).alias("score"))
    beside = a.select("query_id", F.explode(F.array(F.col("query_id") - 1, F.col("query_id") + 1)).alias("id")).join(v.select("id"), "id", "left_semi")
    graph = beside.select("query_id", F.lit("graph").alias("channel"), "id", F.lit(0.8).alias("score"))
    return near.unionByName(meta).unionByName(exact).unionByName(graph)


@query("r10_channel_merge", f"WITH {CHANNEL_SQL} SELECT query_id, id, round(dense, 6) AS dense, exact::DOUBLE AS exact, metadata::DOUBLE AS metadata, graph::DOUBLE AS graph, best_channel FROM merged")
def r10(spark, sf_dir):
    return fusion.merge_channels(channel_hits(spark, sf_dir)).withColumn("dense", F.round("dense", 6))


SCORED_SQL = f"""{CHANNEL_SQL},
act AS (SELECT query_id, bool_or(channel = 'dense') AS d, bool_or(channel = 'graph') AS g, bool_or(channel IN ('exact', 'metadata')) AS m FROM hits GROUP BY query_id),
x AS (SELECT m.*, ev.ts, label, count(*) OVER (PARTITION BY m.query_id, label) / count(*) OVER (PARTITION BY m.query_id)::DOUBLE AS share FROM merged m JOIN e USING (id) JOIN events ev ON ev.event_id = m.id),
s AS (SELECT x.query_id, x.id, (0.1 * exp(-ln(2.0) / 30 * (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400e6) + 0.05 * greatest(0, 1 - share / 0.4)
  + CASE WHEN d THEN 0.35 * coalesce(dense, 0) ELSE 0 END + CASE WHEN g THEN 0.15 * coalesce(graph, 0) ELSE 0 END + CASE WHEN act.m THEN 0.2 * greatest(coalesce(exact, 0), coalesce(metadata, 0)) ELSE 0 END)
  / (0.15 + CASE WHEN d THEN 0.35 ELSE 0 END + CASE WHEN g THEN 0.15 ELSE 0 END + CASE WHEN act.m THEN 0.2 ELSE 0 END) AS signal, greatest(0, 1 - share / 0.4) AS balance FROM x JOIN act USING (query_id))"""


def scored(spark, sf_dir):
    from pyspark.sql import Window

    from lodestream.functions.dates import recency

    hits = channel_hits(spark, sf_dir)
    active = hits.groupBy("query_id").agg(*[F.max(F.col("channel") == c).alias(f"on_{c}") for c in fusion.CHANNELS])
    label = vectors(spark, sf_dir).select("id", "label")
    when = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts")
    rows = fusion.merge_channels(hits).join(label, "id").join(when, "id").join(active, "query_id")
    share = F.count("*").over(Window.partitionBy("query_id", "label")) / F.count("*").over(Window.partitionBy("query_id"))
    rows = rows.withColumn("share", share)
    weights = {"dense_weight": 0.35, "graph_weight": 0.15, "metadata_weight": 0.2, "recency_weight": 0.1, "balance_weight": 0.05}
    balance = fusion.source_balance(F.col("share"))
    signal = fusion.signal_score({c: F.col(c) for c in fusion.CHANNELS}, recency(F.col("ts").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")), balance, {k: F.lit(v) for k, v in weights.items()}, {c: F.col(f"on_{c}") for c in fusion.CHANNELS})
    return rows.select("query_id", "id", signal.alias("signal"), balance.alias("balance"), "dense")


@query("m4_m5_signal_scores", f"WITH {SCORED_SQL} SELECT query_id, id, round(signal, 6) AS signal, round(balance, 6)::DOUBLE AS balance FROM s")
def m5(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "id", F.round("signal", 6).alias("signal"), F.round("balance", 6).alias("balance"))


@query("m6_k6_final_ranking", f"""WITH {SCORED_SQL}, pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(signal, 9) DESC, id) AS r FROM s) WHERE r <= 35),
rr AS (SELECT *, ((id * 37) % 101) / 100.0 AS raw FROM pool), nn AS (SELECT *, (raw - min(raw) OVER w) / nullif(max(raw) OVER w - min(raw) OVER w, 0) AS n FROM rr WINDOW w AS (PARTITION BY query_id)),
ff AS (SELECT query_id, id, round(0.3 * round(signal, 9) + 0.7 * coalesce(n, 1), 9) AS final FROM nn)
SELECT query_id, id, round(final, 6) AS final, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id) AS rank FROM ff) WHERE rank <= 10""")
def m6(spark, sf_dir):
    return final_ranking(scored(spark, sf_dir))


def final_ranking(s):
    """Signal score at least 0 (P11), a pool of 35, rerank scores from outside, min-max scaled, blended; the best ten."""
    s = s.withColumn("signal", F.round("signal", 9)).where("signal >= 0")
    pool = ranking.top_k(s, ["query_id"], "signal", "id", 35).drop("rank")
    raw = pool.withColumn("raw", ((F.col("id") * 37) % 101) / 100.0)
    final = raw.withColumn("final", F.round(fusion.final_score(F.col("signal"), ranking.min_max(F.col("raw"), ["query_id"])), 9))
    return ranking.top_k(final, ["query_id"], "final", "id", 10).select("query_id", "id", F.round("final", 6).alias("final"), "rank")


_JUDGED_SQL = f"""{DENSE_SQL}, res AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dn WHERE query_id <> id) WHERE rank <= 20),
want AS (SELECT a.id AS query_id, b.id FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id WHERE a.id % 100 = 0),
j AS (SELECT res.query_id, res.id, rank, (want.id IS NOT NULL)::INT AS hit FROM res LEFT JOIN want ON res.query_id = want.query_id AND res.id = want.id),
w AS (SELECT query_id, least(count(*), 10) AS n FROM want GROUP BY query_id),
pq AS (SELECT w.query_id, coalesce(sum(hit) FILTER (rank <= 10) / least(10, count(*))::DOUBLE, 0) AS precision, coalesce(max(1.0 / rank) FILTER (hit = 1), 0) AS mrr,
  coalesce(sum(hit / log2(rank + 1)) FILTER (rank <= 10), 0) / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, n + 1) t(i)) AS ndcg FROM w LEFT JOIN j ON j.query_id = w.query_id GROUP BY w.query_id, n)"""


def judged(spark, sf_dir):
    res = dense.search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), 20, exclude_self=True)
    v = vectors(spark, sf_dir).select("id", "label")
    want = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "label").join(v, "label").where("id <> query_id").select("query_id", "id")
    return evaluation.metrics(res, want, 10)


@query("m9_retrieval_metrics", f"WITH {_JUDGED_SQL} SELECT query_id, round(precision, 6) AS precision, round(mrr, 6)::DOUBLE AS mrr, round(ndcg, 6) AS ndcg FROM pq")
def m9(spark, sf_dir):
    return judged(spark, sf_dir).select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "mrr", "ndcg")])


@query("m10_a20_mean_metrics", f"WITH {_JUDGED_SQL} SELECT round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) AS n_queries FROM pq")
def m10(spark, sf_dir):
    m = evaluation.means(judged(spark, sf_dir))
    return m.select(*[F.round(c, 6).alias(c) for c in ("precision", "mrr", "ndcg")], "n_queries")


@query("a24_q13_baseline_deltas", f"""WITH {_JUDGED_SQL}, m AS (SELECT avg(precision) AS precision, avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM pq), a AS (UNPIVOT m ON precision, mrr, ndcg INTO NAME metric VALUE after)
SELECT metric, 0.5::DOUBLE AS before, round(after, 6) AS after, round(after - 0.5, 6) AS delta, after - 0.5 < -0.05 AS regression FROM a""")
def a24(spark, sf_dir):
    after = evaluation.long_form(evaluation.means(judged(spark, sf_dir)).drop("n_queries"))
    before = after.select("metric", F.lit(0.5).alias("value"))
    c = evaluation.compare(before, after, {"precision": 0.05, "mrr": 0.05, "ndcg": 0.05})
    return c.select("metric", "before", F.round("after", 6).alias("after"), F.round("delta", 6).alias("delta"), "regression")


@query("m15_weight_grid", """
WITH a AS (SELECT i / 100.0::DOUBLE AS dense FROM range(0, 61, 5) t(i)), b AS (SELECT i / 100.0::DOUBLE AS graph FROM range(0, 31, 5) t(i)), c AS (SELECT i / 100.0::DOUBLE AS metadata FROM range(0, 51, 5) t(i)), d AS (SELECT i / 100.0::DOUBLE AS recency FROM range(0, 31, 5) t(i))
SELECT dense, graph, metadata, recency, round(dense + graph + metadata + recency, 6) AS total FROM a, b, c, d WHERE round(dense + graph + metadata + recency, 6) BETWEEN 0.8 AND 0.9""")
def m15(spark, sf_dir):
    return evaluation.weight_grid(spark)


@query("m15_objective", f"WITH {_JUDGED_SQL} SELECT query_id, round(0.4 * mrr + 0.4 * ndcg + 0.2 * precision, 6) AS objective FROM pq")
def m15b(spark, sf_dir):
    return evaluation.objective(judged(spark, sf_dir)).select("query_id", F.round("objective", 6).alias("objective"))


@query("q12_negative_accuracy", f"WITH {SPARSE_SQL} SELECT round(avg(CASE WHEN s.query_id IS NULL THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n_queries FROM benchmark b LEFT JOIN (SELECT DISTINCT query_id FROM sp WHERE score >= 40) s ON b.item_id = s.query_id")
def q12(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    hits = sparse.search(sparse.query_terms(b, "item_id", "text"), table(spark, sf_dir, "documents"), "doc_id", "text").where("score >= 40")
    return evaluation.negative_accuracy(b.select(F.col("item_id").alias("query_id")), hits).select(F.round("accuracy", 6).alias("accuracy"), "n_queries")


@query("m11_confidence", """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.label, round((avg(list_cosine_similarity(a.v, b.v)) + 1) / 2, 6) AS confidence FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def m11(spark, sf_dir):
    """Mean pairwise cosine of a group, from the sum of its unit vectors: no pair is built."""
    v = vectors(spark, sf_dir).select("label", F.posexplode(_unit_vector(F.col("vector"))).alias("i", "x"))
    sums = v.groupBy("label", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    per = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"), F.max("n").alias("n"))
    mean = (F.col("ss") - F.col("qq")) / (F.col("n") * (F.col("n") - 1))
    return per.select("label", F.round(F.when(F.col("n") < 2, 1.0).otherwise((mean + 1) / 2), 6).alias("confidence"))


def _unit_vector(v):
    from lodestream.functions.text import let

    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))


@query("j3_hydrated_ranks", f"WITH {SPARSE_SQL}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sp) WHERE rank <= 5) SELECT query_id, rank::INT AS rank, id, d.source, d.lang, coalesce(NULL, 'knowledge_base') AS source_role FROM t JOIN documents d ON d.doc_id = t.id")
def j3(spark, sf_dir):
    """Payload of ranked ids, in rank order, with the default role (P18)."""
    hits = sparse.search(sparse.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text"), table(spark, sf_dir, "documents"), "doc_id", "text", 5)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return hits.join(d, "id").select("query_id", "rank", "id", "source", "lang", F.lit("knowledge_base").alias("source_role"))


@query("r6_exact_channel", """
SELECT o_orderkey AS query_id, p_partkey AS id, 1.0::DOUBLE AS score FROM orders JOIN part ON p_partkey = o_custkey WHERE o_orderkey % 100 = 0
UNION SELECT o_orderkey, n_nationkey, 1.0::DOUBLE FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 WHERE o_orderkey % 100 = 0""")
def r6(spark, sf_dir):
    """Rows whose label or title is asked for, each once, score 1."""
    q = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 25).cast("int").alias("n"))
    by_key = q.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("key")).select("query_id", F.col("p_partkey").alias("id"))
    by_title = q.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("n")).select("query_id", F.col("n_nationkey").cast("long").alias("id"))
    return by_key.unionByName(by_title).distinct().withColumn("score", F.lit(1.0))


@query("r7_metadata_channel", """
SELECT DISTINCT c.c_custkey AS query_id, o.o_orderkey AS id FROM customer c JOIN orders o ON (o.o_custkey = c.c_custkey AND o.o_orderstatus IN ('F', 'O')) OR (o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '1998-01-01') WHERE c.c_custkey % 100 = 0""")
def r7(spark, sf_dir):
    """Rows of the person that are in a status or a date range that is asked for, each once."""
    q = table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("query_id"))
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O") | (F.col("o_orderdate") >= "1998-01-01"))
    return q.join(o, F.col("o_custkey") == F.col("query_id")).select("query_id", F.col("o_orderkey").alias("id")).distinct()


@query("n6_token_budget", "SELECT conv_id, turn, used::BIGINT AS used FROM (SELECT conv_id, turn, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) WHERE used <= 300")
def n6(spark, sf_dir):
    from lodestream.functions.text import estimate_tokens

    c = table(spark, sf_dir, "conversations")
    return ranking.budget_prefix(c, ["conv_id"], "turn", estimate_tokens(F.col("text")), 300).select("conv_id", "turn", "used")


@query("n5_first_occurrences", "SELECT source, doc_id, lang FROM (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def n5(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars")
    return ranking.first_by(d, ["source"], [-F.col("n_chars"), F.col("doc_id")]).select("source", "doc_id", "lang")


@query("k1_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def k1(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query("k2_keyset_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' OR (o_orderdate = TIMESTAMP '1998-06-01' AND o_orderkey > 500) ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def k2(spark, sf_dir):
    after = (F.col("o_orderdate") < "1998-06-01") | ((F.col("o_orderdate") == "1998-06-01") & (F.col("o_orderkey") > 500))
    return table(spark, sf_dir, "orders").where(after).select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)


@query("k3_cursors", "SELECT o_orderkey, base64(encode('{\"after\":' || o_orderkey || '}')) AS cursor FROM orders")
def k3(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.base64(F.to_json(F.struct(F.col("o_orderkey").alias("after"))).cast("binary")).alias("cursor"))


@query("m16_evidence_roles", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'PRIMARY' ELSE 'SUPPORTING' END AS marker FROM documents")
def m16(spark, sf_dir):
    from lodestream.functions.constants import PROFILE_PRIMARY_ROLE

    role = F.when(F.col("source") == "src1", "task_tracker").otherwise("knowledge_base")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(role == PROFILE_PRIMARY_ROLE["temporal"], "PRIMARY").otherwise("SUPPORTING").alias("marker"))
