"""Whole searches, entity resolution and contexts over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import chunking, context, dense, entities, ranking, search, sparse
from lodestream.plans.registry import query, table
from lodestream.plans.retrieval_plans import DENSE_SQL, SPARSE_SQL, channel_hits, dense_hits, vectors


@query("r5_supplied_vectors", f"WITH {DENSE_SQL}, c AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(list_transform(a.v, lambda x: -x), b.v), 9) AS score FROM e a, e b WHERE a.id % 100 = 0) SELECT query_id, id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c) WHERE rank <= 10")
def r5(spark, sf_dir):
    """Search with vectors that come from elsewhere (here the opposite ones)."""
    v = vectors(spark, sf_dir)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.transform("vector", lambda x: -x).alias("vector"))
    return dense.search(asked, v, 10).select("query_id", "id", "rank")


@query("r11_fast_search", f"""WITH {DENSE_SQL}, d AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM dn) WHERE r <= 30),
m AS (SELECT a.id AS query_id, b.id, 0.5 AS score FROM e a JOIN e b ON a.label = b.label WHERE a.id % 100 = 0), f AS (SELECT query_id, id, coalesce(d.score, m.score) AS score FROM d FULL JOIN m USING (query_id, id))
SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 20""")
def r11(spark, sf_dir):
    meta = channel_hits(spark, sf_dir).where("channel = 'metadata'").select("query_id", "id", "score")
    return search.fast(dense_hits(spark, sf_dir, 30), meta, 20).withColumn("score", F.round("score", 6))


@query("r12_full_search")
def r12(spark, sf_dir):
    """Channels, freshness, signal and rerank scores, token budget: the whole chain, with a rerank score from outside."""
    payload = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_type"), F.when(F.col("doc_id") % 9 == 0, "archived").alias("status"), "text")
    weights = {"dense_weight": 0.35, "graph_weight": 0.15, "metadata_weight": 0.2, "recency_weight": 0.1, "balance_weight": 0.05}
    out = search.full(channel_hits(spark, sf_dir), payload, weights, 10, rerank=lambda p: p.withColumn("rerank_score", (F.col("id") * 37 % 101) / 100.0))
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank", F.length("text").alias("n_chars"))


@query("k4_k5_channel_caps", f"WITH {SPARSE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sp) SELECT query_id, id FROM r WHERE rank <= 10")
def k4(spark, sf_dir):
    hits = sparse.search(sparse.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text"), table(spark, sf_dir, "documents"), "doc_id", "text")
    return search.cap_channels(hits.select("query_id", F.lit("exact").alias("channel"), "id", "score")).select("query_id", "id")


@query("r14_contexts_with_roots")
def r14(spark, sf_dir):
    chunks = chunking.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", most=300, overlap=60, root=64)
    ranked = chunks.select((F.col("doc_id") % 20).alias("query_id"), "doc_id", "position")
    ranked = ranked.where("position > 0").withColumn("zero", F.lit(0)).withColumn("key", F.col("doc_id") * 100_000 + F.col("position"))
    ranked = ranking.top_k(ranked, ["query_id"], "zero", "key", 40)
    return context.with_roots(ranked.select("query_id", "rank", "doc_id", "position"), chunks, 4096).select("query_id", "rank", "doc_id", "position", "used")


@query("n6_first_fragment_cut", "SELECT conv_id AS query_id, turn AS rank, least(length(text), CASE WHEN length(text) // 4 > 60 AND turn = m THEN floor(length(text) * 60.0 / (length(text) // 4))::BIGINT ELSE length(text) END) AS n_chars FROM (SELECT *, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS used, min(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE used <= 60 OR turn = m")
def n6b(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")
    return context.fragments(c, "text", 60).select("query_id", "rank", F.length("text").cast("long").alias("n_chars"))


@query("m20_graph_facts", """
WITH f AS (SELECT c_mktsegment AS query_id, CASE (c_custkey // 20) % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'entity' WHEN 2 THEN 'relation' ELSE 'document' END AS kind, c_name AS name, 'Customer#' || lpad((c_custkey % 500)::VARCHAR, 9, '0') AS src,
  c_custkey AS place, length(c_name) + 18 + 1 + 24 AS cost FROM customer),
p AS (SELECT query_id, sum(cost) AS spent FROM f WHERE kind = 'person' GROUP BY ALL),
e AS (SELECT *, coalesce(spent, 0) + sum(cost) OVER (PARTITION BY query_id ORDER BY place) AS used FROM f LEFT JOIN p USING (query_id) WHERE kind = 'entity'), ek AS (SELECT * FROM e WHERE used // 4 <= 9000),
names AS (SELECT query_id, name FROM f WHERE kind = 'person' UNION SELECT query_id, name FROM ek), s1 AS (SELECT query_id, greatest(coalesce(p.spent, 0), coalesce(max(ek.used), 0)) AS spent FROM p FULL JOIN ek USING (query_id) GROUP BY query_id, p.spent),
r AS (SELECT f.*, coalesce(spent, 0) + sum(cost) OVER (PARTITION BY query_id ORDER BY place) AS used FROM f LEFT JOIN s1 USING (query_id) WHERE kind = 'relation' AND (query_id, src) IN (SELECT query_id, name FROM names)), rk AS (SELECT * FROM r WHERE used // 4 <= 9000),
s2 AS (SELECT query_id, greatest(coalesce(s1.spent, 0), coalesce(max(rk.used), 0)) AS spent FROM s1 FULL JOIN rk USING (query_id) GROUP BY query_id, s1.spent),
d AS (SELECT f.*, coalesce(spent, 0) + sum(cost) OVER (PARTITION BY query_id ORDER BY place) AS used FROM f LEFT JOIN s2 USING (query_id) WHERE kind = 'document')
SELECT query_id, kind, place FROM f WHERE kind = 'person' UNION ALL SELECT query_id, kind, place FROM ek UNION ALL SELECT query_id, kind, place FROM rk UNION ALL SELECT query_id, kind, place FROM d WHERE used // 4 <= 9000""")
def m20(spark, sf_dir):
    """Entities, relations and documents of each market segment under a budget; people first."""
    c = table(spark, sf_dir, "customer")
    facts = c.select(
        "c_mktsegment", F.element_at(F.array(*map(F.lit, ["person", "entity", "relation", "document"])), (F.pmod(F.floor(F.col("c_custkey") / 20), F.lit(4)) + 1).cast("int")).alias("kind"), F.col("c_name").alias("name"),
        F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") % 500).cast("string"), 9, "0")).alias("src"), F.lit("x").alias("dst"), F.col("c_custkey").alias("place"),
    ).withColumnRenamed("c_mktsegment", "query_id")
    return context.graph_facts(facts, 9_000).select("query_id", "kind", "place")


# A text in halves, down to three levels; the way down to a piece orders the pieces.
SPLIT_SQL = r"""
WITH RECURSIVE h AS (SELECT doc_id, '' AS way, text AS s FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, way || k, trim(CASE WHEN k = '0' THEN left(s, cut) ELSE substr(s, cut + 1) END, E' \t\n\r\x0b\x0c') FROM (
    SELECT *, CASE WHEN blank > 1 THEN blank - 1 ELSE length(s) // 2 END AS cut FROM (
      SELECT *, length(regexp_extract(left(s, length(s) // 2), '(?s)^.* ')) AS blank FROM h WHERE length(s) > 4000 AND length(way) < 3)), (VALUES ('0'), ('1')) v(k))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY way) - 1)::INT AS part, length(s)::BIGINT AS n_chars, md5(s) AS digest FROM h WHERE length(s) <= 4000 OR length(way) = 3"""


@query("t32_split_texts", SPLIT_SQL)
def t32(spark, sf_dir):
    """Every piece of every text."""
    parts = context.split_long(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 4000)
    return parts.select("doc_id", "part", F.length("piece").cast("long").alias("n_chars"), F.md5("piece").alias("digest"))


@query("g8_t23_entity_resolution")
def g8(spark, sf_dir):
    """Parts with odd keys among those with even ones; two neighbours have one vector."""
    v = vectors(spark, sf_dir).select(F.col("id").alias("at"), F.col("vector").cast("array<double>").alias("vector"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.floor(F.col("p_partkey") / 2).alias("at")).join(v, "at", "left").drop("at")
    known = p.where("id % 2 = 0").groupBy("type", "name").agg(F.min_by("vector", "id").alias("vector"))
    return entities.resolve(p.where("id % 2 = 1"), known)


@query("j21_alias_tiers", "SELECT c_custkey AS query_id, CASE WHEN c_custkey % 10 = 0 THEN -1 ELSE c_custkey END AS person FROM customer")
def j21(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    people = c.select(F.col("c_custkey").alias("person"), F.col("c_name").alias("name"), F.concat(F.lit("u"), "c_custkey", F.lit("@example.org")).alias("email"))
    asked = c.select(F.col("c_custkey").alias("query_id"), F.concat(F.lit(" U"), "c_custkey").alias("name"))
    custom = c.where("c_custkey % 10 = 0").select(F.concat(F.lit("u"), "c_custkey").alias("alias"), F.lit(-1).cast("long").alias("person"))
    return entities.alias_tiers(asked, custom, people)


@query("g10_extracted_graphs", "SELECT o_orderkey AS doc, l_partkey::VARCHAR || ' part' AS name, 'Technology' AS type, count(*) AS mention_count FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def g10(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.concat(F.col("l_partkey"), F.lit(" part ")).alias("name"), F.lit("Tool").alias("type"))
    bad = o.select("doc", F.lit("https://example.org/x").alias("name"), "type").distinct()
    none = spark.createDataFrame([], "doc long, src string, dst string, type string")
    return entities.clean_extraction(o.unionByName(bad), none)[0]


@query("q16_q18_run_copies", "SELECT sha256('run2:' || o_orderkey) AS id, o_orderkey, 2::INT AS version FROM orders WHERE o_custkey % 10 = 0")
def q16(spark, sf_dir):
    """A set of rows cloned under new keys, which follow from the old ones, with the version raised."""
    o = table(spark, sf_dir, "orders").where("o_custkey % 10 = 0")
    return o.select(F.sha2(F.concat(F.lit("run2:"), "o_orderkey"), 256).alias("id"), "o_orderkey", (F.lit(1) + 1).alias("version"))


@query("w3_boosted_texts", "SELECT doc_id, md5(source || ' ' || source || ' ' || text) AS digest FROM documents")
def w3(spark, sf_dir):
    """What an index of keywords is made from: the title twice, then the text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat_ws(" ", "source", "source", "text")).alias("digest"))


@query("q21_knowledge_page", "SELECT doc_id, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY doc_id LIMIT 50 OFFSET 50")
def q21(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    page = d.select("doc_id").orderBy("doc_id").offset(50).limit(50)
    return page.crossJoin(F.broadcast(d.agg(F.count("*").alias("total"))))


@query("p11_confident_hits", f"WITH {SPARSE_SQL} SELECT query_id, count(*) AS n FROM sp WHERE score >= 20 GROUP BY query_id")
def p11(spark, sf_dir):
    hits = sparse.search(sparse.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text"), table(spark, sf_dir, "documents"), "doc_id", "text")
    return hits.where("score >= 20").groupBy("query_id").agg(F.count("*").alias("n"))


@query("p18_result_shape", """SELECT doc_id::VARCHAR AS id, n_chars AS score, sha256(CASE WHEN doc_id % 3 = 0 THEN coalesce(source, '') ELSE coalesce(nullif(text, ''), source, '') END) AS data,
CASE WHEN doc_id % 2 = 0 THEN coalesce(lang, '') ELSE '' END AS title, '' AS url, CASE WHEN doc_id % 5 = 0 THEN 'evidence' ELSE 'knowledge_base' END AS source_role FROM documents""")
def p18(spark, sf_dir):
    """Payloads that lack some fields, as hits of the whole table."""
    pairs = F.array(
        F.when(F.col("doc_id") % 3 != 0, F.struct(F.lit("data").alias("key"), F.col("text").alias("value"))),
        F.struct(F.lit("memory").alias("key"), F.col("source").alias("value")),
        F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("title").alias("key"), F.col("lang").alias("value"))),
        F.when(F.col("doc_id") % 5 == 0, F.struct(F.lit("source_role").alias("key"), F.lit("evidence").alias("value"))),
    )
    hits = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score"), F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull())).alias("payload"))
    return search.result_shape(hits, "doc_id").select("id", "score", F.sha2("data", 256).alias("data"), "title", "url", "source_role")
