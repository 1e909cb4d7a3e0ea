"""Graph walks, audits and set operations over whole tables.

The graph: customers mention parts (from their orders), parts are aliases of the next part when
their key is a multiple of 50, and mentions are valid from the date of the order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import graph, issues, push
from lodestream.operators import mentions as mentions_
from lodestream.plans.registry import query, table
from lodestream.plans.retrieval_plans import DENSE_SQL, dense_hits

GRAPH_SQL = """m AS (SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, 'MENTIONS' AS type, count(*) AS weight, min(o_orderdate) AS valid_from FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
al AS (SELECT 'p' || p_partkey AS src, 'p' || (p_partkey + 1) AS dst FROM part WHERE p_partkey % 50 = 0 OR p_partkey % 50 = 1),
seeds AS (SELECT p_partkey AS query_id, 'p' || p_partkey AS id FROM part WHERE p_partkey % 100 = 0)"""
WAYS_SQL = "ways AS (SELECT src, dst FROM {e} UNION SELECT dst, src FROM {e})"


def mentions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("MENTIONS").alias("type"), F.lit(1).alias("weight"), F.col("o_orderdate").alias("valid_from"))
    return graph.merge_edges(rows)


def alias_edges(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey % 50 in (0, 1)")
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("src"), F.concat(F.lit("p"), (F.col("p_partkey") + 1).cast("string")).alias("dst"))


def seeds(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("p"), "p_partkey").alias("id"))


@query("w11_a18_graph_write", f"WITH {GRAPH_SQL} SELECT src, dst, weight, valid_from FROM m")
def w11(spark, sf_dir):
    return mentions(spark, sf_dir).select("src", "dst", "weight", "valid_from")


@query("w14_w15_detached_document", f"WITH {GRAPH_SQL} SELECT count(*) AS n FROM m WHERE src <> 'c1'")
def w15(spark, sf_dir):
    gone = spark.createDataFrame([("c1",)], "src string")
    return mentions(spark, sf_dir).join(F.broadcast(gone), "src", "left_anti").agg(F.count("*").alias("n"))


_ALIAS_WALK = f"""WITH RECURSIVE {GRAPH_SQL}, {WAYS_SQL.format(e='al')},
walk(query_id, id, hop) AS (SELECT query_id, id, 0 FROM seeds UNION SELECT query_id, ways.dst, hop + 1 FROM walk JOIN ways ON ways.src = walk.id WHERE hop < 3)"""


@query("g1_u2_aliases", f"{_ALIAS_WALK} SELECT DISTINCT query_id, id FROM walk")
def g1(spark, sf_dir):
    return graph.aliases(seeds(spark, sf_dir), alias_edges(spark, sf_dir))


@query("j5_entity_documents", f"WITH {GRAPH_SQL} SELECT DISTINCT query_id, src AS doc FROM seeds JOIN m ON m.dst = seeds.id")
def j5(spark, sf_dir):
    return graph.entity_documents(seeds(spark, sf_dir), mentions(spark, sf_dir))


@query("j6_document_entities", f"WITH {GRAPH_SQL} SELECT src AS doc, count(*) AS n, min(dst) AS first FROM m GROUP BY src")
def j6(spark, sf_dir):
    return mentions(spark, sf_dir).groupBy(F.col("src").alias("doc")).agg(F.count("*").alias("n"), F.min("dst").alias("first"))


@query("j7_related_documents", f"""WITH {GRAPH_SQL}, {WAYS_SQL.format(e='al')}, d AS (SELECT c_custkey AS query_id, 'c' || c_custkey AS doc FROM customer WHERE c_custkey % 100 = 0),
own AS (SELECT DISTINCT query_id, dst AS e FROM d JOIN m ON m.src = d.doc), ents AS (SELECT query_id, e FROM own UNION SELECT query_id, ways.dst FROM own JOIN ways ON ways.src = own.e)
SELECT DISTINCT ents.query_id, m.src AS doc FROM ents JOIN m ON m.dst = ents.e LEFT JOIN d ON d.query_id = ents.query_id AND d.doc = m.src WHERE d.doc IS NULL""")
def j7(spark, sf_dir):
    d = table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("c"), "c_custkey").alias("doc"))
    return graph.related_documents(d, mentions(spark, sf_dir), alias_edges(spark, sf_dir))


@query("r8_graph_channel", f"""WITH {GRAPH_SQL}, {WAYS_SQL.format(e='m')}, h1 AS (SELECT DISTINCT query_id, dst AS id FROM seeds JOIN ways ON src = id),
f1 AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS r FROM h1 WHERE (query_id, id) NOT IN (SELECT query_id, id FROM seeds)) WHERE r <= 50),
h2 AS (SELECT DISTINCT f1.query_id, dst AS id FROM f1 JOIN ways ON src = f1.id), al2 AS (SELECT query_id, id, 0 AS hop FROM seeds UNION ALL SELECT query_id, id, 1 FROM h1 UNION ALL SELECT query_id, id, 2 FROM h2)
SELECT query_id, id, min(hop)::INT AS hop FROM al2 GROUP BY ALL""")
def r8(spark, sf_dir):
    """Two hops from each seed; a hop goes on from 50 new nodes at most, so hubs do not multiply."""
    return graph.reach(seeds(spark, sf_dir), mentions(spark, sf_dir), 2, frontier=graph.FRONTIER)


@query("g5_expanded_node", f"""WITH {GRAPH_SQL}, {WAYS_SQL.format(e='m')}, h1 AS (SELECT DISTINCT dst AS id FROM seeds JOIN ways ON src = id), dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM m UNION ALL SELECT dst FROM m) GROUP BY id)
SELECT id, degree FROM h1 JOIN dg USING (id) ORDER BY degree DESC, id LIMIT 50""")
def g5(spark, sf_dir):
    """Neighbours within a hop of the seeds, those of largest degree."""
    m = mentions(spark, sf_dir)
    near = graph.reach(seeds(spark, sf_dir), m, 1).where("hop > 0").select("id").distinct()
    return near.join(graph.degrees(m), "id").orderBy(F.desc("degree"), "id").limit(50)


@query("g2_relationships", f"""WITH {GRAPH_SQL}, r AS (SELECT DISTINCT query_id, src, dst, type FROM seeds JOIN m ON src = id OR dst = id) SELECT query_id, src, dst, type FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, dst, type) AS n FROM r) WHERE n <= 200""")
def g2(spark, sf_dir):
    return graph.relationships(seeds(spark, sf_dir), mentions(spark, sf_dir))


@query("g3_relationships_at_date", f"""WITH {GRAPH_SQL}, r AS (SELECT DISTINCT query_id, src, dst, type FROM seeds JOIN m ON (src = id OR dst = id) AND valid_from::DATE <= DATE '1998-01-01') SELECT query_id, src, dst, type FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, dst, type) AS n FROM r) WHERE n <= 200""")
def g3(spark, sf_dir):
    e = mentions(spark, sf_dir).withColumn("valid_to", F.lit(None).cast("timestamp"))
    return graph.relationships(seeds(spark, sf_dir), e, F.lit("1998-01-01").cast("date"))


@query("a15_g4_overview", f"""WITH {GRAPH_SQL}, dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM m UNION ALL SELECT dst FROM m) GROUP BY id), t AS (SELECT * FROM dg ORDER BY degree DESC, id LIMIT 200)
SELECT src, dst FROM m WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)""")
def a15(spark, sf_dir):
    return graph.overview(mentions(spark, sf_dir), 200)[1].select("src", "dst")


@query("j16_g6_bridges", f"WITH {GRAPH_SQL}, {WAYS_SQL.format(e='m')} SELECT DISTINCT query_id, a.dst AS bridge, b.dst AS other FROM seeds JOIN ways a ON a.src = id JOIN ways b ON b.src = a.dst WHERE b.dst <> id")
def j16(spark, sf_dir):
    return graph.bridges(seeds(spark, sf_dir), mentions(spark, sf_dir))


# Entities of the given texts: the words of six characters or more and the pairs of words next to each other of all benchmark items.
NAMES_SQL = r"""items AS (SELECT list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> '') AS w FROM benchmark),
spelled AS (SELECT unnest(list_concat(list_filter(w, lambda x: length(x) >= 6), list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS name FROM items),
names AS (SELECT lower(name) AS key, min(name) AS name FROM spelled GROUP BY ALL)"""


def entity_names(spark, sf_dir):
    from lodestream.functions.text import words

    w = table(spark, sf_dir, "benchmark").select(words(F.col("text")).alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    return w.select(F.explode(F.concat(F.filter("w", lambda x: F.length(x) >= 6), pairs)).alias("name")).distinct()


@query("j20_mentions_in_text", f"WITH {NAMES_SQL} SELECT doc_id AS id, name FROM documents JOIN names ON contains(lower(text), key)")
def j20(spark, sf_dir):
    """Entities wherever they stand in all documents: with blanks, inside words, overlapping."""
    return mentions_.mentions(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), entity_names(spark, sf_dir))


# Documents are the records, their sources the agents; a record is relevant for an entity by the share of its text that the name is.
ABOUT_SQL = f"{NAMES_SQL}, about AS (SELECT doc_id AS id, source AS agent, text AS content, name, length(name)::DOUBLE / length(text) AS relevance FROM documents JOIN names ON contains(lower(text), key))"


def about(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("agent"), F.col("text").alias("content"))
    met = mentions_.mentions(docs.select("id", F.col("content").alias("text")), entity_names(spark, sf_dir))
    edges = met.join(docs.select("id", F.length("content").alias("length")), "id").select("id", "name", (F.length("name").cast("double") / F.col("length")).alias("relevance"))
    return edges, docs


@query("j22_memories_about_entities", f"WITH {ABOUT_SQL} SELECT agent, name, id, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY agent, name ORDER BY relevance DESC, id) AS r FROM about) WHERE r <= 50")
def j22(spark, sf_dir):
    """Each agent's 50 most relevant memories about every entity."""
    return mentions_.memories_about(*about(spark, sf_dir))


@query("q20_tool_enrichment", rf"""WITH {ABOUT_SQL}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent, name ORDER BY relevance DESC, id) AS r FROM about) WHERE r <= 3),
results AS (SELECT conv_id * 1000 + turn AS id, 'src' || conv_id % 20 AS agent, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS existing, role FROM conversations),
met AS (SELECT id, agent, existing, name, row_number() OVER (PARTITION BY id ORDER BY name) AS place, count(*) OVER (PARTITION BY id) AS n_entities FROM results JOIN names ON contains(lower(text), key) WHERE role = 'assistant'),
lists AS (SELECT met.id, existing, n_entities, list(struct_pack(n := 1, text := content) ORDER BY place, r) AS lines FROM met JOIN best USING (agent, name) WHERE place <= 5 GROUP BY ALL),
folded AS (SELECT id, n_entities, list_reduce(lines, lambda a, c: CASE WHEN c.text <> '' AND NOT contains(existing, c.text) AND NOT contains(a.text, c.text)
  THEN struct_pack(n := a.n + 1, text := a.text || CASE WHEN a.n > 0 THEN chr(10) ELSE '' END || '- ' || c.text) ELSE a END, struct_pack(n := 0, text := '')) AS added FROM lists)
SELECT id, n_entities, added.n AS n_memories, length(added.text) // 4 AS n_tokens, md5(added.text) AS digest FROM folded WHERE added.n > 0""")
def q20(spark, sf_dir):
    """What memories add to every assistant's turn, taken as a tool result; the turn before it is what the context has already."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("existing", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    results = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("src"), F.col("conv_id") % 20).alias("agent"), "text", "existing")
    out = mentions_.enrich(results, entity_names(spark, sf_dir), *about(spark, sf_dir))
    return out.select("id", "n_entities", "n_memories", "n_tokens", F.md5("added").alias("digest"))


_STEP = "SELECT query_id, id, sum(part) AS score FROM (SELECT s.query_id, st.dst AS id, 0.85 * s.score * st.share AS part FROM {s} s JOIN st ON st.src = s.id UNION ALL SELECT query_id, id, home * 0.15 FROM home) GROUP BY ALL"


@query("r9_pagerank", f"""WITH {GRAPH_SQL}, w AS (SELECT src, dst, weight FROM m UNION ALL SELECT dst, src, weight FROM m), st AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM w),
home AS (SELECT 0 AS query_id, id, 1.0 / (SELECT count(*) FROM seeds) AS home FROM seeds), s0 AS (SELECT query_id, id, home AS score FROM home), s1 AS ({_STEP.format(s='s0')}), s2 AS ({_STEP.format(s='s1')}), s3 AS ({_STEP.format(s='s2')})
SELECT id, round(score / (SELECT sum(score) FROM s3), 6) AS score FROM s3""")
def r9(spark, sf_dir):
    home = seeds(spark, sf_dir).select(F.lit(0).alias("query_id"), "id", F.lit(1.0).alias("weight"))
    return graph.pagerank(mentions(spark, sf_dir), home, rounds=3, tolerance=0.0).select("id", F.round("score", 6).alias("score"))


# Rows 0.. of the vectors are the documents c0.. of the graph: what they mention, and aliases of that, is ranked from the ten nearest.
@query("r9_pagerank_channel", f"""WITH RECURSIVE {GRAPH_SQL}, {DENSE_SQL},
anchored AS (SELECT query_id, 'c' || id AS src FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM dn) WHERE r <= 10),
ed AS (SELECT src, dst, type, greatest(1, weight)::DOUBLE AS weight FROM m UNION ALL SELECT DISTINCT src, dst, 'ALIAS', 1.0 FROM al),
said AS (SELECT DISTINCT query_id, dst AS id FROM anchored JOIN m USING (src)), alw AS (SELECT src, dst FROM al UNION SELECT dst, src FROM al),
sd AS (SELECT query_id, id FROM said UNION SELECT query_id, alw.dst FROM said JOIN alw ON alw.src = id),
ways AS (SELECT src AS id, * FROM ed UNION SELECT dst AS id, * FROM ed),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, dst, type) AS p FROM (SELECT DISTINCT query_id, src, dst, type, weight FROM sd JOIN ways USING (id))) WHERE p <= 4000),
front AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS p FROM (SELECT query_id, src AS id FROM near UNION SELECT query_id, dst FROM near)) WHERE p <= 500),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, dst, type) AS p FROM
  (SELECT query_id, src, dst, type, weight FROM near UNION SELECT query_id, src, dst, type, weight FROM front JOIN ways USING (id))) WHERE p <= 4000),
known AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot) AS n FROM (SELECT query_id, id, min(spot) AS spot FROM (SELECT query_id, src AS id, 2 * p AS spot FROM ranked UNION ALL SELECT query_id, dst, 2 * p + 1 FROM ranked) GROUP BY ALL)) WHERE n <= 500),
sub AS (SELECT r.query_id, r.src, r.dst, r.weight FROM ranked r JOIN known a ON a.query_id = r.query_id AND a.id = r.src JOIN known b ON b.query_id = r.query_id AND b.id = r.dst WHERE r.src <> r.dst),
und AS (SELECT query_id, src, dst, sum(weight) AS weight FROM (SELECT query_id, src, dst, weight FROM sub UNION ALL SELECT query_id, dst, src, weight FROM sub) GROUP BY ALL),
nodes AS (SELECT DISTINCT query_id, src AS id FROM und), home AS (SELECT query_id, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS home FROM nodes WHERE NOT starts_with(id, 'c')),
step AS (SELECT query_id, src, dst, sum(share) AS share FROM (SELECT query_id, src, dst, 0.85::DOUBLE * weight / sum(weight) OVER (PARTITION BY query_id, src) AS share FROM und
  UNION ALL SELECT nodes.query_id, nodes.id, home.id, 0.15::DOUBLE * home FROM nodes JOIN home USING (query_id)) GROUP BY ALL),
ppr(i, query_id, id, score) AS (SELECT 0, query_id, id, home FROM home UNION ALL SELECT i + 1, step.query_id, dst, sum(score * share) FROM ppr JOIN step ON step.query_id = ppr.query_id AND src = id WHERE i < 130 GROUP BY i, step.query_id, dst)
SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM ppr WHERE i = 130 AND starts_with(id, 'c')) WHERE rank <= 5""")
def r9_channel(spark, sf_dir):
    """The graph channel by PageRank: dense anchors, their entities and aliases, subgraphs of 500 nodes, forward push, the best five documents."""
    edges = mentions(spark, sf_dir).select("src", "dst", "type", F.col("weight").cast("double").alias("weight"))
    edges = edges.unionByName(alias_edges(spark, sf_dir).select("src", "dst", F.lit("ALIAS").alias("type"), F.lit(1.0).alias("weight")))
    hits = dense_hits(spark, sf_dir, 10).select("query_id", F.concat(F.lit("c"), "id").alias("id"), "score")
    docs = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return push.channel(hits, edges, docs).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("j22_j23_memories_of_agents", "SELECT user_id, event_id, round(value, 4) AS importance FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 10")
def j23(spark, sf_dir):
    from lodestream.operators.ranking import top_k

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return top_k(e, ["user_id"], "value", "event_id", 10).select("user_id", "event_id", F.round("value", 4).alias("importance"))


@query("j1_j2_runs_of_sets", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def j1(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf_dir, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name")


@query("a13_q4_orphans", f"WITH {GRAPH_SQL} SELECT 'p' || p_partkey AS id FROM part WHERE 'p' || p_partkey NOT IN (SELECT dst FROM m)")
def a13(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return graph.orphans(nodes, mentions(spark, sf_dir))


@query("q1_node_counts", "SELECT p_brand AS type, count(*) AS n FROM part GROUP BY p_brand")
def q1(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("type")).agg(F.count("*").alias("n"))


@query("q2_mention_counts", f"WITH {GRAPH_SQL} SELECT 'p' || p_partkey AS id, count(m.src) AS mentions FROM part LEFT JOIN m ON m.dst = 'p' || p_partkey GROUP BY ALL")
def q2(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return graph.mention_counts(nodes, mentions(spark, sf_dir))


@query("q3_name_variants", "SELECT trim(lower(translate(p_name, '_.', '  '))) AS key, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def q3(spark, sf_dir):
    return graph.name_variants(table(spark, sf_dir, "part"), "p_name").select("key", "n")


@query("q5_self_loops", "SELECT count(*) AS n FROM events WHERE user_id = event_id % 150")
def q5(spark, sf_dir):
    return table(spark, sf_dir, "events").where("user_id = event_id % 150").agg(F.count("*").alias("n"))


@query("q6_duplicate_edges", "SELECT o_custkey AS src, l_partkey AS dst, 'BUYS' AS type, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, src, dst LIMIT 30")
def q6(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.duplicate_edges(o.select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("BUYS").alias("type")))


@query("q7_suspicious_names", "SELECT s_suppkey FROM supplier WHERE regexp_matches(s_name, '#0*1') OR length(s_name) < 3 OR length(s_name) > 50")
def q7(spark, sf_dir):
    n = F.col("s_name")
    return table(spark, sf_dir, "supplier").where(n.rlike("#0*1") | (F.length(n) < 3) | (F.length(n) > 50)).select("s_suppkey")


@query("q8_entity_spread", f"WITH {GRAPH_SQL}, n AS (SELECT c_custkey, count(m.dst) AS n FROM customer LEFT JOIN m ON m.src = 'c' || c_custkey GROUP BY c_custkey) SELECT min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most FROM n")
def q8(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return graph.entity_spread(docs, mentions(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("q9_circular_aliases", "WITH e AS (SELECT DISTINCT user_id AS src, event_id % 150 AS dst FROM events) SELECT a.src AS a, a.dst AS b FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def q9(spark, sf_dir):
    return graph.circular_pairs(table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 150).alias("dst")))


@query("q11_rebuild_scan", "SELECT doc_id FROM documents WHERE source = 'src3'")
def q11(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source = 'src3'").select("doc_id")


@query("q14_kmeans")
def q14(spark, sf_dir):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=5, seed=42, maxIter=20).fit(v).transform(v).select("vec_id", F.col("prediction").alias("cluster"))


@query("u1_u4_u5_id_sets", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 2 = 0 UNION SELECT doc_id FROM documents WHERE doc_id % 3 = 0 EXCEPT SELECT event_id FROM events WHERE event_id % 5 = 0")
def u5(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"))
    b = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    seen = table(spark, sf_dir, "events").where("event_id % 5 = 0").select(F.col("event_id").alias("id"))
    return a.union(b).distinct().join(seen, "id", "left_anti")


@query("g7_g9_entity_list", "SELECT DISTINCT p_type AS name FROM part ORDER BY name LIMIT 100")
def g9(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct().orderBy("name").limit(100)


@query("w13_issue_graph", """
WITH one AS (SELECT 'K-' || o_orderkey AS k, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 'u' || o_custkey END AS assignee, 'u' || (o_custkey % 10) AS reporter, o_orderdate AS created,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 5 DAY WHEN o_orderstatus IN ('F', 'P') THEN o_orderdate + INTERVAL 30 DAY END AS ends FROM orders)
SELECT 'bot' AS src, k AS dst, 'TRACKS' AS type, 1 AS weight, NULL::TIMESTAMP AS valid_from, NULL::TIMESTAMP AS valid_to FROM one
UNION ALL SELECT assignee, k, 'ASSIGNED_TO', 1, created, ends FROM one WHERE assignee <> ''
UNION ALL SELECT reporter, k, 'REPORTED', 1, created, NULL FROM one
UNION ALL SELECT 'K-' || o_orderkey, 'p' || l_partkey, 'MENTIONS', count(*), o_orderdate, NULL FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, l_partkey, o_orderdate""")
def w13(spark, sf_dir):
    """Orders as issues in two versions, of which the later counts; their lines are what they mention."""
    o = table(spark, sf_dir, "orders")
    day = lambda n: (F.col("o_orderdate") + F.expr(f"interval {n} day"))
    now = F.when(F.col("o_orderstatus") == "F", " Done ").when(F.col("o_orderstatus") == "P", "closed").otherwise("In progress")

    def version(status, updated, resolved):
        who = [F.lit("bot").alias("user_id"), F.when(F.col("o_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("u"), "o_custkey")).alias("assignee"), F.concat(F.lit("u"), (F.col("o_custkey") % 10).cast("string")).alias("reporter")]
        return F.struct(F.concat(F.lit("K-"), "o_orderkey").alias("issue_key"), *who, status.alias("status"), F.col("o_orderdate").alias("created"), updated.alias("updated"), resolved.alias("resolved_at"))

    none = F.lit(None).cast(o.schema["o_orderdate"].dataType)
    both = F.array(version(F.lit("Done"), day(0), none), version(now, day(30), F.when(F.col("o_orderpriority") == "1-URGENT", day(5))))
    mentioned = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("K-"), "l_orderkey").alias("issue_key"), F.concat(F.lit("p"), "l_partkey").alias("name"), F.lit(1).alias("mention_count"))
    return issues.issue_edges(o.select(F.inline(both)), mentioned)


@query("w13_issue_relations", """
SELECT 'p' || a.l_partkey AS src, 'p' || b.l_partkey AS dst, 'RELATION' AS type, CASE a.l_returnflag WHEN 'N' THEN 'RELATED_TO' ELSE a.l_returnflag END AS relation, max(o_orderdate) AS valid_from
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN orders ON o_orderkey = a.l_orderkey GROUP BY ALL""")
def w13_relations(spark, sf_dir):
    """Parts on lines of an order that follow each other are related; orders are the issues that tell so."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("K-"), "o_orderkey").alias("issue_key"), F.col("o_orderdate").alias("created"), F.col("o_orderdate").alias("updated"))
    lines = table(spark, sf_dir, "lineitem")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next"))
    told = lines.join(after, ["l_orderkey", "l_linenumber"]).select(F.concat(F.lit("K-"), "l_orderkey").alias("issue_key"), F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("p"), "next").alias("target"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("").alias("type"))
    return issues.relation_edges(o, told)
