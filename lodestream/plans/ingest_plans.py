"""Ingestion over whole tables: changes, fingerprints, near duplicates, chunks, keyed writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import chunking, simhash, upserts
from lodestream.plans.registry import query, table
from lodestream.plans.text_plans import WORDS_SQL

PRINTS_SQL = f"""
w AS (SELECT doc_id, {WORDS_SQL.format(x="lower(text)")} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
h AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 16))::UBIGINT AS h FROM s),
v AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, range(0, 64) t(i) GROUP BY ALL),
f AS (SELECT doc_id, coalesce(sum(CASE WHEN v > 0 THEN 1::UBIGINT << i ELSE 0::UBIGINT END), 0)::UBIGINT AS f FROM v GROUP BY doc_id),
fp AS (SELECT d.doc_id, coalesce(f, 0::UBIGINT) AS f FROM documents d LEFT JOIN f USING (doc_id)),
least_ids AS (SELECT f, min(doc_id) AS id FROM fp WHERE f <> 0 GROUP BY f),
near AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.f, b.f)::UBIGINT)::INT AS distance FROM least_ids a JOIN least_ids b ON a.id < b.id AND bit_count(xor(a.f, b.f)::UBIGINT) <= 3)"""


def prints(spark, sf_dir):
    return simhash.fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("t8_simhash", f"WITH {PRINTS_SQL} SELECT doc_id, lower(lpad(to_hex(f), 16, '0')) AS fingerprint FROM fp")
def t8(spark, sf_dir):
    return prints(spark, sf_dir).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"))


@query("j8_near_pairs", f"WITH {PRINTS_SQL} SELECT a, b, distance FROM near")
def j8(spark, sf_dir):
    return simhash.near_pairs(prints(spark, sf_dir))


@query("j9_near_pairs_by_source", f"""WITH {PRINTS_SQL}, l AS (SELECT source, f, min(fp.doc_id) AS id FROM fp JOIN documents USING (doc_id) WHERE f <> 0 GROUP BY ALL)
SELECT a.source, a.id AS a, b.id AS b, bit_count(xor(a.f, b.f)::UBIGINT)::INT AS distance FROM l a JOIN l b ON a.source = b.source AND a.id < b.id AND bit_count(xor(a.f, b.f)::UBIGINT) <= 3""")
def j9(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return simhash.near_pairs(prints(spark, sf_dir).join(d, "id"), block=["source"])


@query("a17_duplicate_clusters", f"""WITH RECURSIVE {PRINTS_SQL}, links AS (SELECT a, b FROM near UNION SELECT fp.doc_id, l.id FROM fp JOIN least_ids l USING (f) WHERE fp.doc_id <> l.id),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), walk(id, root) AS (SELECT a, a FROM ways UNION SELECT ways.b, walk.root FROM walk JOIN ways ON ways.a = walk.id)
SELECT count(DISTINCT root) AS clusters, count(*) AS clustered, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS ratio FROM (SELECT id, min(root) AS root FROM walk GROUP BY id)""")
def a17(spark, sf_dir):
    """Clusters of near fingerprints, and the share of all rows that are in one."""
    p = prints(spark, sf_dir)
    c = simhash.clusters(p).agg(F.countDistinct("root").alias("clusters"), F.count("*").alias("clustered"))
    return c.crossJoin(p.agg(F.count("*").alias("n"))).select("clusters", "clustered", F.round(F.col("clustered") / F.col("n"), 6).alias("ratio"))


@query("w5_greedy_dedup")
def greedy(spark, sf_dir):
    p = prints(spark, sf_dir).select("id", F.col("id").alias("doc"), "fingerprint")
    return simhash.keep_greedily(p)


@query("t6_root_child_chunks")
def t6(spark, sf_dir):
    c = chunking.chunk(table(spark, sf_dir, "documents"), "doc_id", "text")
    return c.select("doc_id", "position", "chunk_type", "token_count", F.md5("content").alias("digest"))


@query("t6b_flat_chunks")
def t6b(spark, sf_dir):
    c = chunking.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", most=300, overlap=60, root=None)
    return c.select("doc_id", "position", "chunk_type", "token_count", F.md5("content").alias("digest"))


@query("t6b_fixed_width", """
WITH p AS (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 2500 THEN [0] ELSE range(0, length(text), 2300) END) AS start FROM documents)
SELECT doc_id, start::INT AS start, md5(substr(text, start::INT + 1, 2500)) AS digest FROM p""")
def t6c(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.fixed_width(F.col("text"))).alias("i", "piece"))
    return p.select("doc_id", (F.col("i") * 2300).alias("start"), F.md5("piece").alias("digest"))


@query("j4_root_context")
def j4(spark, sf_dir):
    c = chunking.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", most=300, overlap=60, root=64)
    out = chunking.with_root_context(c.select("doc_id", "position"), c)
    return out.select("doc_id", "position", F.length("context").cast("long").alias("n_chars"))


@query("w12_chunk_edges")
def w12(spark, sf_dir):
    """CHILD_OF edges from children to the root of their document."""
    c = chunking.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", most=300, overlap=60, root=64)
    return c.where("chunk_type = 'child'").select(F.concat_ws(":", "doc_id", "position").alias("src"), F.concat_ws(":", "doc_id", F.lit(0)).alias("dst"), F.lit("CHILD_OF").alias("type"))


# Stored documents: those with even ids, every fourth with another content.
@query("w1_change_detection", """
WITH old AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 2 = 0)
SELECT d.doc_id, CASE WHEN h IS NULL THEN 'new' WHEN h <> sha256(text) THEN 'updated' ELSE 'unchanged' END AS change FROM documents d LEFT JOIN old USING (doc_id)""")
def w1(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 2 = 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return upserts.detect_changes(d, old, ["doc_id"], "text").select("doc_id", "change")


@query("j18_changed_documents", "SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 2 = 1")
def j18(spark, sf_dir):
    return w1(spark, sf_dir).where("change <> 'unchanged'").select("doc_id")


@query("w2_n8_versions", """
WITH h AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS version FROM h WHERE before IS NULL OR before <> event_type""")
def w2(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return upserts.versions(e, "user_id", "at", "event_type").select("user_id", "event_id", "version")


@query("q26_latest_versions", "SELECT user_id, max(event_id) FILTER (r = 1) AS event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) GROUP BY user_id")
def q26(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


@query("w4_delete_by_key", "SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2')")
def w4(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return upserts.delete_keys(d, d.where("source in ('src1', 'src2')"), ["source"]).select("doc_id")


@query("w5_fingerprint_insert", f"WITH {PRINTS_SQL} SELECT lower(lpad(to_hex(f), 16, '0')) AS fingerprint FROM fp GROUP BY f HAVING bool_and(doc_id % 3 <> 0)")
def w5(spark, sf_dir):
    p = prints(spark, sf_dir)
    return upserts.insert_new(p, p.where("id % 3 = 0"), ["fingerprint"]).select(F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"))


@query("w6_fetch_stats", """
SELECT user_id AS doc_label, ts::DATE AS day, count(*) AS fetches, sum(event_id % 50)::BIGINT AS words, coalesce(max(event_type) FILTER (event_id % 2 = 1), max(event_type)) AS title FROM events GROUP BY ALL""")
def w6(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_label"), F.to_date("ts").alias("day"), F.lit(1).cast("long").alias("fetches"), (F.col("event_id") % 50).alias("words"), F.col("event_type").alias("title"), "event_id")
    part = lambda k: e.where(F.col("event_id") % 2 == k).drop("event_id")
    return upserts.add_up(part(0), part(1), ["doc_label", "day"], ["fetches", "words"], "title")


@query("w7_lifecycle_patch", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'archived' ELSE p_type END AS p_type, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ',seen' ELSE p_brand END AS tags FROM part")
def w7(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.array("p_brand").alias("tags"))
    delta = p.where("p_partkey % 3 = 0").select("p_partkey", F.lit("archived").alias("p_type"), F.array(F.lit("seen"), F.lit("seen")).alias("tags"))
    once = upserts.patch(p, delta, "p_partkey", ["p_type"], "tags")
    return upserts.patch(once, delta, "p_partkey", ["p_type"], "tags").select("p_partkey", "p_type", F.array_join("tags", ",").alias("tags"))


@query("w3_w4_w7_stored_points", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, source FROM documents)
SELECT doc_id, n::INT AS n, CASE WHEN doc_id % 10 = 3 THEN '* ' || line ELSE line END AS line, CASE WHEN doc_id % 10 = 5 THEN 'archived' ELSE 'active' END AS status FROM l WHERE doc_id % 10 <> 7
UNION ALL SELECT doc_id, 0, source, 'active' FROM documents WHERE doc_id % 10 = 3""")
def stored_points(spark, sf_dir):
    """Lines of all documents as points of a stored table: some are written anew, some added, some patched, some deleted, each change in its own buckets."""
    from lodestream.operators.stored import StoredTable, point_id

    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    points = d.select(point_id(F.col("doc_id"), F.col("at") + 1).alias("point"), "doc_id", (F.col("at") + 1).alias("n"), "line", F.lit("active").alias("status"))
    t = StoredTable.create(points, "point", 32)
    t.upsert(points.where("doc_id % 10 = 3").withColumn("line", F.concat(F.lit("* "), "line")))
    t.upsert(d.where("doc_id % 10 = 3 and at = 0").select(point_id(F.col("doc_id"), F.lit(0)).alias("point"), "doc_id", F.lit(0).alias("n"), F.col("source").alias("line"), F.lit("active").alias("status")))
    t.patch(points.where("doc_id % 10 = 5").select("point", F.lit("archived").alias("status")), ["status"])
    t.delete(points.where("doc_id % 10 = 7").select("point"))
    return t.rows().select("doc_id", "n", "line", "status")


@query("w8_touch", "SELECT event_id, CASE WHEN event_id % 5 = 0 OR ts < TIMESTAMP '2024-01-30 23:00:00' THEN TIMESTAMP '2024-01-30 23:01:00' ELSE ts END AS last_accessed FROM events")
def w8(spark, sf_dir):
    last = F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", upserts.touch(last, F.lit("2024-01-30 23:01:00").cast("timestamp")).alias("last_accessed"))


@query("w9_ttl", "SELECT event_id FROM events WHERE event_id % 3 = 0 OR ts + INTERVAL 7 DAY >= TIMESTAMP '2024-02-01'")
def w9(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("expires", F.when(F.col("event_id") % 3 != 0, F.col("ts").cast("timestamp")))
    return upserts.unexpired(e, "expires", F.lit("2024-02-01").cast("timestamp"), 7).select("event_id")


@query("w10_x3_event_expiry", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN NULL WHEN event_type = 'error' THEN ts + INTERVAL 24 HOUR ELSE ts + INTERVAL 30 DAY END AS expires_at FROM events")
def w10(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.unionByName(e.where("event_id % 10 = 0")).dropDuplicates(["event_id"])
    at = lambda p: upserts.expiry(F.col("ts"), p)
    return e.select("event_id", F.when(F.col("event_type") == "purchase", at("forever")).when(F.col("event_type") == "error", at("24h")).otherwise(at("30d")).alias("expires_at"))


@query("s4_s5_incremental", "WITH m AS (SELECT user_id, max(ts) AS last FROM events WHERE event_id % 4 <> 0 GROUP BY user_id) SELECT e.event_id FROM events e LEFT JOIN m USING (user_id) WHERE m.last IS NULL OR e.ts > m.last")
def s4(spark, sf_dir):
    """Rows strictly after the last synchronised one of their source."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    last = e.where("event_id % 4 <> 0").groupBy("user_id").agg(F.max("ts").alias("last"))
    return e.join(last, "user_id", "left").where("last is null or ts > last").select("event_id")


@query("s16_scroll", "SELECT doc_id, source, 1.0::DOUBLE AS score FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100")
def s16(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source", F.lit(1.0).alias("score")).orderBy("doc_id").limit(100)


@query("s17_unsynced", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def s17(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("s18_due_connections", "SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS due FROM customer) WHERE due IS NULL OR due <= 1000 ORDER BY due NULLS FIRST, c_custkey LIMIT 50")
def s18(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("due"))
    return c.where("due is null or due <= 1000").orderBy(F.asc_nulls_first("due"), "c_custkey").limit(50).select("c_custkey")


@query("s19_missing_values", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def s19(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left").where("quality is null").select("doc_id")


@query("s20_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100")
def s20(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(100).select("doc_id")


@query("a19_words_by_source", f"SELECT source, sum(len({WORDS_SQL.format(x='text')}))::BIGINT AS n_words, count(*) AS n_docs FROM documents GROUP BY source")
def a19(spark, sf_dir):
    from lodestream.functions.text import words

    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.size(words(F.col("text")))).alias("n_words"), F.count("*").alias("n_docs"))


@query("r14_r15_context", "SELECT source, doc_id, used::BIGINT AS used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM (SELECT *, row_number() OVER (PARTITION BY source, substr(text, 1, 200) ORDER BY doc_id) AS r FROM documents) WHERE r = 1) WHERE used <= 30000")
def r15(spark, sf_dir):
    """Fragments of a source without those that begin alike, as many as a budget of characters holds."""
    from lodestream.operators.ranking import budget_prefix, first_by

    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.sha2(F.substring("text", 1, 200), 256).alias("head"))
    return budget_prefix(first_by(d, ["source", "head"], [F.col("doc_id")]), ["source"], "doc_id", F.col("n_chars"), 30000).select("source", "doc_id", "used")

