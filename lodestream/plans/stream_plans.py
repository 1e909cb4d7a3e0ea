"""Streaming plans replayed over the whole events table, and sources over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestream.operators.storage import shared_dir, written
from lodestream.plans.registry import query, table
from lodestream.sources import connectors, datasource
from lodestream.streaming import events as E
from lodestream.streaming import session_cache


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _input(spark, sf_dir) -> str:
    """The events table, twice, as a folder of files: replays and repeats."""
    path = _folder(spark)
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(path)
    e.write.mode("append").parquet(path)
    return path


def _replay(spark, sf_dir, plan):
    """All output rows of a plan over the replayed stream."""
    out, path = _folder(spark), _input(spark, sf_dir)
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.shuffle.partitions", "4")
    q = plan(E.read_events(own, path), out)
    q.awaitTermination()
    return spark.read.parquet(out)


@query("x1_w10_idempotent_append", "SELECT event_id, event_type FROM events")
def x1(spark, sf_dir):
    got = _replay(spark, sf_dir, lambda s, out: E.append(E.once_each(s, late="60 days"), out, _folder(spark)))
    return got.select("event_id", "event_type")


@query("x5_micro_batch_jobs", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def x5(spark, sf_dir):
    count = lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"))
    got = _replay(spark, sf_dir, lambda s, out: E.run_jobs(s, count, out, _folder(spark)))
    return got.groupBy("event_type").agg(F.sum("n").alias("n"))


@query("x8_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= ts - INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def x8(spark, sf_dir):
    """The batch form of the streaming plan: the same code over a table."""
    return E.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))


_CACHE_SQL = """
WITH RECURSIVE r AS (SELECT user_id, event_type, max(ts) AS cached_at FROM events WHERE event_type <> 'view' GROUP BY ALL), x AS (SELECT user_id, ts FROM events WHERE event_type = 'view'),
live(user_id, event_type, cached_at, expires, after) AS (SELECT user_id, event_type, cached_at, cached_at + INTERVAL 12 HOUR, cached_at FROM r
UNION ALL SELECT l.user_id, event_type, cached_at, x.ts + INTERVAL 12 HOUR, x.ts FROM live l, LATERAL (SELECT min(ts) AS ts FROM x WHERE x.user_id = l.user_id AND x.ts > l.after AND x.ts < l.expires) x WHERE x.ts IS NOT NULL)
SELECT user_id AS session, event_type AS record, cached_at, max(expires) AS expires FROM live GROUP BY ALL"""


@query("x4_session_cache", _CACHE_SQL)
def x4(spark, sf_dir):
    """Users as sessions and types of events as records; views extend what their user has cached."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("record"), F.col("ts").cast("timestamp").alias("at"))
    return E.cached_records(e.where("record <> 'view'"), e.where("record = 'view'").select("session", "at"), "12 hours")


@query("x4_session_cache_stream", _CACHE_SQL)
def x4_stream(spark, sf_dir):
    """The same cache as streaming state: the log comes in three parts, each by a query that starts from the state where the one before stopped."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.when(F.col("event_type") == "view", "extend").otherwise("cache").alias("op"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("record"), F.col("ts").cast("timestamp").alias("at"), F.lit(43_200).cast("long").alias("ttl_seconds"))
    span = e.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    path, out, state = _folder(spark), _folder(spark), _folder(spark)
    if span.low is None:
        return e.limit(0).select("session", "record", F.col("at").alias("cached_at"), F.col("at").alias("expires"))
    own = spark.newSession()
    for k, v in {**session_cache.STATE_STORE, "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(max(4, 2 * spark.sparkContext.defaultParallelism))}.items():
        own.conf.set(k, v)
    third = (F.unix_micros("at") - F.unix_micros(F.lit(span.low))) * 3 / (F.unix_micros(F.lit(span.high)) - F.unix_micros(F.lit(span.low)) + 1)
    for part in range(3):
        e.where(F.floor(third) == part).write.mode("append").parquet(path)
        if part == 2:  # a last row, of no user, lets the watermark pass all others
            spark.range(1).select(F.lit(-1).cast("long").alias("session"), F.lit("extend").alias("op"), F.lit(None).cast("string").alias("record"), (F.lit(span.high) + F.expr("interval 30 days")).alias("at"), F.lit(0).cast("long").alias("ttl_seconds")).write.mode("append").parquet(path)
        log = own.readStream.schema(session_cache.LOG_SCHEMA).parquet(path)
        session_cache.write_changes(session_cache.cache_changes(log), out, state).awaitTermination()
    return session_cache.latest(spark.read.schema(session_cache.OUT_SCHEMA).parquet(out))


@query("x6_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def x6(spark, sf_dir):
    return E.windows(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").withColumn("value", F.round("value", 4))


@query("s1_s10_connectors", "SELECT 'gdrive' AS source_type, doc_id::VARCHAR AS source_id, source AS title, md5(text) AS digest FROM documents")
def s10(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"), "text")).alias("value"))
    return connectors.read("gdrive", raw).select("source_type", "source_id", "title", F.md5("content").alias("digest"))


# Documents as issues: each line is a paragraph, every third line an item of a list of lists; a comment for each word of the language, and twelve changes.
_ISSUE_SQL = r"""
lined AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
described AS (SELECT doc_id, trim(array_to_string(list_transform(l, lambda x, i: CASE WHEN i % 3 = 0 THEN CASE WHEN x = '' THEN chr(10) ELSE x || chr(10) END || chr(10) || chr(10) WHEN x = '' THEN chr(10) ELSE x || chr(10) END), ''), ' ' || chr(9) || chr(10) || chr(13)) AS d FROM lined)
SELECT 'DOC-' || doc_id AS source_id, '[DOC-' || doc_id || '] ' || source AS title,
  md5('# [DOC-' || doc_id || '] ' || source || chr(10) || chr(10) || '**Status:** ' || lang || chr(10) || '**Reporter:** ' || source || chr(10) || '**Updated:** 2024-01-0' || (doc_id % 9 + 1) || 'T00:00:00' || chr(10) || chr(10)
  || CASE WHEN d <> '' THEN '## Description' || chr(10) || chr(10) || d || chr(10) || chr(10) ELSE '' END
  || '## Comments' || chr(10) || chr(10) || '**' || lang || '** (2024):' || chr(10) || 'about ' || chr(10) || source || chr(10) || chr(10)
  || '## Changelog' || chr(10) || chr(10) || array_to_string(list_transform(generate_series(3, 12), lambda k: '- 2024: ' || source || ' changed **n**: ' || (k - 1) || ' → ' || k), chr(10)) || chr(10)) AS digest
FROM documents JOIN described USING (doc_id) WHERE doc_id % 9 >= 4"""


def _issues(spark, sf_dir):
    """Raw issues, as JSON objects."""
    node = lambda kind, *content: F.struct(F.lit(kind).alias("type"), F.array(*content).alias("content"))
    text = lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"), F.array(F.struct(F.lit("strong").alias("type"))).alias("marks"))
    paragraph = lambda x: F.to_json(node("paragraph", text(x)))
    wrapped = lambda inner, kind: F.concat(F.lit(f'{{"type":"{kind}","content":['), inner, F.lit("]}"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 3 == 0, wrapped(wrapped(paragraph(x), "listItem"), "bulletList")).otherwise(paragraph(x)))
    docs = table(spark, sf_dir, "documents").withColumn("body", wrapped(F.array_join(lines, ","), "doc"))
    comment = F.to_json(F.struct(F.struct(F.col("lang").alias("displayName")).alias("author"), F.lit("2024").alias("created"), node("doc", node("paragraph", text(F.lit("about ")), text(F.col("source")))).alias("body")))
    change = lambda k: F.struct(F.struct(F.col("source").alias("displayName")).alias("author"), F.lit("2024").alias("created"), F.array(F.struct(F.lit("n").alias("field"), (k - 1).cast("string").alias("fromString"), k.cast("string").alias("toString"))).alias("items"))
    changes = F.to_json(F.transform(F.sequence(F.lit(1), F.lit(12)), change))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    updated = F.concat(F.lit("2024-01-0"), F.col("doc_id") % 9 + 1, F.lit("T00:00:00"))
    value = F.concat(
        F.lit('{"key":"DOC-'), "doc_id", F.lit('","fields":{"summary":'), quoted(F.col("source")), F.lit(',"status":{"name":'), quoted(F.col("lang")), F.lit('},"reporter":{"displayName":'), quoted(F.col("source")),
        F.lit('},"updated":'), quoted(updated), F.lit(',"comment":{"comments":['), comment, F.lit(']},"description":'), "body", F.lit('},"changelog":{"histories":'), changes, F.lit("}}"),
    )
    return docs.select(value.alias("value"))


@query("s6_jira_issues", "WITH " + _ISSUE_SQL.strip())
def s6(spark, sf_dir):
    """All documents as issues with rich text; those changed after a day."""
    got = connectors.read("jira", _issues(spark, sf_dir), F.lit("2024-01-04").cast("timestamp"))
    return got.select("source_id", "title", F.md5("content").alias("digest"))


@query("s8_notion_pages", r"""
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id::VARCHAR AS source_id, md5(array_to_string(list_transform(l, lambda x, i: CASE i % 4 WHEN 0 THEN '1. ' || x WHEN 1 THEN x || chr(10) || chr(10) || '- ' || x || chr(10) || chr(10) || '- [x] ' || x WHEN 2 THEN '```sql' || chr(10) || x || chr(10) || '```' ELSE '| ' || x || ' | ' || x || ' |' END), chr(10) || chr(10))) AS digest FROM l""")
def s8(spark, sf_dir):
    """All documents as pages of nested blocks: paragraphs with an item that has a task inside, code, numbered items, rows of tables."""
    rich = lambda x: F.array(F.struct(x.alias("plain_text")))
    text = lambda x: F.struct(rich(x).alias("rich_text"))
    task = lambda x: F.struct(F.lit("to_do").alias("type"), F.struct(rich(x).alias("rich_text"), F.lit(True).alias("checked")).alias("to_do"))
    item = lambda x: F.struct(F.lit("bulleted_list_item").alias("type"), text(x).alias("bulleted_list_item"), F.array(task(x)).alias("children"))
    blocks = F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""), lambda x, i: F.when((i + 1) % 4 == 0, F.to_json(F.struct(F.lit("numbered_list_item").alias("type"), text(x).alias("numbered_list_item"))))
        .when((i + 1) % 4 == 1, F.to_json(F.struct(F.lit("paragraph").alias("type"), text(x).alias("paragraph"), F.array(item(x)).alias("children"))))
        .when((i + 1) % 4 == 2, F.to_json(F.struct(F.lit("code").alias("type"), F.struct(rich(x).alias("rich_text"), F.lit("sql").alias("language")).alias("code"))))
        .otherwise(F.to_json(F.struct(F.lit("table_row").alias("type"), F.struct(F.array(rich(x), rich(x)).alias("cells")).alias("table_row")))))
    raw = table(spark, sf_dir, "documents").select(F.concat(F.lit('{"id":"'), "doc_id", F.lit('","blocks":['), F.array_join(blocks, ","), F.lit("]}")).alias("value"))
    return connectors.read("notion", raw).select("source_id", F.md5("content").alias("digest"))


# Raw objects of each connector, made of the given tables: a name, the objects' columns, and the SQL of (source_type, source_id, title, updated_at).
_PAGES = {
    "confluence": ("pages", "page_id", """SELECT 'confluence' AS source_type, page_id::VARCHAR AS source_id, 'Page ' || page_id AS title, TIMESTAMP '2024-01-01' + to_days((page_id % 28)::INT) AS updated_at FROM pages"""),
    "notion": ("documents", "doc_id", """SELECT 'notion', doc_id::VARCHAR, source, TIMESTAMP '2024-01-01' + to_days((doc_id % 28)::INT) FROM documents"""),
    "github": ("orders", "o_orderkey", """SELECT 'github', 'shop#' || CASE o_orderstatus WHEN 'F' THEN 'pr' WHEN 'O' THEN 'issue' ELSE 'release' END || '/' || o_orderkey, o_orderpriority, TIMESTAMP '2024-01-01' + to_days((o_orderkey % 28)::INT) FROM orders"""),
    "gdrive": ("part", "p_partkey", """SELECT 'gdrive', p_partkey::VARCHAR, p_name, TIMESTAMP '2024-01-01' + to_days((p_partkey % 28)::INT) FROM part"""),
    "jira": ("customer", "c_custkey", """SELECT 'jira', 'C-' || c_custkey, '[C-' || c_custkey || '] ' || c_name, TIMESTAMP '2024-01-01' + to_days((c_custkey % 28)::INT) FROM customer"""),
}


def _objects(spark, sf_dir, kind):
    """(id, value): raw objects of a connector."""
    name, key, _ = _PAGES[kind]
    at = F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(F.col(key) % 28).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    one = lambda c, alias: F.struct(c.alias(alias))
    id_ = F.col(key).cast("string")
    fields = {
        "confluence": lambda: [id_.alias("id"), F.concat(F.lit("Page "), id_).alias("title"), one(one(F.col("html"), "value"), "storage").alias("body"), one(at, "when").alias("version")],
        "notion": lambda: [id_.alias("id"), F.col("source").alias("title"), at.alias("last_edited_time")],
        "github": lambda: [F.lit("shop").alias("repository"), F.when(F.col("o_orderstatus") == "P", id_).alias("tag_name"), F.when(F.col("o_orderstatus") != "P", F.col(key)).alias("number"), F.when(F.col("o_orderstatus") == "F", at).alias("merged_at"), F.col("o_orderpriority").alias("title"), at.alias("updated_at")],
        "gdrive": lambda: [id_.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("text"), at.alias("modifiedTime")],
        "jira": lambda: [F.concat(F.lit("C-"), id_).alias("key"), F.struct(F.col("c_name").alias("summary"), at.alias("updated")).alias("fields")],
    }[kind]()
    return table(spark, sf_dir, name).select(F.col(key).alias("id"), F.to_json(F.struct(*fields)).alias("value"))


@query("s1_s2_connector_batches", "SELECT * FROM (" + " UNION ALL ".join(sql for _, _, sql in _PAGES.values()) + ") WHERE updated_at > TIMESTAMP '2024-01-10'")
def s2(spark, sf_dir):
    """Every connector through the data source: what has changed after a day, which the reader itself leaves out."""
    out = None
    for kind in _PAGES:
        path = _folder(spark)
        _objects(spark, sf_dir, kind).select("value").write.text(path)
        docs, _ = datasource.sync(spark, kind, {"path": path}, since="2024-01-10 00:00:00")
        docs = written(docs.select("source_type", "source_id", "title", "updated_at"))
        out = docs if out is None else out.unionByName(docs)
    return out


@query("s3_connector_streams", " UNION ALL ".join(sql for _, _, sql in _PAGES.values()))
def s3(spark, sf_dir):
    """Every connector as a stream that is resumed: half of the objects come, the stream stops, the others come, and it goes on from its cursor."""
    out = None
    for kind in _PAGES:
        path, docs, state = _folder(spark), _folder(spark), _folder(spark)
        raw = _objects(spark, sf_dir, kind)
        for half in (0, 1):
            raw.where(F.pmod(F.xxhash64("id"), F.lit(2)) == half).select("value").write.text(f"{path}/{half}")
            datasource.follow(spark, kind, {"path": path}, docs, state).awaitTermination()
        found = spark.read.parquet(docs).select("source_type", "source_id", "title", "updated_at")
        out = found if out is None else out.unionByName(found)
    return out


@query("w16_w19_exported_lines", "SELECT doc_id, md5(text) AS digest FROM documents WHERE lang = 'en'")
def w19(spark, sf_dir):
    """JSON lines written and read again."""
    from lodestream.sources.files import jsonl

    path = _folder(spark)
    jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, F.col("lang") == "en")
    return spark.read.schema("doc_id long, text string").json(path).select("doc_id", F.md5("text").alias("digest"))


@query("w16_archives", "SELECT source || '/documents/' || lang || '/' || doc_id || '.md' AS name, md5('# ' || source || chr(10) || chr(10) || text) AS digest FROM documents UNION ALL SELECT 'manifest', count(*)::VARCHAR FROM documents")
def w16(spark, sf_dir):
    """All documents as Markdown files in ZIP shards, read back, and what the manifest counts."""
    from lodestream.sources import archive

    path = _folder(spark)
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/documents/"), "lang", F.lit("/"), "doc_id", F.lit(".md")).alias("name"), F.concat(F.lit("# "), "source", F.lit("\n\n"), "text").alias("content"))
    manifest = archive.export(d, path)
    told = spark.range(1).select(F.lit("manifest").alias("name"), F.lit(str(manifest["entries"])).alias("digest"))
    return archive.read(spark, path).select("name", F.md5("content").alias("digest")).unionByName(told)


@query("w17_w18_snapshot_round_trip", "SELECT p_partkey, p_name, p_size FROM part")
def w17(spark, sf_dir):
    from lodestream.sources import snapshots

    path = _folder(spark)
    snapshots.create(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), path, "before")
    return snapshots.restore(spark, path)
