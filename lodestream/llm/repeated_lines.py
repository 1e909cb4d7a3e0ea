"""Line dedup: lines that many documents have go from all of them but one.

A text is split at line feeds; a line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and
with A-Z lower-cased. Keys of MIN_CHARS code points or more that stand in MIN_DOCUMENTS documents or more
lose all their lines but those of the largest doc_id that has them. The other lines stay and are
joined by line feeds again.

Keys travel as 128-bit hashes. A key's documents are made distinct first, dealt out by key and document, and
then counted by partial sums, so a line of a third of all documents meets no one task. Keys of many documents are
looked up by broadcast, of which there can only be so many, the others by a join. Documents get the
positions of what they lose, and each is put together in its own row.

Defined results: a null or empty text is one empty line; rows alike in doc_id and text have equal
results, one each, and count as one document, as do all rows of one doc_id; a null doc_id is a document
too and ranks below all others; a text whose lines are all dropped becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import discard, written

MIN_CHARS, MIN_DOCUMENTS = 20, 3
#: Keys that stand in this share of all lines or more, so 4,096 at most, are looked up by broadcast.
HOT_SHARE = 1 / 4096
# What is stripped from lines, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _own(text: Column) -> Column:
    """A hash that tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _parts(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keyed_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, own (a hash of the text), at (position from 0) and the key's hash as hi, lo of all lines that are long enough."""
    split = documents.select("doc_id", _own(F.col("text")).alias("own"), _parts(F.col("text")).alias("parts"))  # once a text, not once a line
    lines = split.select("doc_id", "own", F.posexplode("parts").alias("at", "line"))
    keyed = lines.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "own", "at", F.xxhash64("key").alias("hi"), F.xxhash64(F.lit(1), "key").alias("lo"))


def common_keys(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """hi, lo, n_documents and last (the largest doc_id) of the keys that stand in so many documents."""
    once = lines.select("hi", "lo", "doc_id").distinct()
    return once.groupBy("hi", "lo").agg(F.count("*").alias("n_documents"), F.max("doc_id").alias("last")).where(F.col("n_documents") >= min_documents)


def _cut(documents: DataFrame, min_chars: int, min_documents: int) -> DataFrame:
    """row (a struct of the documents' columns), parts (its lines) and kept (the positions that stay; null: all)."""
    lines = written(keyed_lines(documents, min_chars))
    common = written(common_keys(lines, min_documents))
    many = F.col("n_documents") >= max(1000.0, lines.count() * HOT_SHARE)
    hot, rest = (common.where(c).select("hi", "lo", "last") for c in (many, ~many))
    found = lines.join(F.broadcast(hot), ["hi", "lo"]).unionByName(lines.join(F.broadcast(hot), ["hi", "lo"], "left_anti").join(rest, ["hi", "lo"]))
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("doc_id", "own").agg(F.collect_set("at").alias("gone"))
    gone = written(gone)
    discard(lines, common)
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.col("doc_id").alias("id"), _own(F.col("text")).alias("own"))
    met = rows.join(gone.withColumnsRenamed({"doc_id": "gone_id", "own": "gone_own"}), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("own") == F.col("gone_own")), "left")
    met = met.select("row", _parts(F.col("row")["text"]).alias("parts"), "gone")
    return met.withColumn("kept", F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone"))).drop("gone")


def _text() -> Column:
    left = F.array_join(F.transform("kept", lambda i: F.get("parts", i)), "\n")
    return F.when(F.col("kept").isNull(), F.col("row")["text"]).otherwise(left)


def dedup(documents: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """documents without the lines that go; other columns as they were."""
    out = _cut(documents, min_chars, min_documents)
    return out.select(*[_text().alias(c) if c == "text" else F.col("row")[c].alias(c) for c in documents.columns])


def digest(documents: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row."""
    out = _cut(documents.select("doc_id", "text"), min_chars, min_documents)
    n = F.size("parts").cast("long")
    dropped = F.when(F.col("kept").isNull(), F.lit(0).cast("long")).otherwise(n - F.size("kept"))
    return out.select(F.col("row")["doc_id"].alias("doc_id"), n.alias("n_lines"), dropped.alias("n_dropped"), F.sha2(F.coalesce(_text(), F.lit("")), 256).alias("kept_sha256"))


COMMON_LINES_SQL = rf"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS k FROM numbered),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS last FROM (SELECT DISTINCT key, doc_id FROM keyed WHERE length(key) >= {MIN_CHARS}) GROUP BY key HAVING count(*) >= {MIN_DOCUMENTS}),
marked AS (SELECT r, keyed.doc_id, k, line, common.key IS NOT NULL AND keyed.doc_id IS DISTINCT FROM last AS gone FROM keyed LEFT JOIN common ON keyed.key = common.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
