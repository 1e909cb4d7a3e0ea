"""Substring dedup by sentences and lines: equal normalised units keep their earliest occurrence.

A unit is a run of words up to a line's end or a word that ends in a full stop, exclamation or
question mark; a run of more than LONG_UNIT words ends after each word of 5, 10, 15 ... characters too, so that
passages that begin or end inside of long sentences have the same units wherever they stand. A unit is normalised by lower-casing A-Z and taking white space as single spaces,
and known by a 128-bit digest. Occurrences are ranked by doc_id, then a hash of the text, then
place; the first of a digest is the original. Units in a row that are all later copies make a
run; a run whose different units have MIN_RUN_WORDS words or more is removed, with its place in
the original text kept. Shorter ones stay: common lines and phrases are no copied passages, and
a phrase that is repeated on and on counts once.

Defined results: null and empty texts have no units; rows alike in doc_id and text are one
document, so repeated rows stay or go alike and have one result; a null doc_id ranks first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import Texts, discard, mix, ship, texts_of, written

MIN_RUN_WORDS = 30
#: Runs of more words are cut by their contents, after words whose number of characters is a multiple of CUT_LENGTH.
LONG_UNIT, CUT_LENGTH = 16, 5
#: Digests of this share of all units or more, a bounded number, are looked up by broadcast.
HOT_SHARE = 1 / 4096
_UNITS = "doc_id long, own long, unit int, words int, start int, stop int, hi long, lo long"
_MULT = 0xC2B2AE3D27D4EB4F
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def _own(text: Column) -> Column:
    """A hash that tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _sequence_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the runs h[first:last]: equal runs give equal hashes."""
    n = len(h)
    up = np.full(n + 1, _MULT, dtype=np.uint64)
    down = np.full(n + 1, pow(_MULT, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(h + np.uint64(salt)) * up[:n], out=total[1:])
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(salt | 1))


def units_of(texts: Texts) -> dict[str, np.ndarray]:
    """text, unit, words, start, stop (code points), hi, lo of the units of some texts."""
    lower = texts.lowered()
    starts, ends = lower.words()
    if not len(starts):
        none = np.zeros(0, np.int64)
        return dict.fromkeys(("text", "unit", "words", "start", "stop", "hi", "lo"), none)
    h, owner = lower.span_hashes(starts, ends), texts.doc_of(starts)
    newlines = np.concatenate([[0], np.cumsum(texts.data == 10)])
    cut = _ENDS[texts.data[ends - 1]]
    cut[:-1] |= (owner[1:] != owner[:-1]) | (newlines[starts[1:]] != newlines[ends[:-1]])
    cut[-1] = True
    points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    last = np.flatnonzero(cut) + 1
    cut |= np.repeat(np.diff(last, prepend=0) > LONG_UNIT, np.diff(last, prepend=0)) & ((points[ends] - points[starts]) % CUT_LENGTH == 0)
    last = np.flatnonzero(cut) + 1
    first = np.concatenate([[0], last[:-1]])
    text = owner[first]
    zero = points[texts.offsets[text]]
    return {
        "text": text, "unit": np.arange(len(text)) - np.searchsorted(text, text), "words": last - first, "start": points[starts[first]] - zero, "stop": points[ends[last - 1]] - zero,
        "hi": _sequence_hashes(h, first, last, 0x1F83D9ABFB41BD6B).view(np.int64), "lo": _sequence_hashes(h, first, last, 0x5BE0CD19137E2179).view(np.int64),
    }


def units(documents: DataFrame) -> DataFrame:
    """A row for each unit, and one of unit -1 for each document, whose words are its number of units."""
    names = ["doc_id", "own", "unit", "words", "start", "stop", "hi", "lo"]

    def run(batches):
        for batch in batches:
            ids, own = batch.column("doc_id"), batch.column("own")
            for first, texts in texts_of(batch.column("text")):
                u, n = units_of(texts), texts.n
                zero, at = np.zeros(n, np.int64), pa.array(u["text"])
                both = {**{k: zero for k in names[4:]}, "unit": zero - 1, "words": np.bincount(u["text"], minlength=n)}
                columns = [np.concatenate([both[k], u[k]]) for k in names[2:]]
                arrays = [pa.concat_arrays([c.slice(first, n), c.slice(first, n).take(at)]) for c in (ids, own)]
                arrays += [pa.array(c.astype(np.int32) if k not in ("hi", "lo") else c) for k, c in zip(names[2:], columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), _own(F.col("text")).alias("own"), "text").mapInArrow(run, _UNITS)


def _later(own: DataFrame, first: DataFrame) -> DataFrame:
    """The units that are not the first of their digest. Digests of many units meet no one task."""
    n = own.count()
    hot = F.broadcast(first.where(F.col("n") >= max(1000.0, n * HOT_SHARE)).select("hi", "lo", "first"))
    rest = first.where(F.col("n") < max(1000.0, n * HOT_SHARE)).select("hi", "lo", "first")
    met = own.join(hot, ["hi", "lo"]).unionByName(own.join(hot, ["hi", "lo"], "left_anti").join(rest, ["hi", "lo"]))
    return met.where(~F.struct("doc_id", "own", "unit").eqNullSafe(F.col("first"))).drop("first")


def removals(documents: DataFrame, min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """doc_id, own, n_units, n_removed (units), removed_chars, removed (array of start, stop in order) for each document; own is a hash of its text."""
    found = written(units(documents))
    own = found.where("unit >= 0")
    first = own.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "own", "unit")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(first)
    place = Window.partitionBy("doc_id", "own").orderBy("unit")
    runs = _later(own, first).withColumn("run", F.col("unit") - F.dense_rank().over(place)).groupBy("doc_id", "own", "run").agg(
        F.struct(F.min("start").alias("start"), F.max("stop").alias("stop")).alias("span"), (F.max("unit") - F.min("unit") + 1).alias("units"), F.collect_set(F.struct("hi", "lo", "words")).alias("different")
    )
    runs = runs.where(F.aggregate("different", F.lit(0), lambda a, x: a + x["words"]) >= min_run_words)
    none = F.lit(None).cast("struct<start:int,stop:int>")
    marks = found.where("unit < 0").select("doc_id", "own", F.col("words").alias("n_units"), F.lit(0).alias("units"), none.alias("span"))
    both = marks.unionByName(runs.select("doc_id", "own", F.lit(None).cast("int").alias("n_units"), "units", "span"))
    out = both.groupBy("doc_id", "own").agg(F.max("n_units").cast("long").alias("n_units"), F.sum("units").alias("n_removed"), F.array_sort(F.collect_list("span")).alias("removed"))
    chars = F.aggregate("removed", F.lit(0), lambda a, s: a + s["stop"] - s["start"]).cast("long")
    out = written(out.select("doc_id", "own", "n_units", "n_removed", chars.alias("removed_chars"), "removed"))
    discard(found, first)
    return out


def cut_spans(text, spans):
    """text without its spans (ordered, apart)."""
    kept = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(s["stop"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"])).alias("out")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, kept).otherwise(text)


def dedup(documents: DataFrame, min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """documents with the later copies of passages cut out of text; other columns as they were."""
    gone = removals(documents, min_run_words).where("n_removed > 0").select(F.col("doc_id").alias("lodestream_id_"), F.col("own").alias("lodestream_own_"), F.col("removed").alias("lodestream_spans_"))
    out = documents.join(gone, F.col("doc_id").eqNullSafe(F.col("lodestream_id_")) & (_own(F.col("text")) == F.col("lodestream_own_")), "left")
    text = F.when(F.col("lodestream_spans_").isNull(), F.col("text")).otherwise(cut_spans(F.col("text"), F.col("lodestream_spans_")))
    return out.withColumn("text", text).select(*documents.columns)


def digest(documents: DataFrame, min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    out = removals(documents, min_run_words).drop("own")
    return out.withColumn("removed", F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["stop"])), ","))


LINES_SQL = rf"""
WITH pieces AS (
  SELECT doc_id, text, p, k, sum(length(p)) OVER (PARTITION BY doc_id, text ORDER BY k) - length(p) AS zero
  FROM (SELECT doc_id, text, unnest(parts) AS p, generate_subscripts(parts, 1) AS k
        FROM (SELECT DISTINCT doc_id, text, string_split(replace(regexp_replace(text, '([.!?])([\x20\x09\x0B-\x0D])', '\1' || chr(1) || '\2', 'g'), chr(10), chr(1) || chr(10)), chr(1)) AS parts
              FROM documents WHERE coalesce(text, '') <> ''))),
tokens AS (
  SELECT doc_id, text, k, t, j, zero + sum(length(t)) OVER (PARTITION BY doc_id, text, k ORDER BY j) - length(t) AS start
  FROM (SELECT doc_id, text, k, zero, unnest(toks) AS t, generate_subscripts(toks, 1) AS j FROM (SELECT *, regexp_extract_all(p, '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS toks FROM pieces))),
words AS (
  SELECT *, coalesce(sum((n > {LONG_UNIT} AND length(t) % {CUT_LENGTH} = 0)::INT) OVER (PARTITION BY doc_id, text, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, text, k) AS n FROM tokens WHERE regexp_matches(t, '^[^\x20\x09-\x0D]'))),
units AS (
  SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id, text ORDER BY k, part) - 1 AS unit, count(*) AS words, min(start) AS start, max(start + length(t)) AS stop,
         translate(string_agg(t, ' ' ORDER BY j), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM words GROUP BY doc_id, text, k, part),
ranked AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS FIRST, unit) AS rank FROM units),
later AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id, text ORDER BY unit) AS run FROM ranked WHERE rank > 1),
runs AS (
  SELECT doc_id, text, run, min(start) AS start, max(stop) AS stop, count(*) AS units, sum(words) FILTER (new) AS words
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text, run, norm ORDER BY unit) = 1 AS new FROM later)
  GROUP BY doc_id, text, run HAVING sum(words) FILTER (new) >= {MIN_RUN_WORDS}),
gone AS (
  SELECT doc_id, text, sum(units) AS n_removed, sum(stop - start) AS removed_chars, string_agg(start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start) AS removed
  FROM runs GROUP BY doc_id, text),
sizes AS (SELECT doc_id, text, count(*) AS n_units FROM units GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(u.n_units, 0)::BIGINT AS n_units, coalesce(g.n_removed, 0)::BIGINT AS n_removed, coalesce(g.removed_chars, 0)::BIGINT AS removed_chars, coalesce(g.removed, '') AS removed
FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents) d LEFT JOIN sizes u ON d.doc_id IS NOT DISTINCT FROM u.doc_id AND d.text = u.text LEFT JOIN gone g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.text = g.text
"""
