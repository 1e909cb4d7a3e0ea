"""Fill-in-the-middle: a text is cut in three and put in another order between sentinels, so that it can be put together again.

Only Spark SQL functions. The units of a text are its code points, as an array that
``regexp_extract_all`` makes; the cuts and the form come from 32-bit groups of the SHA-256 of
``1:`` and the decimal doc_id, so a document is always cut alike, on any machine and in any order.
A row needs nothing of any other row: nothing is shuffled.

Defined results: a null text is the empty one, which stays plain; a text that holds a sentinel stays
plain, for it could not be taken apart; a null doc_id hashes as ``1:`` alone. Rows alike in doc_id and
text have equal results, one each. The array has some tens of bytes a code point while a row is worked
on: a text of some millions of code points fits an executor's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sentinels, and of 100 texts how many are moved at all and how many of these suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MOVED, SUFFIX_FIRST = 90, 20


def code_points(text: Column) -> Column:
    """The array of a text's code points; line ends are code points like all others."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def hash_group(digest: Column, group: int) -> Column:
    """The group-th 8 hexadecimal digits of a digest, counted from 1, as an unsigned number."""
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def form_of(text: Column, digest: Column) -> Column:
    """plain, psm or spm."""
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (hash_group(digest, 3) % 100 >= MOVED)
    return F.when(plain, "plain").when(hash_group(digest, 4) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")


def restore(output: Column, form: Column) -> Column:
    """The text that output was made of. Sentinels stand only where they were put, so each is met once."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    prefix, suffix = F.when(form == "spm", part[2]).otherwise(part[1]), F.when(form == "spm", part[1]).otherwise(part[2])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part[3], suffix))


def transform(documents: DataFrame) -> DataFrame:
    """documents with their columns but text as output, and n, form, prefix_chars and middle_chars (null if plain).

    Columns of the input that have one of these names give way to the new ones.
    """
    row = F.struct(*[F.col(c) for c in documents.columns])
    work = documents.select(row.alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("digest"))
    work = work.withColumn("form", form_of(F.col("text"), F.col("digest"))).withColumn("n", F.char_length("text").cast("long"))
    cuts = [hash_group(F.col("digest"), k) % (F.col("n") + 1) for k in (1, 2)]
    work = work.withColumns({"first": F.least(*cuts), "last": F.greatest(*cuts)})
    plain = F.col("form") == "plain"
    work = work.withColumn("units", F.when(~plain, code_points(F.col("text"))))
    run = lambda start, length: F.array_join(F.slice("units", start.cast("int") + 1, length.cast("int")), "")
    prefix, middle, suffix = run(F.lit(0), F.col("first")), run(F.col("first"), F.col("last") - F.col("first")), run(F.col("last"), F.col("n") - F.col("last"))
    work = work.withColumns({"prefix": prefix, "middle": middle, "suffix": suffix})
    output = F.when(plain, F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")).otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
    new = {"n": F.col("n"), "form": F.col("form"), "prefix_chars": F.when(~plain, F.col("first")), "middle_chars": F.when(~plain, F.col("last") - F.col("first")), "output": output}
    kept = [F.col("row")[c].alias(c) for c in documents.columns if c != "text" and c not in new]
    return work.select(*kept, *[c.alias(name) for name, c in new.items()])


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for each row."""
    out = transform(documents.select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


INFILL_SQL = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM hashed),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
