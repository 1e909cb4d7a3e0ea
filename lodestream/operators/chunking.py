"""Chunks of texts: sentences gathered greedily with overlap, roots with children, fixed widths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.text import clean_markup, estimate_tokens_by_script, sentences

CHUNK, OVERLAP, ROOT = 1500, 200, 256
_SCHEMA = "doc_id long, position int, chunk_type string, content string, token_count long"


def fixed_width(text: Column, most: int = 2500, overlap: int = 200) -> Column:
    """Pieces of most characters, each starting overlap characters before the last ended."""
    start = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(most - overlap))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.transform(start, lambda i: F.substring(text, i + 1, F.lit(most))))


def _windows(cost: list[int], most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of items: as many as fit, at least one; the next span goes back over as many as the overlap holds."""
    total = np.concatenate([[0], np.cumsum(cost)])
    start, n = 0, len(cost)
    at = 0
    while at < n:
        end = max(int(np.searchsorted(total, total[start] + most, side="right")) - 1, at + 1)
        yield start, end
        if end >= n:
            return
        start = max(int(np.searchsorted(total, total[end] - overlap, side="left")), start)
        at = end


def chunk(docs: DataFrame, id_: str, text: str, most: int = CHUNK, overlap: int = OVERLAP, root: int | None = ROOT) -> DataFrame:
    """doc_id, position, chunk_type (root, child, standalone), content, token_count.

    With root, a text beyond most tokens opens with a root of up to root tokens and its other
    sentences are children; without it all chunks are standalone. Blank texts have none.
    """
    clean = docs.select(F.col(id_).cast("long").alias("doc_id"), clean_markup(F.col(text)).alias("text"))
    parts = clean.select("doc_id", "text", sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    parts = parts.withColumn("cost", F.transform("s", lambda x: estimate_tokens_by_script(x)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x in pdf.itertuples():
                s, cost = list(x.s), [int(c) for c in x.cost]
                if root is not None and sum(cost) <= most:
                    rows.append((x.doc_id, 0, "standalone", x.text, sum(cost)))
                    continue
                first = 0
                if root is not None:
                    used = 0
                    while first < len(s) and (first == 0 or used + cost[first] <= root):
                        used += cost[first]
                        first += 1
                    rows.append((x.doc_id, 0, "root" if first < len(s) else "standalone", " ".join(s[:first]), used))
                for k, (a, b) in enumerate(_windows(cost[first:], most, overlap)):
                    rows.append((x.doc_id, k + (root is not None), "child" if root is not None else "standalone", " ".join(s[first + a : first + b]), -1))
            yield pd.DataFrame(rows, columns=["doc_id", "position", "chunk_type", "content", "token_count"])

    out = parts.select("doc_id", "text", "s", "cost").mapInPandas(cut, _SCHEMA)
    return out.withColumn("token_count", F.when(F.col("token_count") < 0, estimate_tokens_by_script(F.col("content"))).otherwise(F.col("token_count")))


def with_root_context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (doc_id, position, ...) with context: children get their root's text before their own."""
    roots = chunks.where("chunk_type = 'root'").select("doc_id", F.col("content").alias("root"))
    both = hits.join(chunks, ["doc_id", "position"]).join(roots, "doc_id", "left")
    child = (F.col("chunk_type") == "child") & F.col("root").isNotNull()
    return both.withColumn("context", F.when(child, F.concat(F.lit("[ROOT CONTEXT]\n"), "root", F.lit("\n\n[DETAIL]\n"), "content")).otherwise(F.col("content"))).drop("root")
