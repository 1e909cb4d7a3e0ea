"""Contexts under a budget of tokens: ranked chunks with their roots, graph facts by priority, texts split in halves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lodestream.functions.text import estimate_tokens

# The whole budget, what is kept for the prompt and the answer, and the least that is left for fragments.
BUDGET, PROMPT, ANSWER, LEAST = 10_000, 500, 1_500, 1_000
#: Characters of a fact besides its names.
FACT_CHARS = 24


def available(graph_tokens: int = 0, budget: int = BUDGET, prompt: int = PROMPT, answer: int = ANSWER, least: int = LEAST) -> int:
    return max(budget - prompt - answer - graph_tokens, least)


def fragments(ranked: DataFrame, text: str, budget: int) -> DataFrame:
    """The longest prefix by rank (query_id, rank, ...) whose tokens fit; a first fragment that is too long is cut to the share that fits.

    Fragments of one rank stand or fall together. The share is divided once, so a cut at a whole number of characters is not one less.
    """
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("rank")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    n = estimate_tokens(F.col(text))
    out = ranked.withColumn("used", F.sum(n).over(w)).withColumn("first", F.min("rank").over(Window.partitionBy("query_id")) == F.col("rank"))
    cut = F.substring(F.col(text), F.lit(1), F.floor(F.length(text) * budget / F.greatest(n, F.lit(1))).cast("int"))
    return out.where((F.col("used") <= budget) | F.col("first")).withColumn(text, F.when(F.col("used") <= budget, F.col(text)).otherwise(cut)).drop("first")


def with_roots(ranked: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """Ranked chunks (query_id, rank, doc_id, position) under a budget where a child brings its document's root, which is charged once a query."""
    c = chunks.select("doc_id", "position", "chunk_type", "token_count", "content")
    roots = chunks.where("chunk_type = 'root'").select("doc_id", F.col("token_count").alias("root_cost"), F.col("content").alias("root"))
    rows = ranked.join(c, ["doc_id", "position"]).join(roots, "doc_id", "left")
    child = (F.col("chunk_type") == "child") & F.col("root").isNotNull()
    first = F.row_number().over(Window.partitionBy("query_id", "doc_id", child).orderBy("rank")) == 1
    rows = rows.withColumn("brings_root", child & first)
    cost = F.col("token_count") + F.when(F.col("brings_root"), F.col("root_cost")).otherwise(0)
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = F.when(F.col("brings_root"), F.concat(F.lit("[Context: "), "root", F.lit("]\n\n---\n\n"), "content")).otherwise(F.col("content"))
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget).select("query_id", "rank", "doc_id", "position", "used", text.alias("context"))


def graph_facts(facts: DataFrame, budget: int) -> DataFrame:
    """facts (query_id, kind, name, src, dst, place) that fit: all people, then other entities, then relations that touch a kept name, then documents.

    A tier ends at its first fact that does not fit; the next tier goes on with what is left. A fact costs FACT_CHARS characters
    at least, so a budget has room for so many of a tier only: each is cut to these, within tasks as well, before anything is
    summed in order, and a query of very many facts is no large group. Only people, whom the budget does not bound, are summed without order.
    """
    size = lambda c: F.length(F.coalesce(F.col(c).cast("string"), F.lit("None")))
    costed = facts.withColumn("cost_", size("name") + size("src") + size("dst") + FACT_CHARS)
    most = 4 * (budget + 1) // FACT_CHARS + 1
    people = costed.where("kind = 'person'")
    spent = people.groupBy("query_id").agg(F.sum("cost_").alias("spent_"))
    first = lambda rows: rows.withColumn("n_", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("n_") <= most).drop("n_")
    running = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def fitting(rows: DataFrame, before: DataFrame) -> DataFrame:
        met = first(rows).join(before, "query_id", "left").withColumn("spent_", F.coalesce("spent_", F.lit(0)) + F.sum("cost_").over(running))
        return met.where(F.floor(F.col("spent_") / 4) <= budget)

    def after(before: DataFrame, kept: DataFrame) -> DataFrame:
        return before.unionByName(kept.select("query_id", "spent_")).groupBy("query_id").agg(F.max("spent_").alias("spent_"))

    entities = fitting(costed.where("kind = 'entity'"), spent)
    names = people.select("query_id", "name").unionByName(entities.select("query_id", "name")).distinct().select(F.col("query_id").alias("of_"), F.col("name").alias("name_"))
    touches = lambda c: costed.where("kind = 'relation'").join(names, F.col("query_id").eqNullSafe(F.col("of_")) & F.col(c).eqNullSafe(F.col("name_")), "left_semi")
    spent = after(spent, entities)
    relations = fitting(touches("src").unionByName(touches("dst")).distinct(), spent)
    documents = fitting(costed.where("kind = 'document'"), after(spent, relations))
    out = people.select(*facts.columns)
    for tier in (entities, relations, documents):
        out = out.unionByName(tier.select(*facts.columns))
    return out


def split_long(texts: DataFrame, text: str, most: int, depth: int = 3) -> DataFrame:
    """Rows with (part, piece): texts beyond most characters are halved at the last blank before the middle, up to depth times."""

    def halves(s: str, left: int) -> list[str]:
        if len(s) <= most or not left:
            return [s]
        at = s.rfind(" ", 1, len(s) // 2)
        at = at if at > 0 else len(s) // 2
        return halves(s[:at].strip(), left - 1) + halves(s[at:].strip(), left - 1)

    schema = StructType([*texts.schema.fields, StructField("part", IntegerType()), StructField("piece", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            pdf["piece"] = [halves(s, depth) if isinstance(s, str) else [] for s in pdf[text]]
            pdf["part"] = [list(range(len(p))) for p in pdf["piece"]]
            yield pdf.explode(["part", "piece"]).dropna(subset=["part"])[[f.name for f in schema]]

    return texts.mapInPandas(run, schema)


def sections(parts: dict[str, Column]) -> Column:
    """Titled sections in order; empty ones are left out."""
    return F.concat_ws("\n\n", *[F.when(F.length(v) > 0, F.concat(F.lit(f"## {k}\n"), v)) for k, v in parts.items()])
