"""Counts, calendars and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import constants as C


def daily(df: DataFrame, when: str, start: str, end: str, by: list[str] | None = None, **sums: Column) -> DataFrame:
    """by..., day and sums for every day from start to end; days without rows have 0.

    The calendar is joined to what was already summed up by day, and the keys to a few days, so
    nothing but sums is shuffled.
    """
    by = by or []
    spark = df.sparkSession
    day = F.to_date(when)
    totals = df.where((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date"))).groupBy(*by, day.alias("day")).agg(*[v.alias(k) for k, v in sums.items()])
    calendar = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    frame = df.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")) if by else calendar
    return frame.join(totals, [*by, "day"], "left").select(*by, "day", *[F.coalesce(k, F.lit(0)).alias(k) for k in sums])


def minutes_saved(words: Column, milliseconds: Column) -> Column:
    """Reading time with search overhead, less the response time; never negative."""
    return F.greatest(F.lit(0.0), words / C.WORDS_PER_MINUTE * C.SEARCH_OVERHEAD - milliseconds / 60_000)


def document_costs(stats: DataFrame, label: str, title: str, fetches: str, words: str) -> DataFrame:
    """Per document: fetches, words, one cost a provider (rounded to 6 digits), own cost and largest savings."""
    docs = stats.groupBy(label).agg(F.max(title).alias("title"), F.sum(fetches).alias("fetch_count"), F.sum(words).alias("total_context_words"))
    for name, (read, write) in C.PRICES.items():
        cost = F.col("total_context_words") * C.TOKENS_PER_WORD * read / 1_000_000 + C.ANSWER_TOKENS * write / 1_000_000 * F.col("fetch_count")
        docs = docs.withColumn(name, F.when(F.col("fetch_count") == 0, 0.0).otherwise(F.round(cost, 6)))
    docs = docs.withColumn("own_cost", F.col("fetch_count") * C.OWN_COST)
    return docs.withColumn("max_savings", F.greatest(*[F.col(n) - F.col("own_cost") for n in C.PRICES]))


def cost_summary(docs: DataFrame) -> DataFrame:
    """provider, commercial_cost, savings, savings_pct over all documents."""
    total = docs.agg(*[F.sum(n).alias(n) for n in C.PRICES], F.sum("own_cost").alias("own"))
    long_ = total.unpivot(["own"], list(C.PRICES), "provider", "commercial_cost")
    savings = F.col("commercial_cost") - F.col("own")
    return long_.select("provider", "commercial_cost", savings.alias("savings"), F.when(F.col("commercial_cost") > 0, savings / F.col("commercial_cost") * 100).otherwise(0.0).alias("savings_pct"))


def severity(status: Column) -> Column:
    return F.when(status == "failed", "error").when(status == "partial", "warning").otherwise("info")
