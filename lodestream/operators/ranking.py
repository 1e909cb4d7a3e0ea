"""Ranks, top k, min-max scaling, first occurrences, prefixes under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], score: str, id_: str, name: str = "rank") -> DataFrame:
    """1-based ranks by score downwards, then id."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(id_))))


def top_k(df: DataFrame, by: list[str], score: str, id_: str, k: int | None) -> DataFrame:
    out = ranked(df, by, score, id_)
    return out if k is None else out.where(F.col("rank") <= k)


def min_max(value: Column, by: list[str]) -> Column:
    """(x - min) / (max - min) within by; 1 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 1.0).otherwise((value - low) / (high - low))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order; partial aggregation, so a hot key is no hot task."""
    names = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*names).alias("row"))).alias("m"))
    return picked.select(*keys, "m.row.*")


def budget_prefix(df: DataFrame, by: list[str], order: str, cost: Column, budget: float) -> DataFrame:
    """The longest prefix whose running cost stays within the budget; used tells its cost so far."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)
