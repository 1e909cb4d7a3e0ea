"""Retrieval metrics per query, their means, comparisons with a baseline, and weight grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.ranking import first_by


def metrics(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, mrr, ndcg) of results (query_id, id, rank) against expected (query_id, id).

    An id counts once, at its best rank. Precision is over min(k, results). Queries without
    expected ids are left out; those without results score 0.
    """
    distinct = first_by(results.select("query_id", "id", "rank"), ["query_id", "id"], [F.col("rank")])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))
    placed = distinct.withColumn("place", place).join(expected.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    within = F.when(F.col("place") <= k, F.col("hit")).otherwise(0)
    got = placed.groupBy("query_id").agg(
        (F.sum(within) / F.greatest(F.least(F.lit(k), F.count("*")), F.lit(1))).alias("precision"),
        F.coalesce(F.max(F.when(F.col("hit") == 1, 1.0 / F.col("place"))), F.lit(0.0)).alias("mrr"),
        F.sum(within / F.log2(F.col("place") + 1.0)).alias("gain"),
    )
    wanted = expected.select("query_id", "id").distinct().groupBy("query_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return wanted.join(got, "query_id", "left").select("query_id", zero(F.col("precision")).alias("precision"), zero(F.col("mrr")).alias("mrr"), zero(F.col("gain") / ideal).alias("ndcg"))


def means(per_query: DataFrame) -> DataFrame:
    """Means of the metrics; nulls do not count."""
    return per_query.agg(*[F.avg(c).alias(c) for c in per_query.columns if c != "query_id"], F.count("*").alias("n_queries"))


def compare(before: DataFrame, after: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """(metric, before, after, delta, regression) of tables (metric, value); a drop beyond the metric's limit is a regression."""
    limit = F.lit(0.0)
    for name, x in (limits or {}).items():
        limit = F.when(F.col("metric") == name, x).otherwise(limit)
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), "metric")
    delta = F.col("after") - F.col("before")
    return both.select("metric", "before", "after", delta.alias("delta"), (delta < -limit).alias("regression"))


def long_form(one_row: DataFrame) -> DataFrame:
    """(metric, value) of a table of one row."""
    names = [c for c, t in one_row.dtypes if t == "double"]
    return one_row.unpivot([], names, "metric", "value")


def weight_grid(spark, step: int = 5) -> DataFrame:
    """Weights in steps of step hundredths whose sum is 0.80 to 0.90."""
    axis = lambda n, top: spark.range(0, top + 1, step).select((F.col("id") / 100).alias(n))
    grid = axis("dense", 60).crossJoin(axis("graph", 30)).crossJoin(axis("metadata", 50)).crossJoin(axis("recency", 30))
    total = F.round(F.col("dense") + F.col("graph") + F.col("metadata") + F.col("recency"), 6)
    return grid.withColumn("total", total).where("total between 0.80 and 0.90")


def objective(per_query: DataFrame) -> DataFrame:
    return per_query.withColumn("objective", 0.4 * F.col("mrr") + 0.4 * F.col("ndcg") + 0.2 * F.col("precision"))


def negative_accuracy(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Share of queries that have no results."""
    n = results.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.join(n, "query_id", "left").agg(F.avg(F.when(F.coalesce("n", F.lit(0)) == 0, 1.0).otherwise(0.0)).alias("accuracy"), F.count("*").alias("n_queries"))
