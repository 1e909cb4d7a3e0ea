"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import discard, written

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v), u > v: each node's neighbours are hung on the least of them and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.where("m < u").select("u", F.col("m").alias("v"))
        return out.unionByName(own).where("u > v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, root): root is the least node of the component; nodes without a link to another are left out."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(ROUNDS):
        new = written(_star(_star(edges, large=True), large=False))
        discard(edges)
        edges = new
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
