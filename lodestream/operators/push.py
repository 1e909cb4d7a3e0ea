"""Personalised PageRank as a recall channel: bounded subgraphs about dense anchors, ranked by forward push.

The documents of the nearest vectors name entities, whose aliases join them; from these seeds two hops of edges make a query's
subgraph, of at most MAX_NODES nodes and EDGES_PER_NODE times as many edges, the first in the order of (src, dst, type). Every
hop is an equi-join with adjacency lists that are cut to that number beforehand: what a list has beyond it is never among the first.

A subgraph is a bounded group, so each is ranked in one task by forward push: a node whose residual is above the tolerance keeps a share
of it and passes the rest on, and nodes below it are not touched. The sum of what is left bounds the error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.graph import ALPHA
from lodestream.operators.ranking import top_k
from lodestream.operators.storage import ship

# Nodes of a subgraph, edges for each of them, documents that anchor a query, hits of the channel.
MAX_NODES, EDGES_PER_NODE, ANCHORS, HITS = 500, 8, 10, 5
#: What may be left of all residuals together.
TOLERANCE = 1e-9
_EDGE = ["src", "dst", "type"]


def push(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, teleport: np.ndarray, alpha: float = ALPHA, tolerance: float = TOLERANCE) -> tuple[np.ndarray, int]:
    """(scores of the nodes 0..n-1, summing to 1; how often nodes were pushed) over undirected edges from a teleport distribution.

    Edges of bad weight and loops are left out, weights of parallel edges add up; what sits on a node without edges goes back to the
    teleport nodes. Without a teleport weight above 0 all scores are 0.
    """
    home = np.where(np.isfinite(teleport) & (teleport > 0), teleport, 0.0)
    if not n or not home.sum():
        return np.zeros(n), 0
    home = home / home.sum()
    good = np.isfinite(weight) & (weight > 0) & (src != dst)
    a, b, w = np.concatenate([src[good], dst[good]]), np.concatenate([dst[good], src[good]]), np.tile(weight[good], 2)
    order = np.argsort(a, kind="stable")
    a, b, w = a[order], b[order], w[order]
    total = np.bincount(a, w, n)
    first = np.searchsorted(a, np.arange(n + 1))
    score, rest, pushed, least = np.zeros(n), home.copy(), 0, tolerance / n
    while True:
        hot = np.flatnonzero(rest > least)
        if not len(hot):
            return score / score.sum(), pushed
        pushed += len(hot)
        moved, rest[hot] = rest[hot], 0.0
        score[hot] += (1 - alpha) * moved
        count = first[hot + 1] - first[hot]
        at = np.repeat(first[hot], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        rest += np.bincount(b[at], np.repeat(alpha * moved, count) * w[at] / total[a[at]], n)
        rest += alpha * moved[count == 0].sum() * home


def edge_weight(edges: DataFrame) -> DataFrame:
    """edges with the weight of a way: 1 for aliases, the number of mentions, 1 at least, for mentions."""
    w = F.coalesce(F.try_to_number(F.col("weight").cast("string"), F.lit("999999999999999999")).cast("double"), F.lit(1.0)) if dict(edges.dtypes)["weight"] == "string" else F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    return edges.select(*_EDGE, F.when(F.col("type") == "ALIAS", 1.0).otherwise(F.greatest(F.lit(1.0), F.nanvl(w, F.lit(1.0)))).alias("weight"))


def _first(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*_EDGE))).where(F.col("place") <= most)


def subgraphs(seeds: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """(query_id, src, dst, type, weight) within two hops of seeds (query_id, id), both ends among the first max_nodes nodes.

    Of the first hop max_nodes * EDGES_PER_NODE edges count, of the nodes these reach the max_nodes least ones go on, and of
    all edges that many count again. Nodes are numbered as they appear, src before dst.
    """
    most = max_nodes * EDGES_PER_NODE
    own = edge_weight(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("type").isin("ALIAS", "MENTIONS")))).groupBy(*_EDGE).agg(F.max("weight").alias("weight"))
    ways = own.withColumn("id", F.explode(F.array_distinct(F.array("src", "dst"))))
    lists = _first(ways, ["id"], most).drop("place")
    start = seeds.where("id is not null").select("query_id", "id").distinct()
    near = _first(start.join(lists, "id").drop("id").distinct(), ["query_id"], most).drop("place")
    reached = near.select("query_id", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("zero", F.lit(0))
    frontier = top_k(reached, ["query_id"], "zero", "id", max_nodes).select("query_id", "id")
    both = near.unionByName(frontier.join(lists, "id").drop("id")).distinct()
    rows = _first(both, ["query_id"], most)
    seen = rows.select("query_id", F.explode(F.array(F.struct(F.col("src").alias("id"), (2 * F.col("place")).alias("at")), F.struct(F.col("dst").alias("id"), (2 * F.col("place") + 1).alias("at")))).alias("s"))
    known = seen.groupBy("query_id", "s.id").agg((-F.min("s.at")).alias("early"))
    known = top_k(known, ["query_id"], "early", "id", max_nodes).select("query_id", "id")
    out = rows.join(known.withColumnRenamed("id", "src"), ["query_id", "src"]).join(known.withColumnRenamed("id", "dst"), ["query_id", "dst"])
    return out.select("query_id", *_EDGE, "weight")


def rank(subgraph: DataFrame, documents: DataFrame, alpha: float = ALPHA, tolerance: float = TOLERANCE) -> DataFrame:
    """(query_id, id, score) of all nodes of subgraphs; every node that is none of documents (id) is a teleport node of the same weight."""
    ship(subgraph.sparkSession)
    ends = subgraph.select("query_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = ends.join(documents.select("id", F.lit(0.0).alias("none")).distinct(), "id", "left").select("query_id", F.col("id"), F.coalesce("none", F.lit(1.0)).alias("teleport"))
    kind, key = dict(subgraph.dtypes)["src"], dict(subgraph.dtypes)["query_id"]

    def run(own: pa.Table, edges: pa.Table) -> pa.Table:
        ids = own.column("id").to_pylist()
        at = {x: i for i, x in enumerate(ids)}
        ends = [np.array([at[x] for x in edges.column(c).to_pylist()], dtype=np.int64) for c in ("src", "dst")] if edges.num_rows else [np.zeros(0, np.int64)] * 2
        score, _ = push(len(ids), *ends, edges.column("weight").to_numpy(), own.column("teleport").to_numpy(), alpha, tolerance)
        return pa.table({"query_id": own.column("query_id"), "id": own.column("id"), "score": pa.array(score)})

    return nodes.groupBy("query_id").cogroup(subgraph.select(F.col("query_id").alias("of_query"), "src", "dst", "weight").groupBy("of_query")).applyInArrow(run, f"query_id {key}, id {kind}, score double")


def channel(hits: DataFrame, edges: DataFrame, documents: DataFrame, anchors: int = ANCHORS, max_nodes: int = MAX_NODES, limit: int = HITS) -> DataFrame:
    """(query_id, id, score, rank): the documents that dense hits (query_id, id of a document, score) lead to.

    edges: MENTIONS from documents to entities, ALIAS between entities; documents: id. The entities that the first anchors mention, and their
    aliases, are the seeds.
    """
    anchored = top_k(hits.select("query_id", "id", "score"), ["query_id"], "score", "id", anchors).select("query_id", F.col("id").alias("src"))
    said = anchored.join(edges.where("type = 'MENTIONS'").select("src", "dst"), "src").select("query_id", F.col("dst").alias("id")).distinct()
    alias = edges.where("type = 'ALIAS'")
    ways = alias.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(alias.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    seeds = said.unionByName(said.join(ways, "id").select("query_id", F.col("other").alias("id"))).distinct()
    scores = rank(subgraphs(seeds, edges, max_nodes), documents).join(documents.select("id").distinct(), "id", "left_semi")
    return top_k(scores.withColumn("score", F.round("score", 9)).where("score > 0"), ["query_id"], "score", "id", limit)
