"""Whole searches: fast (vectors and metadata) and full (channels, scores, rerank, budget), with hooks between the steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators import fusion
from lodestream.operators.context import available, fragments
from lodestream.operators.memory import not_gone
from lodestream.operators.ranking import min_max, top_k

Hook = Callable[[DataFrame], DataFrame]
# Fixed value: the size of the pool that is reranked.
POOL = 35


def cap_channels(hits: DataFrame) -> DataFrame:
    """The best hits of each channel and query, as many as the channel may bring."""
    most = F.coalesce(*[F.when(F.col("channel") == c, F.lit(n)) for c, n in fusion.CHANNEL_LIMITS.items()])
    return top_k(hits, ["query_id", "channel"], "score", "id", None).where(F.col("rank") <= most).drop("rank")


def fast(dense: DataFrame, metadata: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) by the vector score where there is one, else the best of the others."""
    hits = dense.select("query_id", F.lit("dense").alias("channel"), "id", "score").unionByName(metadata.select("query_id", F.lit("metadata").alias("channel"), "id", "score"))
    merged = fusion.merge_channels(hits).withColumn("score", F.coalesce("dense", F.greatest("exact", "metadata", "graph")))
    return top_k(merged.select("query_id", "id", "score"), ["query_id"], "score", "id", k)


def full(hits: DataFrame, payload: DataFrame, weights: dict[str, float], k: int, *, rerank: Hook | None = None, pre_filter: Hook | None = None, post_rerank: Hook | None = None,
         least_signal: float = 0.0, blend: float = 0.3, recency: Column | None = None, graph_tokens: int = 0) -> DataFrame:
    """query_id, id, score, rank, text of channel hits (query_id, channel, id, score) with payload (id, source_type, status, text).

    Gone documents are dropped before any limit. rerank adds rerank_score to the pool; without
    it the signal score stands for itself. Hooks take and return the table of their step.
    """
    live = payload.where(not_gone(F.col("status")))
    own = cap_channels(hits.join(live.select("id"), "id", "left_semi"))
    active = own.groupBy("query_id").agg(*[F.max(F.col("channel") == c).alias(f"on_{c}") for c in fusion.CHANNELS])
    rows = fusion.merge_channels(own).join(live, "id").join(active, "query_id")
    share = rows.groupBy("query_id", "source_type").agg(F.count("*").alias("of_type")).join(rows.groupBy("query_id").agg(F.count("*").alias("of_all")), "query_id")
    rows = rows.join(share, ["query_id", "source_type"])
    balance = fusion.source_balance(F.col("of_type") / F.col("of_all"))
    signal = fusion.signal_score({c: F.col(c) for c in fusion.CHANNELS}, recency if recency is not None else F.lit(1.0), balance, {n: F.lit(float(v)) for n, v in weights.items()}, {c: F.col(f"on_{c}") for c in fusion.CHANNELS})
    scored = rows.withColumn("signal", F.round(signal, 9)).where(F.col("signal") >= least_signal)
    scored = pre_filter(scored) if pre_filter else scored
    pool = top_k(scored, ["query_id"], "signal", "id", POOL).drop("rank")
    if rerank:
        pool = rerank(pool).withColumn("score", F.round(fusion.final_score(F.col("signal"), min_max(F.col("rerank_score"), ["query_id"]), blend), 9))
    else:
        pool = pool.withColumn("score", F.col("signal"))
    best = top_k(post_rerank(pool) if post_rerank else pool, ["query_id"], "score", "id", k)
    return fragments(best.select("query_id", "id", "score", "rank", "text"), "text", available(graph_tokens))


# Fields of a result and what they are where the payload has none.
RESULT_FIELDS = {"title": "", "type": "", "url": "", "date": "", "doc_label": "", "workspace_id": "", "source_role": "knowledge_base"}


def result_shape(hits: DataFrame, id_column: str, payload: str = "payload", score: str = "score") -> DataFrame:
    """id, score, memory, data, title, type, url, date, doc_label, workspace_id, source_role and payload of each hit.

    payload is a map of strings; null, it is empty. data is the payload's data or, where that is missing or empty, its memory.
    """
    got = F.coalesce(F.col(payload), F.create_map().cast("map<string,string>"))
    data = F.coalesce(F.nullif(got["data"], F.lit("")), got["memory"], F.lit(""))
    fields = [F.coalesce(got[k], F.lit(v)).alias(k) for k, v in RESULT_FIELDS.items()]
    return hits.select(F.col(id_column).cast("string").alias("id"), F.col(score).alias("score"), data.alias("memory"), data.alias("data"), *fields, got.alias("payload"))
