"""Memory records: predicates, search with blended scores, saves, reviews, compaction, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.text import candidate_status
from lodestream.operators.ranking import first_by, min_max, top_k

# Weights of the memory blend, and what a review action does to a record.
BLEND = {"dense": 0.6, "importance": 0.3, "session": 0.1}
ACTIONS = {"keep": ("active", "keep_resolved"), "archive": ("archived", "archived_via_review"), "discard": ("archived", "discarded_via_review"), "merge_into": ("superseded", "merged_via_review")}


def select_records(records: DataFrame, now: Column, *, agent=None, scopes=None, kinds=None, sources=None, statuses=None, lifetime: str = "all") -> DataFrame:
    """Records that pass every given predicate. lifetime: persistent (no expiry), session (expiry ahead) or all."""
    out = records
    for column, value in (("agent_id", [agent] if agent is not None else None), ("scope", scopes), ("kind", kinds), ("source_type", sources), ("status", statuses)):
        if value is not None:
            out = out.where(F.col(column).isin(list(value)))
    if lifetime == "persistent":
        return out.where("ttl_expires_at is null")
    return out.where(F.col("ttl_expires_at") > now) if lifetime == "session" else out


def visible(groups: Column, user_groups: list[str]) -> Column:
    """No groups is public; else one must be the user's."""
    public = F.coalesce(F.size(groups), F.lit(0)) <= 0
    return public | F.coalesce(F.arrays_overlap(groups, F.array(*map(F.lit, user_groups)).cast("array<string>")), F.lit(False)) if user_groups else public


def not_gone(status: Column) -> Column:
    """Neither archived nor superseded; a missing status is active, and stale ones stay."""
    return ~F.coalesce(status, F.lit("active")).isin("archived", "superseded")


def unused(last_accessed: Column, created: Column, cutoff: Column) -> Column:
    return (last_accessed < cutoff) | (last_accessed.isNull() & (created < cutoff))


def valid_at(valid_from: Column, valid_to: Column, day: Column) -> Column:
    """Open ends are null; both ends belong to the interval."""
    return (valid_from.isNull() | (valid_from <= day)) & (valid_to.isNull() | (valid_to >= day))


def search(dense: DataFrame, graph: DataFrame, session: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) from three legs: dense hits (query_id, id, score), graph hits and session hits (query_id, id).

    Records without content or gone are left out; a leg that has no score for a record counts 0.
    """
    legs = dense.select("query_id", "id", "score", F.lit(0).alias("s")).unionByName(graph.select("query_id", "id", F.lit(None).cast("double").alias("score"), F.lit(0).alias("s")))
    legs = legs.unionByName(session.select("query_id", "id", F.lit(None).cast("double").alias("score"), F.lit(1).alias("s")))
    one = legs.groupBy("query_id", "id").agg(F.max("score").alias("dense"), F.max("s").alias("session"))
    known = one.join(records.select("id", "status", "importance", "content"), "id").where(not_gone(F.col("status")) & F.col("content").isNotNull())
    scaled = known.withColumn("scaled", F.when(F.col("dense").isNotNull(), min_max(F.col("dense"), ["query_id"])).otherwise(0.0))
    score = BLEND["dense"] * F.col("scaled") + BLEND["importance"] * F.coalesce("importance", F.lit(0.0)) + BLEND["session"] * F.col("session")
    return top_k(scaled.withColumn("score", F.round(score, 9)), ["query_id"], "score", "id", k).select("query_id", "id", "score", "rank")


def save(incoming: DataFrame, records: DataFrame) -> DataFrame:
    """incoming with stored_id: the latest stored record of the agent with the same content, or the first incoming one with it; saved tells the ones to append."""
    h = F.sha2("content", 256)
    old = records.withColumn("h", h).groupBy("agent_id", "h").agg(F.max(F.struct("created_at", "id"))["id"].alias("old"))
    rows = incoming.withColumn("h", h)
    first = rows.groupBy("agent_id", "h").agg(F.min("id").alias("first"))
    out = rows.join(first, ["agent_id", "h"]).join(old, ["agent_id", "h"], "left").withColumn("stored_id", F.coalesce("old", "first"))
    return out.withColumn("saved", F.col("old").isNull() & (F.col("id") == F.col("first"))).drop("h", "first", "old")


def resolve(entries: DataFrame, actions: DataFrame) -> DataFrame:
    """target_id, status, verification_state, superseded_by, mirror_of from review entries (id, target_id, related_id) and actions (id, action).

    The entry of the mirrored pair, if there is one, is settled with it.
    """
    kind = F.split(F.col("action"), ":")[0]
    target = F.when(kind == "merge_into", F.nullif(F.trim(F.substring("action", 12, 1_000)), F.lit("")))
    pick = lambda i: F.coalesce(*[F.when(kind == k, v[i]) for k, v in ACTIONS.items()])
    done = entries.join(actions, "id").where(pick(0).isNotNull() & ((kind != "merge_into") | target.isNotNull()))
    mirror = entries.select(F.col("id").alias("mirror_of"), F.col("target_id").alias("m_related"), F.col("related_id").alias("m_target"))
    both = done.join(mirror, (F.col("target_id") == F.col("m_target")) & (F.col("related_id") == F.col("m_related")), "left")
    return both.select("id", "target_id", pick(0).alias("status"), pick(1).alias("verification_state"), target.alias("superseded_by"), "mirror_of")


def canonical_pairs(entries: DataFrame) -> DataFrame:
    """Review entries without mirrors: of (A, B) and (B, A) the one with the smaller target stays."""
    pair = entries.withColumn("low", F.least("target_id", "related_id")).withColumn("high", F.greatest("target_id", "related_id"))
    return first_by(pair, ["low", "high"], [F.col("target_id"), F.col("id")]).select("id", "target_id", "related_id")


def compact(events: DataFrame, most: int = 100) -> DataFrame:
    """session_id, claimed, accepted, rejected, digest: of each session's oldest events, at most so many, what the gate lets through."""
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    claimed = events.where("compacted_at is null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    gated = claimed.withColumn("status", candidate_status(F.col("content"), F.coalesce("explicit", F.lit(False))))
    return gated.groupBy("session_id").agg(
        F.count("*").alias("claimed"), F.count("status").alias("accepted"), (F.count("*") - F.count("status")).alias("rejected"), F.max("id").alias("last_id"),
    )


def health(records: DataFrame, now: Column, stale_days: int = 30) -> DataFrame:
    """One row an agent: totals, archived, unused, growth a day over the last 7 days."""
    active = F.coalesce("status", F.lit("active")) == "active"
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    back = lambda d: now - F.make_dt_interval(days=F.lit(d))
    return records.groupBy("agent_id").agg(
        n(active).alias("total_records"), n(F.col("status").isin("archived", "superseded")).alias("total_archived"),
        n(active & unused(F.col("last_accessed_at"), F.col("created_at"), back(stale_days))).alias("unused_records"),
        (n(active & (F.col("created_at") >= back(7))) / 7.0).alias("growth_rate_per_day"),
    )
