"""The freshness of records, stage by stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.text import keywords
from lodestream.operators.ranking import ranked
from lodestream.operators.storage import written

# Similarity of linked and of duplicate records, days until stale, confidence of rules and the one that is acted on.
LINKED, DUPLICATE, STALE_DAYS, RULE_CONFIDENCE, ACT_ON = 0.6, 0.85, 30, 0.55, 0.7
CURATED = "auto_curated"


def link(records: DataFrame, hits: DataFrame, most: int = 20, least: float = LINKED) -> tuple[DataFrame, DataFrame]:
    """(records with evidence_count, LINKED_TO edges) from similarity hits (query_id, id, score) of a score of least or more."""
    near = ranked(hits.where((F.col("score") >= least) & (F.col("query_id") != F.col("id"))), ["query_id"], "score", "id").where(F.col("rank") <= most)
    counted = near.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"))
    out = records.drop("evidence_count").join(counted, "id", "left").withColumn("evidence_count", F.coalesce("n", F.lit(0))).drop("n")
    return out, near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.lit("LINKED_TO").alias("type"))


def reconcile(hits: DataFrame, least: float = DUPLICATE) -> DataFrame:
    """(a, b, score) of the best duplicate of each record, of a score of least or more, each undirected pair once."""
    best = ranked(hits.where((F.col("score") >= least) & (F.col("query_id") != F.col("id"))), ["query_id"], "score", "id").where("rank = 1")
    return best.groupBy(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).agg(F.max("score").alias("score"))


def monitor(records: DataFrame, now: Column, age_gated: bool = False) -> DataFrame:
    """records with status and freshness_score by the first rule that holds: expired, superseded, stale.

    age_gated: a record that was never looked at is only stamped, and may turn stale the next time.
    """
    old = F.col("updated_at") <= now - F.make_dt_interval(days=F.lit(STALE_DAYS))
    seen = F.col("last_freshness_run_at").isNotNull() if age_gated else F.lit(True)
    expired, replaced = F.col("valid_until") <= now, F.col("superseded_by").isNotNull()
    rule = F.when(expired, 1).when(replaced, 2).when(old & seen, 3).when(old, 4)
    out = records.withColumn("rule", rule)
    out = out.withColumn("status", F.when(F.col("rule") == 1, "archived").when(F.col("rule") == 2, "superseded").when(F.col("rule") == 3, "stale").otherwise(F.col("status")))
    return out.withColumn("freshness_score", F.when(F.col("rule") == 1, 0.0).when(F.col("rule") == 2, 0.1).when(F.col("rule") == 3, 0.25).otherwise(F.col("freshness_score")))


def curate(records: DataFrame) -> DataFrame:
    """Candidates with evidence become active and are tagged."""
    grown = (F.col("status") == "candidate") & (F.col("evidence_count") >= 1)
    return records.withColumn("tags", F.when(grown, F.array_union("tags", F.array(F.lit(CURATED)))).otherwise(F.col("tags"))).withColumn("status", F.when(grown, "active").otherwise(F.col("status")))


def decide(records: DataFrame, confidence: Column | None = None) -> DataFrame:
    """id, tags, confidence, outcome (applied or review) for records that are active, candidates or in review."""
    c = confidence if confidence is not None else F.lit(RULE_CONFIDENCE)
    own = records.where(F.col("status").isin("active", "review_needed", "candidate"))
    return own.select("id", keywords(F.col("content")).alias("tags"), c.alias("confidence"), F.when(c >= ACT_ON, "applied").otherwise("review").alias("outcome"))


def stale_scan(records: DataFrame, cutoff: Column, most: int = 500) -> DataFrame:
    """The oldest records that are not settled and not touched since cutoff."""
    open_ = records.where(~F.col("status").isin("archived", "superseded", "stale") & (F.col("updated_at") <= cutoff))
    return open_.orderBy("updated_at", "id").limit(most).select("id", "updated_at")


def job(records: DataFrame, now: Column, linked: float = LINKED, duplicate: float = DUPLICATE, confidence: float = RULE_CONFIDENCE, act_on: float = ACT_ON, most: int = 20, age_gated: bool = False, **search) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole freshness job over all records: linker, reconciler, monitor, curator, decision, each on what the one before left.

    records: id, agent_id, vector, content, status, tags, updated_at, valid_until, superseded_by, freshness_score, last_freshness_run_at.
    Neighbours are those of the same agent. Returns the records after the job (without vectors, with evidence_count and outcome), the links
    (src, dst, score) and the new reviews (target_id, related_id, reason, confidence): one for each pair of duplicates, and one for each
    decision that is not sure enough. A decision that is sure adds its tags. Neighbours are exact, unless search asks for an index by a recall.
    """
    from lodestream.operators.vector_index import every_neighbour, neighbours

    near = written((neighbours if "recall" in search else every_neighbour)(records.select("id", "vector", "agent_id"), most, linked, group="agent_id", **search))
    with_evidence, _ = link(records.drop("vector"), near, most, linked)
    pairs = reconcile(near, duplicate)
    seen = monitor(with_evidence, now, age_gated)
    grown = written(curate(seen))
    decided = decide(grown, F.lit(confidence)).select("id", F.col("tags").alias("new_tags"), "outcome")
    sure = decided.withColumn("new_tags", F.when(F.lit(confidence >= act_on), F.array(F.array_join("new_tags", ","))))
    after = grown.join(sure, "id", "left").withColumn("tags", F.when(F.element_at("new_tags", 1) != "", F.array_union("tags", "new_tags")).otherwise(F.col("tags"))).drop("new_tags", "rule")
    unsure = after.where("outcome = 'review'").select(F.col("id").alias("target_id"), F.lit(None).cast("long").alias("related_id"), F.lit("low_confidence_decision").alias("reason"), F.lit(confidence).alias("confidence"))
    found = pairs.select(F.col("a").alias("target_id"), F.col("b").alias("related_id"), F.lit("possible_duplicate").alias("reason"), F.col("score").alias("confidence"))
    return after, near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "score"), found.unionByName(unsure)
