"""Graphs of issues: who tracks, reports and works on them, and what their texts mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import constants as C

EDGE = ["src", "dst", "type", "weight", "valid_from", "valid_to"]


def is_done(status: Column) -> Column:
    return F.lower(F.trim(F.coalesce(status, F.lit("")))).isin(C.DONE_STATUSES)


def newest(issues: DataFrame) -> DataFrame:
    """One row for each issue_key, the one updated last (ties: the greatest row); rows without a key are left out. Partial aggregates."""
    names = [c for c in issues.columns if c not in ("issue_key", "updated")]
    last = issues.where("issue_key is not null").groupBy("issue_key").agg(F.max(F.struct("updated", *names)).alias("row"))
    return last.select("issue_key", "row.*")


def issue_edges(issues: DataFrame, mentions: DataFrame) -> DataFrame:
    """Edges (src, dst, type, weight, valid_from, valid_to) of the newest version of each issue.

    issues: issue_key, user_id, assignee, reporter, status, created, updated, resolved_at; mentions: issue_key, name,
    mention_count, one row or more for a name, counts added. An assignment ends when the issue is resolved or, if it is done without a date
    for it, when it was updated last. Blank and null people and names have no edges.
    """
    one = newest(issues)
    ends = F.coalesce("resolved_at", F.when(is_done(F.col("status")), F.col("updated")))
    open_end = F.lit(None).cast(issues.schema["updated"].dataType)
    links = F.array(*[
        F.struct(who.alias("src"), F.lit(kind).alias("type"), start.alias("valid_from"), end.alias("valid_to"))
        for who, kind, start, end in [
            (F.col("user_id"), "TRACKS", open_end, open_end),
            (F.col("assignee"), "ASSIGNED_TO", F.col("created"), ends),
            (F.col("reporter"), "REPORTED", F.col("created"), open_end),
        ]
    ])
    people = one.select(F.col("issue_key").alias("dst"), F.explode(F.filter(links, lambda x: F.coalesce(x["src"], F.lit("")) != "")).alias("x"))
    people = people.select("x.src", "dst", "x.type", F.lit(1).cast("long").alias("weight"), "x.valid_from", "x.valid_to")
    named = mentions.where("coalesce(name, '') <> ''").groupBy("issue_key", "name").agg(F.sum("mention_count").alias("weight"))
    named = named.join(one.select("issue_key", "created"), "issue_key")
    named = named.select(F.col("issue_key").alias("src"), F.col("name").alias("dst"), F.lit("MENTIONS").alias("type"), "weight", F.col("created").alias("valid_from"), open_end.alias("valid_to"))
    return people.unionByName(named).select(*EDGE)


def relation_edges(issues: DataFrame, relations: DataFrame) -> DataFrame:
    """(src, dst, type, relation, valid_from) of relations (issue_key, source, target, type) between entities that issues tell of.

    A relation of one type between two entities is one edge whatever the number of issues that have it; it is valid from the creation of the
    latest of these. Only known issues count; ends without a name have no edges, and a relation without a type is RELATED_TO.
    """
    one = newest(issues).select("issue_key", "created")
    named = relations.where("coalesce(source, '') <> '' and coalesce(target, '') <> ''")
    named = named.select("issue_key", F.col("source").alias("src"), F.col("target").alias("dst"), F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.lit("RELATED_TO")).alias("relation"))
    return named.join(one, "issue_key").groupBy("src", "dst", "relation").agg(F.max("created").alias("valid_from")).select("src", "dst", F.lit("RELATION").alias("type"), "relation", "valid_from")
