"""Property graphs as tables: edges (src, dst, type, weight, valid_from, valid_to) and nodes (id, label, type).

Walks are loops of joins, one a hop, over tables that are written between hops; personalised
PageRank is a loop of sums. Every limit has an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.memory import valid_at
from lodestream.operators.storage import discard, written

# Damping, rounds and tolerance of personalised PageRank, hops and cap of walks.
ALPHA, ROUNDS, TOLERANCE, HOPS, FRONTIER = 0.85, 30, 1e-6, 2, 50


def merge_edges(rows: DataFrame) -> DataFrame:
    """One edge for each (src, dst, type): weights added, the earliest start kept."""
    return rows.groupBy("src", "dst", "type").agg(F.sum("weight").alias("weight"), F.min("valid_from").alias("valid_from"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reach(seeds: DataFrame, edges: DataFrame, hops: int = HOPS, frontier: int | None = None) -> DataFrame:
    """(query_id, id, hop) of what is reached from seeds (query_id, id) in at most so many hops, by the shortest way.

    frontier: how many new nodes of a query a hop may go on from, the least ids first.
    """
    from lodestream.operators.ranking import ranked

    ways = both_ways(edges)
    found = written(seeds.select("query_id", "id").distinct().withColumn("hop", F.lit(0)))
    last = found
    for hop in range(1, hops + 1):
        start = last if frontier is None else ranked(last.withColumn("zero", F.lit(0)), ["query_id"], "zero", "id").where(F.col("rank") <= frontier)
        step = start.select("query_id", F.col("id").alias("src")).join(ways, "src").select("query_id", F.col("dst").alias("id")).distinct()
        last = written(step.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        found = found.unionByName(last)
    return found


def aliases(names: DataFrame, alias_edges: DataFrame, hops: int = 3) -> DataFrame:
    """(query_id, id): names and all their aliases, in both directions; cycles end by themselves."""
    return reach(names, alias_edges, hops).select("query_id", "id")


def entity_documents(names: DataFrame, mentions: DataFrame) -> DataFrame:
    """(query_id, doc) of documents (src) that mention an entity (dst)."""
    return names.join(mentions.select(F.col("src").alias("doc"), F.col("dst").alias("id")), "id").select("query_id", "doc").distinct()


def related_documents(docs: DataFrame, mentions: DataFrame, alias_edges: DataFrame) -> DataFrame:
    """(query_id, doc): other documents that mention an entity of the given ones (query_id, doc), or an alias of it."""
    own = docs.join(mentions.select(F.col("src").alias("doc"), F.col("dst").alias("e")), "doc").select("query_id", "e").distinct()
    also = own.join(both_ways(alias_edges).select(F.col("src").alias("e"), F.col("dst").alias("f")), "e").select("query_id", F.col("f").alias("e"))
    out = own.unionByName(also).distinct().withColumnRenamed("e", "id")
    return entity_documents(out, mentions).join(docs.select("query_id", "doc"), ["query_id", "doc"], "left_anti")


def relationships(names: DataFrame, edges: DataFrame, day: Column | None = None, most: int = 200) -> DataFrame:
    """(query_id, src, dst, type) of edges at a name, at most so many a query in the order of src, dst, type."""
    from pyspark.sql import Window

    own = edges if day is None else edges.where(valid_at(F.to_date("valid_from"), F.to_date("valid_to"), day))
    out = names.join(own, F.col("id") == F.col("src")).select("query_id", "src", "dst", "type").unionByName(names.join(own, F.col("id") == F.col("dst")).select("query_id", "src", "dst", "type")).distinct()
    return out.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("src", "dst", "type"))).where(F.col("n") <= most).drop("n")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges in and out."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def overview(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of largest degree, and the edges among them."""
    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(most)
    ids = F.broadcast(top.select("id"))
    return top, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def bridges(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, bridge, other) of seed - bridge - other over any two edges."""
    ways = both_ways(edges)
    first = seeds.select("query_id", "id").join(ways.select(F.col("src").alias("id"), F.col("dst").alias("bridge")), "id")
    return first.join(ways.select(F.col("src").alias("bridge"), F.col("dst").alias("other")), "bridge").where(F.col("other") != F.col("id")).select("query_id", "bridge", "other").distinct()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges), "id", "left_anti")


def pagerank(edges: DataFrame, teleport: DataFrame, alpha: float = ALPHA, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(query_id, id, score) of personalised PageRank over undirected weighted edges from teleport (query_id, id, weight).

    What sits on nodes without edges goes back to the teleport nodes. Scores of a query sum to 1.
    Bad weights, loops and nameless ends are left out.
    """
    w = F.col("weight").cast("double")
    good = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")) & (w > 0) & (w < float("inf")))
    ways = good.select("src", "dst", w.alias("w")).unionByName(good.select(F.col("dst").alias("src"), F.col("src").alias("dst"), w.alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = ways.groupBy("src").agg(F.sum("w").alias("total"))
    step = written(ways.join(out, "src").select(F.col("src").alias("id"), "dst", (F.col("w") / F.col("total")).alias("share")))
    has_edges = written(out.select(F.col("src").alias("id")))
    seeds = teleport.where((F.col("weight") > 0) & (F.col("weight") < float("inf")) & F.col("id").isNotNull())
    total = seeds.groupBy("query_id").agg(F.sum("weight").alias("t"))
    home = written(seeds.join(total, "query_id").groupBy("query_id", "id").agg((F.sum("weight") / F.max("t")).alias("home")))
    score = written(home.select("query_id", "id", F.col("home").alias("score")))
    for _ in range(rounds):
        moved = score.join(step, "id").groupBy("query_id", F.col("dst").alias("id")).agg((alpha * F.sum(F.col("score") * F.col("share"))).alias("part"))
        dangling = score.join(has_edges, "id", "left_anti").groupBy("query_id").agg(F.sum("score").alias("d"))
        back = home.join(dangling, "query_id", "left").select("query_id", "id", (F.col("home") * (1 - alpha + alpha * F.coalesce("d", F.lit(0.0)))).alias("part"))
        new = written(moved.unionByName(back).groupBy("query_id", "id").agg(F.sum("part").alias("score")))
        change = new.join(score.withColumnRenamed("score", "before"), ["query_id", "id"], "full").groupBy("query_id").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))).alias("x"))
        settled = (change.agg(F.max("x")).first()[0] or 0.0) <= tolerance
        discard(score)
        score = new
        if settled:
            break
    norm = score.groupBy("query_id").agg(F.sum("score").alias("s"))
    return score.join(norm, "query_id").select("query_id", "id", (F.col("score") / F.col("s")).alias("score")).where("score > 0")


def document_scores(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, doc_label, score): the largest score of a document's nodes (id, doc_label)."""
    return scores.join(labels.where("doc_label is not null"), "id").groupBy("query_id", "doc_label").agg(F.max("score").alias("score"))


def mention_counts(nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, mentions) of all nodes, 0 included."""
    n = mentions.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("mentions"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("mentions", F.lit(0)).alias("mentions"))


def name_variants(nodes: DataFrame, name: str) -> DataFrame:
    """(key, n, names) of names that are alike but for case, '_' and '.'."""
    key = F.trim(F.lower(F.translate(F.col(name), "_.", "  ")))
    return nodes.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(name)).alias("names")).where("n > 1")


def duplicate_edges(edges: DataFrame, most: int = 30) -> DataFrame:
    return edges.groupBy("src", "dst", "type").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "src", "dst", "type").limit(most)


def circular_pairs(alias_edges: DataFrame) -> DataFrame:
    """(a, b), a < b, of edges that go both ways."""
    e = alias_edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_semi").where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def entity_spread(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Least, mean and most entities of a document, those without any included."""
    n = mentions.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n"))
    per = docs.join(n, docs["id"] == n["src"], "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return per.agg(F.min("n").alias("least"), F.avg("n").alias("mean"), F.max("n").alias("most"))

