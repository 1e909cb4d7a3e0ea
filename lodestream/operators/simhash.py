"""64-bit fingerprints of texts, the join of near ones, and the removal of near duplicates."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.text import shingles
from lodestream.operators.components import components
from lodestream.operators.storage import discard, merged, written

#: Bits that near fingerprints differ in at most; rounds by joins before chains are replayed.
NEAR, ROUNDS = 3, 6


def fingerprints(texts: DataFrame, id_: str, text: str, size: int = 3) -> DataFrame:
    """(id, fingerprint): each bit is the majority of that bit in the shingles' md5 prefixes; 0 for blank texts."""
    each = texts.select(F.col(id_).alias("id"), F.explode_outer(shingles(F.col(text), size)).alias("s"))
    h = each.select("id", F.conv(F.substring(F.md5("s"), 1, 16), 16, -10).cast("bigint").alias("h"))
    bit = lambda i: F.sum(F.when(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1))
    votes = h.groupBy("id").agg(F.count("h").alias("n"), *[bit(i).alias(f"b{i}") for i in range(64)])
    out = F.lit(0).cast("bigint")
    for i in range(64):
        out = out.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return votes.select("id", F.when(F.col("n") == 0, F.lit(0).cast("bigint")).otherwise(out).alias("fingerprint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(prints: DataFrame, most: int = NEAR, block: list[str] | None = None) -> DataFrame:
    """(block..., a, b, distance) of different fingerprints within most bits, a and b the least ids that have them.

    Ids of equal fingerprints are one class, so copies are never expanded into pairs. Two
    fingerprints within most bits agree on most of 2 * most blocks of bits or more: each choice of
    most blocks is a join key, of 32 bits and thus with few strangers in a corpus of any size.
    Zero fingerprints, those of blank texts, take no part.
    """
    block = block or []
    edges = [64 * i // (2 * most) for i in range(2 * most + 1)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen) for chosen in combinations(range(2 * most), most)]
    one = prints.where("fingerprint <> 0").groupBy(*block, "fingerprint").agg(F.min("id").alias("id"))
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint")
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fingerprint").bitwiseAND(signed(m)).alias("value")) for i, m in enumerate(masks)])
    posted = one.select(*block, "id", "fingerprint", F.explode(bands).alias("k")).select(*block, "id", "fingerprint", "k.band", "k.value")
    other = posted.select(*block, F.col("id").alias("b"), F.col("fingerprint").alias("g"), "band", "value")
    met = posted.withColumnRenamed("id", "a").join(merged(other), [*block, "band", "value"]).where(F.col("a") < F.col("b"))
    return met.select(*block, "a", "b", hamming(F.col("fingerprint"), F.col("g")).alias("distance")).where(F.col("distance") <= most).distinct()


def clusters(prints: DataFrame, most: int = NEAR) -> DataFrame:
    """(id, root) of every id that is near another or shares its fingerprint; root is the least id."""
    pairs = near_pairs(prints, most).select("a", "b")
    least = prints.where("fingerprint <> 0").groupBy("fingerprint").agg(F.min("id").alias("m"), F.count("*").alias("n")).where("n > 1")
    same = prints.join(merged(least), "fingerprint").where("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b"))
    return components(pairs.unionByName(same)).select(F.col("node").alias("id"), "root")


def _two_first(rows: DataFrame) -> DataFrame:
    """(f, r1, d1, r2): of rows (f, doc, rank), each doc once for an f, the least rank, its doc, and the least rank of another doc."""
    n = F.row_number().over(Window.partitionBy("f").orderBy("rank"))
    two = rows.withColumn("n", n).where(F.col("n") <= 2)
    return two.groupBy("f").agg(F.max(F.when(F.col("n") == 1, F.col("rank"))).alias("r1"), F.max(F.when(F.col("n") == 1, F.col("doc"))).alias("d1"), F.max(F.when(F.col("n") == 2, F.col("rank"))).alias("r2"))


def keep_greedily(prints: DataFrame, most: int = NEAR, rounds: int = ROUNDS) -> DataFrame:
    """(id, kept) by arrival order of ids: an item goes if it is near one of another document that was kept.

    prints: id, doc, fingerprint. All items of a document with one fingerprint share their first one's fate, so a node is such a pair; and as
    nodes of a fingerprint are near each other, the two least ranks of different documents say all about it. In rounds, a node stays
    that is before all undecided ones near it, and those near it go: a group of copies, however large, is settled by joins in a round or two.
    What is undecided after so many rounds are long chains, each node waiting for the one before; these are replayed
    a chain a task, along their edges. No side of a join is broadcast.
    """
    prints = written(prints.select("id", "doc", "fingerprint"))  # read several times
    own = prints.where("fingerprint <> 0").groupBy(F.col("fingerprint").alias("f"), "doc").agg(F.min("id").alias("rank"))
    least = prints.where("fingerprint <> 0").groupBy("fingerprint").agg(F.min("id").alias("id"))
    pairs = near_pairs(prints.select("id", "fingerprint"), most).select("a", "b")
    pairs = pairs.join(merged(least.select(F.col("id").alias("a"), F.col("fingerprint").alias("f"))), "a").join(merged(least.select(F.col("id").alias("b"), F.col("fingerprint").alias("g"))), "b").select("f", "g")
    shared = own.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f", F.col("f").alias("g"))
    ways = written(pairs.unionByName(pairs.select(F.col("g").alias("f"), F.col("f").alias("g"))).unionByName(pairs.select("f", F.col("f").alias("g"))).unionByName(pairs.select(F.col("g").alias("f"), "g")).unionByName(shared).distinct())
    open_ = written(own.join(merged(ways.select("f").distinct()), "f", "left_semi"))
    gone, used = [], [ways]
    for _ in range(rounds):
        if open_.isEmpty():
            break
        first = _two_first(open_)
        seen = ways.join(merged(first.withColumnRenamed("f", "g")), "g").select("f", F.explode(F.array(F.struct(F.col("r1").alias("rank"), F.col("d1").alias("doc")), F.struct(F.col("r2").alias("rank"), F.lit(None).cast(dict(own.dtypes)["doc"]).alias("doc")))).alias("x"))
        # the second of a fingerprint is of any other document: its own is found by its rank
        ranks = seen.where("x.rank is not null").select("f", "x.rank").distinct().join(merged(open_.select("rank", "doc")), "rank").groupBy("f", "doc").agg(F.min("rank").alias("rank"))
        met = open_.join(merged(_two_first(ranks)), "f")
        kept = written(met.where(F.coalesce(F.when(F.col("d1") != F.col("doc"), F.col("r1")).otherwise(F.col("r2")) > F.col("rank"), F.lit(True))).select("f", "doc", "rank"))
        blocks = ways.join(merged(kept.select(F.col("f").alias("g"), F.col("doc").alias("by"))), "g").groupBy("f").agg(F.min("by").alias("low"), F.max("by").alias("high"))
        left = open_.join(merged(kept.select("rank")), "rank", "left_anti").join(merged(blocks), "f", "left")
        hit = F.coalesce((F.col("low") != F.col("doc")) | (F.col("high") != F.col("doc")), F.lit(False))
        marked = written(left.select("f", "doc", "rank", hit.alias("hit")))
        gone.append(marked.where("hit").select("f", "doc"))
        used += [kept, marked, open_]
        open_ = marked.where("not hit").select("f", "doc", "rank")
    if not open_.isEmpty():
        links = ways.join(merged(open_.select("f").distinct()), "f", "left_semi").join(merged(open_.select(F.col("f").alias("g")).distinct()), "g", "left_semi")
        root = components(links.where("f <> g").select(F.col("f").alias("a"), F.col("g").alias("b"))).select(F.col("node").alias("f"), "root")
        near = links.groupBy("f").agg(F.collect_list("g").alias("near"))
        waiting = open_.join(merged(near), "f").join(merged(root), "f", "left").withColumn("root", F.coalesce("root", "f"))

        def replay(pdf: pd.DataFrame) -> pd.DataFrame:
            kept: dict[int, set] = {}
            out = []
            for x in pdf.sort_values("rank").itertuples():
                clash = any(kept.get(g, set()) - {x.doc} for g in x.near)
                if clash:
                    out.append((x.f, x.doc))
                else:
                    kept.setdefault(x.f, set()).add(x.doc)
            return pd.DataFrame(out, columns=["f", "doc"])

        gone.append(waiting.groupBy("root").applyInPandas(replay, f"f long, doc {dict(own.dtypes)['doc']}"))
    lost = None
    for part in gone:
        lost = part if lost is None else lost.unionByName(part)
    items = prints.select("id", "doc", F.col("fingerprint").alias("f"))
    if lost is None:
        return items.select("id", F.lit(True).alias("kept"))
    out = written(items.join(merged(lost.select("f", "doc", F.lit(False).alias("kept"))), ["f", "doc"], "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept")))
    discard(prints, *[t for t in used if hasattr(t, "_lodestream_path")])
    return out
