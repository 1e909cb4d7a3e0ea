"""Benchmark decontamination: spaced-seed hashing, in DataFrame functions alone.

Texts are split into lower-cased runs of letters and digits. Fixed masks pick some of the
positions of a window and ignore the others, so that a substituted word breaks only the
seeds that look at it. Seeds of benchmark and documents are joined, and each hit is verified
on its diagonal: the words of the item against the words of the document that stand there.

An item is found in a document when one of these holds:

- the words that agree, on all its diagonals with hits together, are MIN_SHARE of the item or
  more, and MIN_TOKENS or more (for items of few words SHORT_SHARE of the item, if that is less);
- RUN_TOKENS words or more agree in a dense run on one diagonal, whatever the item's length:
  from one to the next there are at most RUN_GAP places, so a few words may be substituted;
- the item has fewer words than MIN_TOKENS, and all of them stand in the document in their order.

Defined results: null and empty texts match nothing; repeated rows of documents give one
result for each doc_id, and rows without an id one for each text, for items likewise; items
may repeat; ties between diagonals go to the earliest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import written

#: Positions that each mask looks at; the others are ignored.
MASKS = [(0, 1, 2, 4, 5), (0, 2, 3, 5, 6)]
MIN_TOKENS = 8
MIN_SHARE = 0.5
SHORT_SHARE = 0.75
RUN_TOKENS = 13
RUN_GAP = 3
#: Benchmarks up to this many characters are broadcast; larger ones are joined by shuffle.
BROADCAST_CHARS = 32 << 20
#: Documents with hits up to this many are looked up by broadcast of their ids.
BROADCAST_IDS = 2_000_000
#: A document's items are verified in at most so many rows, each with its words once.
BLOCKS = 64


def token_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed_at(tokens: Column, k: int, mask: tuple[int, ...]):
    return lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(k), *[F.get(tokens, i + j) for j in mask]).alias("seed"))


def _places(tokens: Column, k: int, mask: tuple[int, ...]) -> Column:
    """array<struct<at, seed>> of one mask at every place."""
    at = F.transform(F.sequence(F.lit(0), F.size(tokens) - (mask[-1] + 1)), _seed_at(tokens, k, mask))
    return F.when(F.size(tokens) <= mask[-1], F.array().cast("array<struct<at:int,seed:bigint>>")).otherwise(at)


def _seeds(tokens: Column, lengths: list[int]) -> Column:
    """Seeds of every spaced mask, and whole sequences of the lengths that short items have."""
    span = max(m[-1] for m in MASKS)
    each = [F.transform(F.sequence(F.lit(0), F.size(tokens) - (m[-1] + 1)), _seed_at(tokens, k, m)) for k, m in enumerate(MASKS)]
    full = F.when(F.size(tokens) <= span, F.array().cast("array<struct<at:int,seed:bigint>>")).otherwise(F.concat(*each))
    return F.concat(full, *[_places(tokens, -n, tuple(range(n))) for n in lengths]) if lengths else full


def _item_seeds(item: Column, lengths: list[int]) -> Column:
    """Seeds of an item: of a short one the whole of it, of others those of the spaced masks."""
    seeds = _seeds(item, [])
    for n in lengths:
        seeds = F.when(F.size(item) == n, _places(item, -n, tuple(range(n)))).otherwise(seeds)
    return seeds


def _own(name: str) -> Column:
    """What tells rows without an id apart: their text. Null where there is an id."""
    return F.when(F.col(name).isNull(), F.xxhash64("text"))


def _longest_run(matched: Column) -> Column:
    """Most matching places in a row from one to the next of which there are at most RUN_GAP."""
    start = F.struct(F.lit(-1 - RUN_GAP).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, j: Column) -> Column:
        run = F.when(j - a["last"] <= RUN_GAP, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(j.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(matched, start, step, lambda a: a["best"])


def _verified(tokens: Column, hit: Column) -> Column:
    """Places of the item that agree on any of its diagonals in the document, where the first stands, and the longest run on one diagonal."""
    item = hit["item"]

    def agreeing(d: Column) -> Column:
        same = lambda j: F.coalesce((j + d >= 0) & (F.get(tokens, F.greatest(j + d, F.lit(0))) == F.get(item, j)), F.lit(False))
        return F.filter(F.sequence(F.lit(0), F.size(item) - 1), same)

    def add(a: Column, d: Column, m: Column) -> Column:
        matched = F.when(F.size(a["matched"]) == F.size(item), a["matched"]).otherwise(F.array_union(a["matched"], m))
        run = F.when(F.size(m) > a["run"], F.greatest(a["run"], _longest_run(m))).otherwise(a["run"])
        return F.struct(matched.alias("matched"), F.least(a["first_token"], d + F.get(m, F.lit(0))).alias("first_token"), run.alias("run"))

    start = F.struct(F.array().cast("array<int>").alias("matched"), F.lit(None).cast("int").alias("first_token"), F.lit(0).alias("run"))
    # an array of one element names what agrees, so that it is found once a diagonal
    whole = F.aggregate(hit["diagonals"], start, lambda a, d: F.aggregate(F.array(agreeing(d)), a, lambda b, m: add(b, d, m)))
    return F.struct(hit["item_id"].alias("item_id"), hit["item_own"].alias("item_own"), F.size(item).alias("n_item_tokens"), whole.alias("all"))


def _bounded(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df


def _found(documents: DataFrame, benchmark: DataFrame, min_tokens: int, min_share: float) -> DataFrame:
    """What overlaps() returns, and doc_own: the hash of the text of a document without an id."""
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    fits = size <= BROADCAST_CHARS
    short = max(min_tokens, max(m[-1] for m in MASKS) + 2)
    items = benchmark.where("text is not null").select("item_id", _own("item_id").alias("item_own"), token_hashes(F.col("text")).alias("item")).where(F.size("item") > 0)
    lengths = sorted(r.n for r in items.select(F.size("item").alias("n")).where(F.col("n") < short).distinct().collect())
    wanted = items.select("item_id", "item_own", F.explode(_item_seeds(F.col("item"), lengths)).alias("s")).select("item_id", "item_own", F.col("s.at").alias("item_at"), F.col("s.seed").alias("seed"))
    have = documents.where("text is not null").select("doc_id", _own("doc_id").alias("doc_own"), token_hashes(F.col("text")).alias("tokens"))
    placed = have.select("doc_id", "doc_own", F.explode(_seeds(F.col("tokens"), lengths)).alias("s")).select("doc_id", "doc_own", F.col("s.at").alias("at"), F.col("s.seed").alias("seed"))
    pairs = placed.join(_bounded(wanted, fits), "seed").select("doc_id", "doc_own", "item_id", "item_own", (F.col("at") - F.col("item_at")).alias("diagonal"))
    met = pairs.distinct().groupBy("doc_id", "doc_own", "item_id", "item_own").agg(F.collect_list("diagonal").alias("diagonals"))
    words = items.select(F.col("item_id").alias("words_id"), F.col("item_own").alias("words_own"), "item")
    met = met.join(_bounded(words, fits), F.col("item_id").eqNullSafe(F.col("words_id")) & F.col("item_own").eqNullSafe(F.col("words_own")))
    block = F.pmod(F.xxhash64("item_id", "item_own"), F.lit(BLOCKS)).alias("block")
    hits = written(met.groupBy("doc_id", "doc_own", block).agg(F.collect_list(F.struct("item_id", "item_own", "item", "diagonals")).alias("hits")))
    ids = hits.select("doc_id", "doc_own").distinct()
    few = ids.count() <= BROADCAST_IDS
    texts = documents.where("text is not null").select("doc_id", _own("doc_id").alias("doc_own"), "text")
    ids = ids.withColumnsRenamed({"doc_id": "text_id", "doc_own": "text_own"})
    texts = texts.join(_bounded(ids, few), F.col("doc_id").eqNullSafe(F.col("text_id")) & F.col("doc_own").eqNullSafe(F.col("text_own")), "left_semi")
    texts = texts.select(F.col("doc_id").alias("text_id"), F.col("doc_own").alias("text_own"), token_hashes(F.col("text")).alias("tokens"))
    lined = hits.join(texts, F.col("doc_id").eqNullSafe(F.col("text_id")) & F.col("doc_own").eqNullSafe(F.col("text_own")))
    got = lined.select("doc_id", "doc_own", F.explode(F.transform("hits", lambda h: _verified(F.col("tokens"), h))).alias("v")).select("doc_id", "doc_own", "v.item_id", "v.item_own", "v.n_item_tokens", "v.all.*").where(F.size("matched") > 0)
    each = got.groupBy("doc_id", "doc_own", "item_id", "item_own").agg(
        F.max("n_item_tokens").alias("n_item_tokens"),
        F.size(F.array_distinct(F.flatten(F.collect_set("matched")))).alias("n_matched"),
        F.min("first_token").alias("first_token"),
        F.max("run").alias("run"),
    )
    n, m = F.col("n_item_tokens"), F.col("n_matched")
    shared = (m >= F.least(F.lit(min_tokens), F.ceil(n * SHORT_SHARE))) & (m >= min_share * n)
    return each.where(F.when(n < short, m == n).otherwise(shared | (F.col("run") >= RUN_TOKENS))).drop("run", "item_own")


def overlaps(documents: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, item_id, n_item_tokens, n_matched, first_token (of the first matching word in the document): one row a pair found."""
    return _found(documents, benchmark, min_tokens, min_share).drop("doc_own")


def clean(documents: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, min_share: float = MIN_SHARE) -> DataFrame:
    """documents without those that hold a benchmark item."""
    found = _found(documents, benchmark, min_tokens, min_share).select(F.col("doc_id").alias("lodestream_id_"), F.col("doc_own").alias("lodestream_own_")).distinct()
    return documents.join(found, F.col("doc_id").eqNullSafe(F.col("lodestream_id_")) & _own("doc_id").eqNullSafe(F.col("lodestream_own_")), "left_anti")
