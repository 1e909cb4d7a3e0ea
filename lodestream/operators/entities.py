"""Names and what they mean: fuzzy matches, alias tiers, resolution of new entities, clean-up of extracted graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.text import entity_type, role_not_person, valid_entity_name, words
from lodestream.operators.dense import cosine
from lodestream.operators.ranking import first_by
from lodestream.operators.storage import merged

# Least similarity of names, of meanings, and how many candidates meanings are compared with.
FUZZY, SEMANTIC, MOST_CANDIDATES = 90, 0.88, 50


# Types that are people, and nicknames with what they stand for.
PERSON_TYPES = ["person", "human", "employee", "user"]
NICKNAMES = {"kostya": "konstantin", "костя": "константин"}


def tidy(name: Column) -> Column:
    """Lower-cased words of letters, digits and underscores, nicknames in full, with one blank between."""
    whole = F.create_map(*[F.lit(x) for pair in NICKNAMES.items() for x in pair])
    plain = words(F.regexp_replace(F.lower(name), r"(?U)[^\w]+", " "))
    return F.array_join(F.transform(plain, lambda w: F.coalesce(F.try_element_at(whole, w), w)), " ")


def name_similarity(a: Column, b: Column) -> Column:
    """Percent, the largest of three ratios of two tidy names: as they are, with their words sorted, and as sets of words.

    A ratio is twice the length of the longest common subsequence against both lengths together. As
    sets, common words and what each name has besides are compared: 100 if one's words contain the other's.
    """

    def common(x: str, y: str) -> int:
        """Length of the longest common subsequence; a bit of the state is 0 where it grows."""
        where: dict[str, int] = {}
        for k, c in enumerate(x):
            where[c] = where.get(c, 0) | 1 << k
        full = (1 << len(x)) - 1
        state = full
        for c in y:
            kept = state & where.get(c, 0)
            state = ((state + kept) | (state - kept)) & full
        return len(x) - state.bit_count()

    def percent(edits: int, total: int) -> float:
        return 100.0 * (total - edits) / total if total else 100.0

    def ratio(x: str, y: str) -> float:
        return percent(len(x) + len(y) - 2 * common(x, y), len(x) + len(y))

    def of_sets(x: set, y: set) -> float:
        both, p, q = (" ".join(sorted(w)) for w in (x & y, x - y, y - x))
        if both and not (p and q):
            return 100.0
        blank = 1 if both else 0
        n, np, nq = len(both), len(both) + blank + len(p), len(both) + blank + len(q)
        found = percent(len(p) + len(q) - 2 * common(p, q), np + nq)
        return max(found, percent(blank + len(p), n + np), percent(blank + len(q), n + nq)) if both else found

    def best(x: str | None, y: str | None) -> float | None:
        if not x or not y:
            return None
        u, v = x.split(" "), y.split(" ")
        return max(ratio(x, y), ratio(" ".join(sorted(u)), " ".join(sorted(v))), of_sets(set(u), set(v)))

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([best(*pair) for pair in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def _pieces(n: Column) -> Column:
    """Into how many pieces a known name of n characters is cut: one more than edits that FUZZY allows, two ninths of n at most."""
    return F.floor(n * 2 / 9).cast("int") + 1


def _segments(name: Column) -> Column:
    """array<struct<n, i, s>>: the pieces of a known name of n characters."""
    n = F.length(name)
    pieces = _pieces(n)
    start = lambda i: F.floor(i * n / pieces).cast("int")
    return F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.struct(n.alias("n"), i.alias("i"), F.substring(name, start(i) + 1, start(i + 1) - start(i)).alias("s")))


def _probes(name: Column) -> Column:
    """array<struct<n, i, s>>: what stands in a new name where pieces of known names of n characters may be.

    Within FUZZY percent a tenth of both lengths together is inserted or removed at most. These edits
    leave one piece whole, and move it right by the insertions at most, left by the removals.
    """
    own = F.length(name)

    def of_piece(n: Column, i: Column) -> Column:
        edits = F.floor((n + own) / 10).cast("int")
        start, stop = F.floor(i * n / _pieces(n)).cast("int"), F.floor((i + 1) * n / _pieces(n)).cast("int")
        removed, inserted = F.floor((edits + n - own) / 2).cast("int"), F.floor((edits + own - n) / 2).cast("int")
        places = F.filter(F.sequence(start - removed, start + inserted), lambda at: (at >= 0) & (at + stop - start <= own))
        return F.transform(places, lambda at: F.struct(n.alias("n"), i.alias("i"), F.substring(name, at + 1, stop - start).alias("s")))

    lengths = F.filter(F.sequence(F.floor(own * 9 / 11).cast("int"), F.floor(own * 11 / 9).cast("int")), lambda n: F.abs(n - own) * 10 <= n + own)
    return F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(F.sequence(F.lit(0), _pieces(n) - 1), lambda i: of_piece(n, i)))))


def _rare_words(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(type, key, w): of each tidy name (type, key) its rarest words among known names (type, w, n).

    As sets of words two names are alike within FUZZY percent only if what one of them has besides the common words is two elevenths of it
    at most. So its rarest words, as many as are more than that together, have one that is common.
    """
    each = names.select("type", "key", F.explode(F.array_distinct(words(F.col("key")))).alias("w")).join(counts.select("type", "w", "n"), ["type", "w"], "left")
    lists = each.groupBy("type", "key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))).alias("by"))
    total = F.aggregate("by", F.lit(-1), lambda t, x: t + F.length(x["w"]) + 1)
    taken = F.aggregate(
        "by", F.struct(F.lit(0).alias("sum"), F.array().cast("array<string>").alias("out")),
        lambda t, x: F.when(t["sum"] * 11 > total * 2, t).otherwise(F.struct((t["sum"] + F.length(x["w"])).alias("sum"), F.concat(t["out"], F.array(x["w"])).alias("out"))),
    )
    return lists.select("type", "key", F.explode(taken["out"]).alias("w"))


def word_candidates(asked: DataFrame, known: DataFrame, counts: DataFrame) -> DataFrame:
    """(type, x, y): pairs of different tidy names asked (type, x) and known (type, y) that hold all that are alike as sets of words,
    but for asked names of one word in known ones: these need no pairs. counts: known names (n) of each word (type, w).
    """
    of = lambda names, c: names.select("type", c, F.explode(F.array_distinct(words(F.col(c)))).alias("w"))
    rare = lambda names, c: _rare_words(names.withColumnRenamed(c, "key"), counts).withColumnRenamed("key", c)
    several = asked.where(F.size(F.array_distinct(words(F.col("x")))) > 1)
    by_asked = rare(several, "x").join(of(known, "y"), ["type", "w"]).select("type", "x", "y")
    by_known = of(asked, "x").join(rare(known, "y"), ["type", "w"]).select("type", "x", "y")
    return by_asked.unionByName(by_known).distinct()


def piece_candidates(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(type, x, y): pairs that hold all that are alike as they are, with their words sorted, or with each word once and sorted.

    Known names of one length that begin alike share a piece: they are all compared with an asked name that begins so.
    """
    ordered = lambda w: F.array_join(F.array_sort(w), " ")
    keys = lambda c, pieces: F.array_distinct(F.concat(pieces(c), pieces(ordered(words(c))), pieces(ordered(F.array_distinct(words(c))))))
    return asked.withColumn("k", F.explode(keys(F.col("x"), _probes))).join(known.withColumn("k", F.explode(keys(F.col("y"), _segments))), ["type", "k"]).select("type", "x", "y").distinct()


def resolve(new: DataFrame, known: DataFrame) -> DataFrame:
    """(id, match, how) of new entities (id, name, type, vector) among known ones (name, type, vector).

    The same name without case wins; then the most similar name from 90 percent on; then, where a
    type has no more than 50 known entities, the closest meaning from 0.88 on. A person of one word
    is not compared by similarity: it takes the only longer name that has this word. Candidates share
    a type, and a word that is rare among known names or, as they are or with their words sorted, all or each once, a piece
    that the edits of 90 percent must leave whole. Each pair of different names is compared once, whatever the
    entities that have them; a name of one word takes the least name with this word from a table of words, so a word that all names have makes
    no pairs. Names without a word match nothing but by meaning.
    """
    same = F.lower(F.trim("name"))
    a = new.select("id", "type", same.alias("same"), tidy(F.col("name")).alias("x"), F.col("vector").alias("v"))
    b = known.select("type", F.col("name").alias("match"), same.alias("same"), tidy(F.col("name")).alias("y"), F.col("vector").alias("u"))
    exact = a.join(b.where("same <> ''").groupBy("type", "same").agg(F.min("match").alias("match")), ["type", "same"]).select("id", "match", F.lit(0).alias("tier"), F.lit(100.0).alias("score"), F.lit("exact").alias("how"))
    single = F.lower(F.trim("type")).isin(PERSON_TYPES) & (F.size(words(F.col("x"))) == 1)
    asked = a.where("x <> ''").select("type", "x").distinct()
    names = b.where("y <> ''").groupBy("type", "y").agg(F.min("match").alias("match"), F.max("match").alias("last"))
    held = names.select("type", "match", "last", (F.size(words(F.col("y"))) > 1).alias("long"), F.explode(F.array_distinct(words(F.col("y")))).alias("w"))
    counts = held.groupBy("type", "w").agg(F.count("*").alias("n"), F.min("match").alias("match"), F.min(F.when(F.col("long"), F.col("match"))).alias("first"), F.max(F.when(F.col("long"), F.col("last"))).alias("last"))
    compared = asked.where(F.coalesce(~single, F.lit(True)))
    pairs = word_candidates(compared, names.select("type", "y"), counts).unionByName(piece_candidates(compared, names.select("type", "y"))).distinct()
    near = pairs.withColumn("score", name_similarity(F.col("x"), F.col("y"))).where(F.col("score") >= FUZZY)
    near = near.join(names.select("type", "y", "match"), ["type", "y"]).select("type", "x", "match", "score")
    one = compared.where(F.size(F.array_distinct(words(F.col("x")))) == 1).withColumn("w", F.get(words(F.col("x")), 0))
    inside = one.join(counts, ["type", "w"]).select("type", "x", "match", F.lit(100.0).alias("score"))
    only = asked.where(single).join(counts.where("first = last"), [asked["type"] == counts["type"], F.col("x") == F.col("w")]).select(asked["type"], "x", F.col("first").alias("match"), F.lit(100.0).alias("score"))
    closest = first_by(near.unionByName(inside).unionByName(only), ["type", "x"], [-F.col("score"), F.col("match")])
    fuzzy = a.join(closest, ["type", "x"]).select("id", "match", F.lit(1).alias("tier"), "score", F.lit("fuzzy").alias("how"))
    few = b.join(b.groupBy("type").agg(F.count("*").alias("n")).where(F.col("n") <= MOST_CANDIDATES).select("type"), "type", "left_semi")
    meant = a.where("v is not null").join(few.where("u is not null"), "type").withColumn("score", cosine(F.col("v"), F.col("u"))).where(F.col("score") >= SEMANTIC)
    every = exact.unionByName(fuzzy).unionByName(meant.select("id", "match", F.lit(2).alias("tier"), "score", F.lit("semantic").alias("how")))
    best = first_by(every, ["id"], [F.col("tier"), -F.col("score"), F.col("match")]).select("id", "match", "how")
    return new.select("id").join(best, "id", "left").select("id", "match", F.coalesce("how", F.lit("new")).alias("how"))


def alias_tiers(asked: DataFrame, custom: DataFrame, people: DataFrame) -> DataFrame:
    """(query_id, person) for asked (query_id, name): custom aliases (alias, person) alone if there is one; else all people (person, name, email)
    of whom a part of the name, the part of the address before @, or with three characters or more a piece of the name fits; else the same with a case ending cut off. No side of a join is broadcast."""
    q = asked.select("query_id", F.lower(F.trim("name")).alias("q"))
    stem = F.regexp_replace("q", "(ой|ей|ом|ем|ами|ями|а|у|е|ы|и|ю|я)$", "")
    own = q.join(merged(custom.select(F.lower("alias").alias("q"), "person")), "q").select("query_id", "person", F.lit(0).alias("tier"))
    p = people.select("person", F.lower("name").alias("name"), F.lower(F.split("email", "@")[0]).alias("mail"))
    parts = p.select("person", F.explode(F.array_distinct(F.concat(words(F.col("name")), F.array("mail")))).alias("part")).where("part <> ''")

    def fits(form: DataFrame, tier: int) -> DataFrame:
        whole = form.join(merged(parts.withColumnRenamed("part", "q")), "q").select("query_id", "person")
        grams = lambda c: F.transform(F.sequence(F.lit(0), F.length(c) - 3), lambda i: F.substring(c, i + 1, F.lit(3)))
        names = p.where("length(name) >= 3").select("person", "name", F.explode(F.array_distinct(grams(F.col("name")))).alias("g"))
        piece = form.where("length(q) >= 3").withColumn("g", F.substring("q", 1, 3)).join(merged(names), "g").where(F.contains("name", "q")).select("query_id", "person")
        return whole.unionByName(piece).distinct().withColumn("tier", F.lit(tier))

    every = own.unionByName(fits(q, 1)).unionByName(fits(q.withColumn("s", stem).where("s <> q and length(s) >= 3").select("query_id", F.col("s").alias("q")), 2))
    low = every.groupBy("query_id").agg(F.min("tier").alias("low"))
    return every.join(merged(low), "query_id").where("tier = low").select("query_id", "person").distinct()


def clean_extraction(entities: DataFrame, relations: DataFrame, names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities (doc, name, type, mention_count), relations (doc, src, dst, type)) as a graph may have them.

    Types are normalised, roles are organisations, people take their canonical names, invalid names
    go, and so do relations whose ends are not among the document's entities.
    """
    e = entities.select("doc", F.trim("name").alias("raw"), entity_type(F.col("type")).alias("type")).where(valid_entity_name(F.col("raw")))
    e = e.withColumn("type", F.when(role_not_person(F.col("raw"), F.col("type")), "Organization").otherwise(F.col("type")))
    name = F.col("raw")
    for variant, whole in (names or {}).items():
        name = F.when((F.col("type") == "Person") & (F.lower("raw") == variant.lower()), whole).otherwise(name)
    e = e.withColumn("name", name)
    counted = e.groupBy("doc", "name", "type").agg(F.count("*").alias("mention_count"))
    known = e.select("doc", "raw", "name").distinct()
    r = relations.join(known.select("doc", F.col("raw").alias("src"), F.col("name").alias("s")), ["doc", "src"]).join(known.select("doc", F.col("raw").alias("dst"), F.col("name").alias("d")), ["doc", "dst"])
    return counted, r.select("doc", F.col("s").alias("src"), F.col("d").alias("dst"), "type").where("src <> dst").distinct()
