"""Entity resolution against every known name."""

import random

import pytest

from pyspark.sql import functions as F

from lodestream.operators import entities
from lodestream.plans import catalog


def test_fuzzy_matches_equal_all_pairs(spark):
    rng = random.Random(8)
    letters = "abcdefghijk"
    known = ["kubernetes"] + [" ".join("".join(rng.choices(letters, k=rng.randint(3, 12))) for _ in range(rng.randint(1, 4))) for _ in range(60)]

    def changed(name):
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice(["", rng.choice(letters), rng.choice(letters) + name[at]]) + name[at + 1 :]
        return " ".join(rng.sample(name.split(), len(name.split()))) if rng.random() < 0.3 else name

    asked = ["cubernetes"] + [changed(rng.choice(known)) for _ in range(150)]
    new = spark.createDataFrame([(i, n, "Tool", None) for i, n in enumerate(asked)], "id long, name string, type string, vector array<double>")
    old = spark.createDataFrame([(n, "Tool", None) for n in known], "name string, type string, vector array<double>")
    pairs = new.select("id", entities.tidy(F.col("name")).alias("x")).crossJoin(old.select(entities.tidy(F.col("name")).alias("y")))
    near = {r.id for r in pairs.where(entities.name_similarity(F.col("x"), F.col("y")) >= entities.FUZZY).select("id").distinct().collect()}
    got = {r.id: r for r in entities.resolve(new, old).collect()}
    assert (got[0].match, got[0].how) == ("kubernetes", "fuzzy")
    assert {i for i, r in got.items() if r.how != "new"} == near and 10 < len(near) < len(asked)


def test_common_words_make_no_pairs(spark):
    """Names that share a word, asked for by names that have it too: candidates by words in proportion to the names, matches by it alone still found."""
    rng = random.Random(5)
    known = [f"corporation {k:05d} {''.join(rng.choices('abcdefghijklmnop', k=9))}" for k in range(3_000)]
    asked = [rng.choice(known).replace("corporation ", "corporation of ") for _ in range(40)] + ["corporation"] * 10 + [f"corporation {rng.randrange(10**9)}" for _ in range(10)] + ["Corporation 00007"]
    new = spark.createDataFrame([(i, n, "Firm", None) for i, n in enumerate(asked)], "id long, name string, type string, vector array<double>")
    old = spark.createDataFrame([(n, "Firm", None) for n in known], "name string, type string, vector array<double>")
    x = new.select("type", entities.tidy(F.col("name")).alias("x")).distinct()
    y = old.select("type", entities.tidy(F.col("name")).alias("y")).distinct()
    counts = y.select("type", F.explode(F.array_distinct(F.split("y", " "))).alias("w")).groupBy("type", "w").agg(F.count("*").alias("n"))
    assert entities.word_candidates(x, y, counts).count() <= len(asked)
    got = {r.id: r for r in entities.resolve(new, old).collect()}
    assert all(got[i].match == asked[i].replace("corporation of ", "corporation ") for i in range(40))
    assert all((got[i].match, got[i].how) == (min(known), "fuzzy") for i in range(40, 50))
    assert got[len(asked) - 1].match == next(n for n in known if "00007" in n)


def test_query_uses_vectors(spark, sf):
    got = catalog.QUERIES["g8_t23_entity_resolution"](spark, sf)
    parts = spark.read.parquet(f"{sf}/part.parquet")
    assert got.count() == parts.where("p_partkey % 2 = 1").count()
    assert got.where("how = 'semantic'").count() > 0


def test_similarity_by_hand(spark):
    def common(x, y):
        rows = [[0] * (len(y) + 1)]
        for c in x:
            rows.append([0])
            for k, d in enumerate(y):
                rows[-1].append(rows[-2][k] + 1 if c == d else max(rows[-2][k + 1], rows[-1][k]))
        return rows[-1][-1]

    rng = random.Random(3)
    pairs = [("".join(rng.choices("abcd", k=rng.randint(1, 80))), "".join(rng.choices("abcd", k=rng.randint(1, 80)))) for _ in range(60)]
    expected = [200.0 * common(x, y) / (len(x) + len(y)) for x, y in pairs]
    pairs += [("acme corp holdings", "acme corp holding group"), ("lee anna", "anna lee"), ("anna", "anna lee"), ("kubernetes", "cubernetes")]
    expected += [100 - 700 / 41, 100.0, 100.0, 90.0]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, x string, y string")
    got = [r.s for r in rows.select("k", entities.name_similarity(F.col("x"), F.col("y")).alias("s")).orderBy("k").collect()]
    assert got == pytest.approx(expected)


def test_person_of_one_word(spark):
    new = spark.createDataFrame([(1, "Anna", "Person", None), (2, "Lee", "Person", None), (3, "Bob", "Person", None), (4, "", "Person", None), (5, "anna lee", "person", None), (6, "ANNA lee ", "Person", None), (7, "Kostya (Orlov)", "Person", None), (8, None, "Person", None)], "id long, name string, type string, vector array<double>")
    known = spark.createDataFrame([("Anna Lee", "Person", None), ("Lee Kim", "Person", None), ("Bobby", "Person", None), ("Konstantin Orlov", "Person", None), (None, "Person", None), ("Anna Lee", "Person", None)], "name string, type string, vector array<double>")
    got = {r.id: (r.match, r.how) for r in entities.resolve(new, known).collect()}
    assert got == {1: ("Anna Lee", "fuzzy"), 2: (None, "new"), 3: (None, "new"), 4: (None, "new"), 5: (None, "new"), 6: ("Anna Lee", "exact"), 7: ("Konstantin Orlov", "fuzzy"), 8: (None, "new")}
