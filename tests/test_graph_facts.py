"""Graph facts under a budget against a loop that adds them one by one."""

import random

import pytest

from lodestream.operators import context


def by_hand(rows, budget):
    cost = lambda r: len(str(r[2])) + len(str(r[3])) + len(str(r[4])) + 24
    out = set()
    for q in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == q), key=lambda r: r[5])
        kept = [r for r in own if r[1] == "person"]
        for tier in ("entity", "relation", "document"):
            names = {r[2] for r in kept if r[1] in ("person", "entity")}
            for r in own:
                if r[1] == tier and (tier != "relation" or r[3] in names or r[4] in names):
                    if sum(map(cost, [*kept, r])) // 4 > budget:
                        break
                    kept.append(r)
        out |= {(r[0], r[5]) for r in kept}
    return out


@pytest.mark.parametrize("budget", [40, 400])
def test_facts_equal_a_loop(spark, budget):
    rng = random.Random(budget)
    rows = []
    for q in range(6):
        for k in range(rng.randrange(1, 70)):
            kind = rng.choices(["person", "entity", "relation", "document", "other"], [1, 5, 6, 4, 1])[0]
            name = lambda: rng.choice([None, "", f"n{rng.randrange(12)}", "a longer name"])
            rows.append((q, kind, name(), name() if kind == "relation" else None, name() if kind == "relation" else None, k))
    rows += [(9, "entity", f"hot {k}", None, None, k) for k in range(3_000)]
    df = spark.createDataFrame(rows, "query_id long, kind string, name string, src string, dst string, place long")
    got = context.graph_facts(df, budget)
    assert got.columns == df.columns
    found = [(r.query_id, r.place) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == by_hand(rows, budget)
