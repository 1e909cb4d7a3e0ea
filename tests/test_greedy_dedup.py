"""Greedy removal of near duplicates against a replay in arrival order."""

import random

import pytest

from lodestream.operators import simhash


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def replay(rows, most=3):
    kept, out = {}, {}
    for i, doc, f in sorted(rows):
        f &= (1 << 64) - 1
        clash = f != 0 and any((f ^ g).bit_count() <= most and docs - {doc} for g, docs in kept.items())
        out[i] = not clash
        if f and not clash:
            kept.setdefault(f, set()).add(doc)
    return out


@pytest.mark.parametrize("rounds", [0, 6])
def test_random_groups_equal_a_replay(spark, rounds):
    """Near prints, copies, several prints of a document, zero prints; by joins alone, by replay alone, and by both."""
    rng = random.Random(rounds)
    rows = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            f = base
            for bit in rng.sample(range(64), rng.randrange(5)):
                f ^= 1 << bit
            rows += [(0, rng.randrange(25), signed(f)) for _ in range(rng.randrange(1, 4))]
    rows += [(0, k, 0) for k in range(3)]
    ids = rng.sample(range(10_000), len(rows))
    rows = [(i, d, f) for i, (_, d, f) in zip(ids, rows)]
    df = spark.createDataFrame(rows, "id long, doc long, fingerprint long")
    got = {r.id: r.kept for r in simhash.keep_greedily(df, rounds=rounds).collect()}
    assert got == replay(rows) and not all(got.values())


def test_a_long_chain_and_many_copies(spark):
    """A chain whose items wait for each other in turn, and a thousand copies."""
    rng = random.Random(2)
    f, rows = rng.getrandbits(64), []
    for k in range(1_500):
        rows.append((k, k, signed(f)))
        for bit in rng.sample(range(64), 3):
            f ^= 1 << bit
    copy = rng.getrandbits(64)
    rows += [(5_000 + k, k, signed(copy)) for k in range(1_000)]
    got = {r.id: r.kept for r in simhash.keep_greedily(spark.createDataFrame(rows, "id long, doc long, fingerprint long"), rounds=2).collect()}
    assert got == replay(rows) and sum(got[5_000 + k] for k in range(1_000)) == 1
