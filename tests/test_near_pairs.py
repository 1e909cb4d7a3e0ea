"""Near fingerprints against all pairs."""

import random

import pytest

from lodestream.operators import simhash


@pytest.mark.parametrize("most", [1, 3])
def test_near_pairs_are_all_pairs(spark, most):
    rng = random.Random(most)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for f in prints[:40]:
        for n in range(6):
            g = f
            for bit in rng.sample(range(64), n):
                g ^= 1 << bit
            prints.append(g)
    prints += prints[:5] + [0, 0, None]
    signed = lambda f: f - (1 << 64) if f is not None and f >> 63 else f
    rows = [(i, signed(f)) for i, f in enumerate(prints)]
    least = {}
    for i, f in enumerate(prints):
        if f:
            least.setdefault(f, i)
    own = sorted(least.items(), key=lambda x: x[1])
    want = {(i, j, (f ^ g).bit_count()) for k, (f, i) in enumerate(own) for g, j in own[k + 1 :] if (f ^ g).bit_count() <= most}
    got = [(r.a, r.b, r.distance) for r in simhash.near_pairs(spark.createDataFrame(rows, "id long, fingerprint long"), most).collect()]
    assert len(got) == len(set(got)) and set(got) == want
