"""Forward push against converged power iteration, and subgraphs against a loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import push


def power(n, src, dst, weight, teleport, alpha=0.85):
    """Power iteration on a dense matrix until nothing changes."""
    home = np.where(np.isfinite(teleport) & (teleport > 0), teleport, 0)
    home = home / home.sum()
    m = np.zeros((n, n))
    for s, d, w in zip(src, dst, weight):
        if np.isfinite(w) and w > 0 and s != d:
            m[s, d] += w
            m[d, s] += w
    total = m.sum(1)
    p = home.copy()
    for _ in range(2_000):
        new = (1 - alpha) * home + alpha * (p[total > 0] @ (m[total > 0] / total[total > 0, None])) + alpha * p[total == 0].sum() * home
        if np.abs(new - p).sum() < 1e-15:
            break
        p = new
    return p / p.sum()


@pytest.mark.parametrize("seed", range(6))
def test_push_is_converged_power_iteration(seed):
    """Random graphs with loops, parallel edges, dangling nodes and bad weights."""
    rng = np.random.default_rng(seed)
    n, e = int(rng.integers(2, 400)), int(rng.integers(0, 1_500))
    src, dst = rng.integers(0, n, e), rng.integers(0, n, e)
    weight = rng.choice([1.0, 2.5, 7.0, 0.0, -1.0, np.nan, np.inf], e, p=[0.4, 0.3, 0.2, 0.03, 0.03, 0.02, 0.02])
    teleport = np.where(rng.random(n) < 0.3, rng.random(n), 0.0)
    teleport[0] = 1.0
    got, _ = push.push(n, src, dst, weight, teleport)
    assert np.abs(got - power(n, src, dst, weight, teleport)).sum() < 1e-6 and got.sum() == pytest.approx(1)


def test_push_stays_near_its_seeds():
    """On a long ring only nodes about the seed are pushed; without a teleport weight nothing is."""
    n = 20_000
    ring = np.arange(n)
    teleport = np.zeros(n)
    teleport[7] = 1.0
    got, pushed = push.push(n, ring, (ring + 1) % n, np.ones(n), teleport, tolerance=1e-4)
    assert (got > 0).sum() < 400 and pushed < n
    assert push.push(3, ring[:2], ring[1:3], np.ones(2), np.zeros(3))[0].sum() == 0


def hand_subgraph(seeds, edges, max_nodes):
    most, order = max_nodes * push.EDGES_PER_NODE, sorted(edges)
    near = [e for e in order if e[0] in seeds or e[1] in seeds][:most]
    frontier = set(sorted({x for e in near for x in e[:2]})[:max_nodes])
    rows = [e for e in order if e in near or e[0] in frontier or e[1] in frontier][:most]
    nodes = []
    for e in rows:
        for x in e[:2]:
            if x not in nodes and len(nodes) < max_nodes:
                nodes.append(x)
    return {e for e in rows if e[0] in nodes and e[1] in nodes}


@pytest.mark.parametrize("max_nodes", [4, 15])
def test_subgraphs_by_hand(spark, max_nodes):
    rng = random.Random(max_nodes)
    edges = sorted({(f"d{rng.randrange(60)}", f"e{rng.randrange(30)}", "MENTIONS") for _ in range(150)} | {(f"e{k}", f"e{k + 1}", "ALIAS") for k in range(0, 30, 4)} | {("d1", f"e{k}", "MENTIONS") for k in range(30)})
    seeds = {q: {f"e{rng.randrange(30)}" for _ in range(1 + q)} for q in range(4)}
    table = spark.createDataFrame([(*e, float(rng.randrange(5))) for e in edges], "src string, dst string, type string, weight double")
    own = spark.createDataFrame([(q, s) for q, x in seeds.items() for s in x] + [(9, None), (8, "nowhere")], "query_id long, id string")
    got = {}
    for r in push.subgraphs(own, table, max_nodes).collect():
        got.setdefault(r.query_id, set()).add((r.src, r.dst, r.type))
        assert r.weight >= 1
    assert got == {q: g for q, s in seeds.items() if (g := hand_subgraph(s, edges, max_nodes))}


def test_channel_edges(spark):
    """Weights that are missing count 1, a query whose anchors mention nothing has no hits, and documents are found through aliases."""
    edges = spark.createDataFrame([("d1", "e1", "MENTIONS", None), ("d2", "e2", "MENTIONS", 3.0), ("e1", "e2", "ALIAS", 9.0), ("d3", "e3", "MENTIONS", float("nan")), ("d4", "e1", "KNOWS", 5.0)], "src string, dst string, type string, weight double")
    docs = spark.createDataFrame([(f"d{k}",) for k in range(1, 6)], "id string")
    hits = spark.createDataFrame([(1, "d1", 0.9), (2, "d5", 0.8)], "query_id long, id string, score double")
    got = {(r.query_id, r.id): r.score for r in push.channel(hits, edges, docs).collect()}
    assert set(got) == {(1, "d1"), (1, "d2")} and got[1, "d2"] > got[1, "d1"]
    assert push.channel(hits.where(F.lit(False)), edges, docs).count() == 0


def test_a_hop_goes_on_from_so_many_nodes(spark):
    """Of a hub's 120 neighbours the 50 least are walked on from; all of them are found."""
    from lodestream.operators import graph

    edges = [("hub", f"n{k:03d}") for k in range(120)] + [(f"n{k:03d}", f"far{k:03d}") for k in range(120)]
    found = graph.reach(spark.createDataFrame([(1, "hub")], "query_id long, id string"), spark.createDataFrame(edges, "src string, dst string"), 2, frontier=graph.FRONTIER)
    got = {r.id: r.hop for r in found.collect()}
    assert got == {"hub": 0} | {f"n{k:03d}": 1 for k in range(120)} | {f"far{k:03d}": 2 for k in range(50)}
