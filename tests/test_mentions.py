"""Mentions against plain containment, and what memories add to tool results against a loop."""

import random

import numpy as np
import pytest

from lodestream.operators import mentions


def pairs(df):
    return sorted((r.id, r.name) for r in df.collect())


def expected(texts, names):
    known = {}
    for n in sorted(n for n in names if n):
        known.setdefault(n.lower(), n)
    return sorted((i, n) for i, t in texts for low, n in known.items() if low in (t or "").lower())


@pytest.mark.parametrize("block, piece, text_bytes", [(1 << 17, 1024, 1 << 22), (40, 7, 50)])
def test_random_names_are_contained(spark, monkeypatch, block, piece, text_bytes):
    """Short alphabets give names inside names, suffixes of each other and overlaps over the cuts of pieces."""
    for k, v in (("BLOCK_BYTES", block), ("PIECE", piece), ("TEXT_BYTES", text_bytes)):
        monkeypatch.setattr(mentions, k, v)
    rng = random.Random(3)
    names = ["".join(rng.choices("abé B", k=rng.randint(1, 7))) for _ in range(120)] + ["", None, "Ab", "aB", "AB", "日本", "x" * 40]
    texts = [(k, "".join(rng.choices("abéB 日本", k=rng.randint(0, 60)))) for k in range(60)] + [(100, None), (101, ""), (102, "x" * 90), (103, "x" * 39), (5, "ab ab")]
    got = pairs(mentions.mentions(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string")))
    assert got == expected(texts, [n for n in names if n])


def test_passes_and_long_texts(spark, monkeypatch):
    """Several passes over the texts give the same pairs; a text of a megabyte is searched to its end; ids may be strings."""
    monkeypatch.setattr(mentions, "PASS_BYTES", 500)
    names = [f"name {k}" for k in range(200)]
    texts = [("long", "z" * 1_000_000 + " NAME 77"), ("short", "name 19, name 5"), ("none", "nothing")]
    got = pairs(mentions.mentions(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame([(n,) for n in names], "name string")))
    assert got == expected(texts, names) and ("long", "name 77") in got
    none = mentions.mentions(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame([], "name string"))
    assert none.count() == 0 and none.columns == ["id", "name"]


def test_automaton_of_suffixes():
    """Names that end in other names are all reported at one place."""
    names = [b"a", b"ba", b"cba", b"dcba", b"xcb", b"cb"]
    a = mentions.Automaton(names)
    data = np.frombuffer(b"dcba" + b"xcb" + b"zzz" + b"b", np.uint8)
    where, name = a.find(data, np.array([0, 4, 7, 10, 11]))
    assert {(int(w), names[k]) for w, k in zip(where, name)} == {(0, n) for n in (b"a", b"ba", b"cba", b"dcba", b"cb")} | {(1, b"xcb"), (1, b"cb")}


def test_enrichment_by_hand(spark):
    """Entities in order and at most five, three memories each of the own agent, contents once and not what is there."""
    names = [f"entity{k}" for k in range(9)]
    records = [(k, f"agent{k % 2}", f"memory {k // 3}" if k % 5 else None) for k in range(60)]
    about = [(k, names[k % 9], float(k % 7)) for k in range(60)] + [(k, names[(k + 1) % 9], 9.0) for k in range(0, 60, 4)]
    results = [(k, f"agent{k % 2}", " ".join(n for j, n in enumerate(names) if (k >> (j % 6)) & 1), "has memory 3 already" if k % 3 else None) for k in range(64)]
    out = mentions.enrich(
        spark.createDataFrame(results, "id long, agent string, text string, existing string"), spark.createDataFrame([(n,) for n in names], "name string"),
        spark.createDataFrame(about, "id long, name string, relevance double"), spark.createDataFrame(records, "id long, agent string, content string"),
    )
    own = {i: (a, c or "") for i, a, c in records}
    wanted = {}
    for i, agent, text, existing in results:
        met = sorted(n for n in names if n in text)
        lines = []
        for n in met[:5]:
            rows = sorted((-r, k) for k, m, r in about if m == n and own[k][0] == agent)[:3]
            for _, k in rows:
                c = own[k][1]
                if c and c not in (existing or "") and c not in "\n".join(lines):
                    lines.append(f"- {c}")
        if lines:
            added = "\n".join(lines)
            wanted[i] = (len(met), len(lines), len(added) // 4, added)
    assert {r.id: (r.n_entities, r.n_memories, r.n_tokens, r.added) for r in out.collect()} == wanted and len(wanted) > 40
