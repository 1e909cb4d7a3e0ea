"""Empty tables, clashing names, very long texts and ties for every corpus operator; fits against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import chat, decontam, jaccard, lines, mixing, quality, rules, secrets, suffixes, tokens
from lodestream.llm.common import read_table

CLASH = ("score", "key", "n", "at", "seed", "diagonal", "item_id", "item", "tokens", "matched", "doc_own", "text_", "row_", "spans", "label_", "rate", "posterior", "n_tokens", "unit", "digest")


@pytest.fixture(scope="module")
def tables(spark, sf):
    return {t: read_table(spark, sf, t) for t in ("documents", "labels", "benchmark", "conversations")}


def plans(documents, labels, benchmark, conversations):
    calls, results, others = chat.from_conversations(conversations)
    return {
        "op1": secrets.digest(documents), "op2": suffixes.dedup(documents), "op3": lines.digest(documents), "op4": quality.score(documents, labels), "op5": chat.link(calls, results, chat.REPLY_SCHEMA, others),
        "op6": tokens.count_tokens(documents), "op7": mixing.mix(documents, labels), "op8": jaccard.join(documents), "op9": rules.judge(documents, labels), "op10": decontam.overlaps(documents, benchmark),
    }


def test_empty_documents(tables):
    """No rows in, no rows out, with the same columns."""
    none = {t: tables[t].limit(0) if t in ("documents", "conversations") else tables[t] for t in tables}
    got, whole = plans(**none), plans(**tables)
    for name, df in got.items():
        assert df.count() == 0 and df.columns == whole[name].columns, name


def test_empty_side_tables(tables):
    """Without labels and items every document still has its row; nothing is found."""
    few = tables["documents"].where("doc_id < 40")
    none = {t: tables[t].limit(0) for t in ("labels", "benchmark")}
    assert quality.score(few, none["labels"]).where("score = 0.5").count() == few.count()
    assert rules.judge(few, none["labels"]).where("kept <> base_failed").count() == few.count()
    assert mixing.mix(few, none["labels"]).count() == few.count()
    assert decontam.overlaps(few, none["benchmark"]).count() == 0 and decontam.clean(few, none["benchmark"]).count() == few.count()


def test_clashing_names(tables):
    """Columns of the input with names that the operators use change no result."""
    few = tables["documents"].where("doc_id < 60")
    more = few.withColumns({c: F.lit("own") for c in CLASH})
    own = {"labels": tables["labels"].withColumn("text", F.lit("own")), "benchmark": tables["benchmark"].withColumns({"doc_id": F.lit("own"), "tokens": F.lit("own")}), "conversations": tables["conversations"].where("conv_id < 5").withColumns({"call_id": F.lit("own"), "name": F.lit("own"), "level": F.lit("own")})}
    plain = plans(few, tables["labels"], tables["benchmark"], tables["conversations"].where("conv_id < 5"))
    for name, df in plans(more, **own).items():
        rows = lambda d: sorted(str(r) for r in d.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in d.dtypes]).collect())
        assert rows(df) == rows(plain[name]), name


def test_long_texts(spark):
    """Texts of a megabyte, twice each: a passage, its copies and an item of the benchmark are found in them."""
    rng = random.Random(1)
    word = [f"w{k}" for k in range(5_000)]
    item = [f"q{k}" for k in range(40)]
    text = " ".join(rng.choices(word, k=100_000) + item + rng.choices(word, k=100_000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "w " * 300_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "w " * 60)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench).collect()} == {(1, 7), (2, 7), (3, 8)}
    cut = {r.doc_id: r for r in suffixes.dedup(docs).collect()}
    assert [cut[d].n_removed for d in (1, 2, 3)] == [len(text), len(text), 600_000] and cut[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_quality_by_brute_force(tables):
    """Scores from class means and covariances of all training rows, by plain inverses and determinants."""
    from lodestream.llm.common import texts_of
    from lodestream.llm.stats import features

    import pyarrow as pa
    import zlib

    text = {r.doc_id: r.text for r in tables["documents"].collect()}
    label = {r.doc_id: r.quality for r in tables["labels"].collect() if r.quality is not None and r.doc_id in text}
    ids = list(text)
    x = np.vstack([features(t) for _, t in texts_of(pa.array([text[i] for i in ids]))])
    at = {i: k for k, i in enumerate(ids)}
    own = {c: x[[at[i] for i in label if label[i] == c and zlib.crc32(str(i).encode()) % 5]] for c in (0, 1)}
    total, d = sum(map(len, own.values())), x.shape[1]
    pooled = np.diag(sum(((v - v.mean(0)) ** 2).sum(0) for v in own.values()) / total) + 1e-4 * np.eye(d)
    density = []
    for c, v in own.items():
        weight = quality.SHRINKAGE + (1 - quality.SHRINKAGE) * d / (d + len(v))
        cov = (1 - weight) * np.cov(v.T, bias=True) + weight * pooled
        off = x - v.mean(0)
        density.append(np.log(len(v) / total) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))
    expected = 1 / (1 + np.exp(np.clip(density[0] - density[1], -600, 600)))
    got = {r.doc_id: r.score for r in quality.score(tables["documents"], tables["labels"]).collect()}
    assert [got[i] for i in ids] == pytest.approx(list(expected), abs=1e-6)


def test_forest_paths_by_hand():
    """Path lengths of the flat trees are those of a walk from node to node; scores follow from their mean."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 3))
    forest = rules.IsolationForest(x, x.std(axis=0), trees=10, per_tree=64)
    at = rng.normal(0, 3, (40, 3))

    def walk(tree, row):
        feature, cut, left, path = tree
        node = 0
        while feature[node] >= 0:
            node = left[node] + int(row[feature[node]] >= cut[node])
        return path[node]

    c = 2 * (sum(1 / k for k in range(1, 64))) - 2 * 63 / 64
    expected = [2 ** (-np.mean([walk(t, r) for t in forest.trees]) / c) for r in at]
    assert list(forest.score(at)) == pytest.approx(expected, rel=5e-3)


def test_rates_by_brute_force(spark):
    """Rates of projected gradient are nonnegative, meet targets in reach, and come close to the nearest totals where they are not."""
    rng = np.random.default_rng(2)
    p, t = rng.dirichlet([0.4, 0.4, 0.4], 200), rng.integers(1, 50, 200)
    table = spark.createDataFrame([(list(map(float, a)), int(n)) for a, n in zip(p, t)], "posterior array<double>, n_tokens long")
    wanted = np.array([0.2, 0.7, 0.1]) * t.sum()
    steps, gap = mixing.fit_rates(table, dict(zip(mixing.DOMAINS, wanted)))
    rate = mixing.rate_of(p, steps)
    assert (rate >= 0).all() and (rate * t) @ p == pytest.approx(wanted, rel=1e-3) and gap <= mixing.TOLERANCE
    one = spark.createDataFrame([([1.0, 0.0, 0.0], 10), ([0.5, 0.5, 0.0], 10)], "posterior array<double>, n_tokens long")
    steps, gap = mixing.fit_rates(one, {"good": 1.0})
    q = np.array([[1.0, 0, 0], [0.5, 0.5, 0]])
    rate = mixing.rate_of(q, steps)
    grid = np.array([(a, b) for a in np.linspace(0, 3, 61) for b in np.linspace(0, 5, 101)])
    off = lambda r: ((r * 10 @ q - [0, 20, 0]) ** 2).sum(axis=-1)
    assert (rate >= 0).all() and off(rate[None])[0] <= off(grid).min() + 4
    assert gap == pytest.approx(np.abs(rate * 10 @ q - [0, 20, 0]).sum() / 20, rel=1e-6) and gap > 0.1
