"""Quality rules with an isolation forest on their statistics.

Base rules count; the forest then judges what passed them: documents that random splits
isolate after few steps are anomalous. It is grown from all good labelled rows, each of which
is in one tree or more: trees take PER_TREE rows each, or an even share of the rows where that
is more. Cuts fall up to REACH standard deviations of all labelled rows beyond what a node
holds, so that values never seen in good rows are cut off early. The threshold is the score
that at most MISS of all good labelled rows exceed.

Texts are read once: their statistics are written as a table, which the forest is grown from
and which is judged.

Defined results: a null text has no words and fails the base rules, as an empty one does;
repeated rows are judged one by one; without good labelled rows the base rules alone decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import Texts, discard, with_kernel, written
from lodestream.llm.stats import FEATURES, features, rule_counts

TREES, PER_TREE, DEPTH = 100, 256, 12
MISS = 0.002
REACH = 2.0
#: Statistics that rules look at: not how long a text is, nor its digits or number of lines.
USED = [k for k, name in enumerate(FEATURES) if name not in ("words", "digits", "lines")]


def _average_path(n):
    n = np.maximum(np.asarray(n, dtype=float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as flat arrays: feature (-1 at leaves), cut, left child (right is left + 1), path length at leaves."""

    def __init__(self, x: np.ndarray, scale: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, depth: int = DEPTH, reach: float = REACH, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = min(per_tree, len(x))
        self.norm = float(_average_path(size)) or 1.0
        self.trees = [self._grow(x[rng.choice(len(x), size, replace=False)], rng, depth, reach * np.maximum(scale, 1e-3)) for _ in range(trees)]

    @classmethod
    def of(cls, trees: list[tuple], size: float) -> IsolationForest:
        """A forest of grown trees that had so many rows each."""
        forest = cls.__new__(cls)
        forest.trees, forest.norm = trees, float(_average_path(size)) or 1.0
        return forest

    @staticmethod
    def _grow(x, rng, limit, margin):
        feature, cut, left, path, queue = [-1], [0.0], [0], [0.0], [(0, x, 0)]
        while queue:
            at, own, depth = queue.pop()
            if depth >= limit or len(own) <= 1:
                path[at] = depth + float(_average_path(len(own)))
                continue
            f = int(rng.integers(x.shape[1]))
            c = float(rng.uniform(own[:, f].min() - margin[f], own[:, f].max() + margin[f]))
            feature[at], cut[at], left[at] = f, c, len(feature)
            for part in (own[own[:, f] < c], own[own[:, f] >= c]):
                if len(part):
                    queue.append((len(feature), part, depth + 1))
                for column, value in ((feature, -1), (cut, 0.0), (left, 0), (path, float(depth + 1))):
                    column.append(value)
        return np.array(feature), np.array(cut), np.array(left), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / that of an average tree): near 1 is anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, left[at] + (x[rows, np.maximum(f, 0)] >= cut[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and x, the statistics that the forest looks at, for each row."""

    def kernel(texts: Texts) -> dict:
        c = rule_counts(texts)
        return c | {"base_failed": base_failed(c), "x": list(features(texts, c)[:, USED])}

    return with_kernel(
        documents.select("doc_id", "text"), "text", kernel,
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, x array<double>", keep=["doc_id"],
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(USED))


def dealt(good: DataFrame, n: int, trees: int = TREES, per_tree: int = PER_TREE) -> tuple[DataFrame, float]:
    """(x, tree) of n rows, and the rows of a tree: each goes to one tree of each of some blocks of trees, as many blocks as fill every tree with per_tree rows, one at least."""
    blocks = int(min(trees, max(1, -(-trees * per_tree // n))))
    edges = [k * trees // blocks for k in range(blocks + 1)]
    own = F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(a)), F.lit(b - a)) + a for a, b in zip(edges, edges[1:])])
    return good.select("x", F.explode(own).alias("tree")), n * blocks / trees


def _grown(good: DataFrame, n: int, scale: np.ndarray, depth: int = DEPTH, reach: float = REACH, seed: int = 7) -> IsolationForest:
    """Each tree in a group of its own, which has PER_TREE rows or one in TREES of all."""
    rows, size = dealt(good, n)

    def grow(table: pa.Table) -> pa.Table:
        tree, x = int(table.column("tree")[0].as_py()), _matrix(table.column("x").combine_chunks())
        x = x[np.lexsort(x.T)]  # whatever order the shuffle gave
        parts = IsolationForest._grow(x, np.random.default_rng([seed, tree]), depth, reach * np.maximum(scale, 1e-3))
        return pa.table([pa.array([tree], pa.int64()), *(pa.array([p.tolist()], pa.list_(t)) for p, t in zip(parts, (pa.int64(), pa.float64(), pa.int64(), pa.float64())))], names=["tree", "feature", "cut", "left", "path"])

    got = rows.groupBy("tree").applyInArrow(grow, "tree long, feature array<long>, cut array<double>, left array<long>, path array<double>").collect()
    return IsolationForest.of([tuple(np.array(c) for c in (r.feature, r.cut, r.left, r.path)) for r in sorted(got, key=lambda r: r.tree)], size)


def train(table: DataFrame, labels: DataFrame, miss: float = MISS) -> tuple[IsolationForest | None, float]:
    """Forest and threshold, from all labelled rows of the statistics (and as many repeats of them)."""
    own = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id_")).agg(F.min("quality").alias("lodestream_label_"))
    got = written(table.select("doc_id", "x", "base_failed").join(own, F.col("doc_id") == F.col("id_")).select("doc_id", "x", (~F.col("base_failed") & (F.col("lodestream_label_") == 1)).alias("good")))
    sums = got.agg(F.count_if("good").alias("n"), *[F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(len(USED))]).first()
    if not sums.n:
        discard(got)
        return None, 1.0
    good = got.where("good")
    forest = _grown(good, sums.n, np.array(sums[1:]))
    shared = table.sparkSession.sparkContext.broadcast(forest)

    def scores(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.score(_matrix(batch.column("x"))))], names=["s"])

    # The quantile stands between two scores near the top; the rows above it are a share of miss.
    place = (sums.n - 1) * (1 - miss)
    low, high = int(np.floor(place)), int(np.ceil(place))
    top = [r.s for r in good.select("x").mapInArrow(scores, "s double").orderBy(F.desc("s")).offset(sums.n - 1 - high).limit(high - low + 1).collect()]
    discard(got)
    return forest, float(top[-1] + (top[0] - top[-1]) * (place - low))


def judge(documents: DataFrame, labels: DataFrame, miss: float = MISS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly for each row."""
    table = written(statistics(documents))
    forest, threshold = train(table, labels, miss)
    shared = documents.sparkSession.sparkContext.broadcast(forest)
    names = [c for c in table.columns if c != "x"]

    def run(batches):
        for batch in batches:
            s = shared.value.score(_matrix(batch.column("x"))) if shared.value else np.zeros(len(batch))
            kept = ~batch.column("base_failed").to_numpy(zero_copy_only=False) & (s <= threshold)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(kept.astype(bool)), pa.array(s)], names=[*names, "kept", "anomaly"])

    fields = table.schema[:-1].add("kept", "boolean").add("anomaly", "double")
    return table.mapInArrow(run, fields)
