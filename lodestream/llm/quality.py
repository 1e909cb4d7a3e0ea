"""Quality classifier: regularised quadratic discriminant analysis on document statistics.

Class means and covariances come from sums over at most SAMPLE labelled training rows, and
what reaches the driver is two small matrices. Covariances are shrunk to the pooled diagonal.
Scores are differences of log densities; each class keeps its Cholesky factor.

Defined results: a null text is empty and gets a score like any other; labels that are null
are no labels; a document labelled twice alike counts once, labelled both ways it counts in
both classes; repeated rows are scored one by one. Without training rows of both classes
every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import crc_bucket, ship, texts_of, with_kernel
from lodestream.llm.stats import features

SHRINKAGE = 0.1
THRESHOLD = 0.3
#: Labelled rows that the classifier is fitted on at most: those with the smallest hashes of their ids.
SAMPLE = 50_000


class Discriminant:
    """Gaussian class densities from their sums: classes maps a class to (n, sum of x, sum of x x')."""

    def __init__(self, classes: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE):
        self.classes, self.parts = sorted(classes), []
        total = sum(n for n, _, _ in classes.values())
        d = len(next(iter(classes.values()))[1]) if classes else 0
        means = {c: s / n for c, (n, s, _) in classes.items()}
        scatter = {c: q - np.outer(s, s) / n for c, (n, s, q) in classes.items()}
        pooled = np.diag(np.diag(sum(scatter.values(), np.zeros((d, d)))) / max(total, 1)) + 1e-4 * np.eye(d)
        for c in self.classes:
            n = classes[c][0]
            weight = shrinkage + (1 - shrinkage) * d / (d + n)
            cov = (1 - weight) * scatter[c] / n + weight * pooled
            factor = np.linalg.cholesky(cov)
            self.parts.append((means[c], np.linalg.inv(factor), -np.log(np.diag(factor)).sum() + np.log(n / total)))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Rows x classes: log prior times density, without the common constant."""
        return np.column_stack([k - 0.5 * (((x - m) @ inverse.T) ** 2).sum(axis=1) for m, inverse, k in self.parts])

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = self.log_density(x)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(labelled: DataFrame, label: str, text_column: str = "text", kernel=features, shrinkage: float = SHRINKAGE) -> Discriminant:
    """From all given rows (an integer label, a text). Only sums by class come to the driver."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            y = np.asarray(batch.column("label_").to_pylist(), dtype=np.int64)
            for first, texts in texts_of(batch.column("text_")):
                x = kernel(texts)
                one = np.column_stack([np.ones(len(x)), x])
                for c in np.unique(y[first : first + texts.n]):
                    own = one[y[first : first + texts.n] == c]
                    total[int(c)] = total.get(int(c), 0) + own.T @ own
        rows = [(c, i, float(v)) for c, q in total.items() for i, v in enumerate(q.ravel())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["c", "i", "v"])

    ship(labelled.sparkSession)
    rows = labelled.select(F.col(label).cast("long").alias("label_"), F.col(text_column).alias("text_")).where("label_ is not null")
    parts = rows.mapInArrow(sums, "c long, i long, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for c in {r.c for r in parts}:
        flat = np.array([v for _, v in sorted((r.i, r.v) for r in parts if r.c == c)])
        q = flat.reshape(int(len(flat) ** 0.5), -1)
        out[c] = (q[0, 0], q[0, 1:], q[1:, 1:])
    return Discriminant(out, shrinkage)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Discriminant:
    """Learns from at most sample labelled rows that are not held out; being so few, they are broadcast and no text is shuffled."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id")) != 0)).select(F.col("doc_id").alias("id_"), F.col(label).alias("y_")).distinct()
    own = F.broadcast(own.orderBy(F.xxhash64("id_"), "id_", "y_").limit(sample))
    return fit(documents.select("doc_id", "text").join(own, F.col("doc_id") == F.col("id_")), "y_")


def scoring_kernel(model: Discriminant, threshold: float = THRESHOLD, score_name: str = "score", verdict_name: str = "predicted"):
    def kernel(texts):
        if model.classes == [0, 1]:
            z = model.log_density(features(texts))
            s = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -600, 600)))
        else:
            s = np.full(texts.n, 0.5)
        return {score_name: s, verdict_name: (s >= threshold).astype(np.int32)}

    return kernel


def score(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents."""
    model = train(documents, labels)
    out = with_kernel(documents.select("doc_id", "text"), "text", scoring_kernel(model, threshold), "score double, predicted int", keep=["doc_id"])
    return out.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents without those that the classifier rejects; columns as they were."""
    model = train(documents, labels)
    kernel = scoring_kernel(model, threshold, "lodestream_score_", "lodestream_verdict_")
    out = with_kernel(documents, "text", kernel, "lodestream_score_ double, lodestream_verdict_ int")
    return out.where("lodestream_verdict_ = 1").select(*documents.columns)

