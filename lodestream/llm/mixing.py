"""Mixing to target weights with soft membership.

A classifier learned from the labelled table gives each document its posteriors over three
domains: low quality, good, toxic. Rates r >= 0 of documents are then fitted so that the
expected tokens of each domain, sum(rate * tokens * posterior), match the targets, by
projected-gradient least squares that starts from rate 1. A step is taken in the metric of
tokens and scaled by the 3 x 3 matrix of domain overlaps, so a document's rate follows from
its posteriors and the steps so far: the state of the fit is the list of steps, and every
pass is a sum over the table of documents, which any executor can repeat.

Defined results: null and empty texts have no tokens, so they weigh nothing and their rate is
what their posteriors give; repeated rows weigh as often as they are; without labelled rows,
or of one domain only, posteriors are those of the domains there are. Targets are scaled to sum to 1.
Targets that no nonnegative rates reach, or that STEPS steps do not, leave a gap: the column gap
has what is missing or too much over all domains, as a share of the wanted tokens, in each row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm import tokens
from lodestream.llm.common import Texts, ship, texts_of, with_kernel, written
from lodestream.llm.quality import Discriminant, fit
from lodestream.llm.stats import features

DOMAINS = ["low", "good", "toxic"]
TARGETS = {"low": 0.02, "good": 0.96, "toxic": 0.02}
#: Tokens wanted, as a share of all there are.
BUDGET = 1.0
#: Labelled rows that the classifier is fitted on: those with the smallest hashes of their ids.
SAMPLE = 50_000
#: Words are counted in so many buckets, and shrunk by so many words of the overall mix.
BUCKET_BITS, PRIOR = 18, 20.0
STEPS, TOLERANCE = 60, 1e-4


def _word_buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Owner and bucket of each word, in order."""
    texts.word_owners()
    lower = texts.lowered()
    return lower.word_owners(), (lower.word_hashes() >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Owner and bucket of each distinct (text, bucket) pair of its words."""
    owner, bucket = _word_buckets(texts)
    own = np.sort((owner.astype(np.int64) << BUCKET_BITS) | bucket)
    own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
    return own >> BUCKET_BITS, own & ((1 << BUCKET_BITS) - 1)


def domain_features(texts: Texts, odds: np.ndarray) -> np.ndarray:
    """Document statistics, and the two largest log odds of toxicity of its words, of different buckets."""
    owner, bucket = _word_buckets(texts)
    value = odds[bucket].astype(np.float64)
    has = np.bincount(owner, minlength=texts.n) > 0
    top = np.zeros((texts.n, 2))
    if len(owner):
        at = np.searchsorted(owner, np.flatnonzero(has))
        top[has, 0] = np.maximum.reduceat(value, at)
        best = np.flatnonzero(value == top[owner, 0])
        first = np.zeros(texts.n, dtype=np.int64)
        first[owner[best[::-1]]] = bucket[best[::-1]]
        value[bucket == first[owner]] = 0.0  # odds below 0 count as 0
        top[has, 1] = np.maximum.reduceat(value, at)
    return np.column_stack([features(texts), np.maximum(top, 0)])


def labelled_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(domain, text) of at most sample labelled documents; their ids, of bounded number, are broadcast."""
    own = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("id_")).agg(F.max("toxic").alias("t_"), F.min("quality").alias("q_"))
    domain = F.when(F.col("t_") == 1, 2).when(F.col("q_") == 0, 0).otherwise(1)
    own = own.select("id_", domain.alias("domain_")).orderBy(F.xxhash64("id_"), "id_").limit(sample)
    return documents.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("id_")).select("domain_", "text")


def _word_odds(rows: DataFrame) -> np.ndarray:
    """Log odds of toxicity by bucket, from counts of documents with and without. Each task sends sums of fixed size."""

    def run(batches):
        count = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
        n = np.zeros(2, dtype=np.int64)
        for batch in batches:
            y = (np.asarray(batch.column("domain_").to_pylist()) == 2).astype(np.int64)
            for first, texts in texts_of(batch.column("text")):
                own = y[first : first + texts.n]
                owner, bucket = _buckets(texts)
                np.add.at(count, (own[owner], bucket), 1)
                n += np.bincount(own, minlength=2)
        seen = np.flatnonzero(count.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], seen])), pa.array(np.concatenate([[n[0]], count[0, seen]])), pa.array(np.concatenate([[n[1]], count[1, seen]]))], names=["bucket", "calm", "toxic"])

    got = rows.mapInArrow(run, "bucket long, calm long, toxic long").groupBy("bucket").agg(F.sum("calm").alias("calm"), F.sum("toxic").alias("toxic")).toPandas()
    odds = np.zeros(1 << BUCKET_BITS, dtype=np.float32)
    total = got[got["bucket"] == -1]
    calm, toxic = (float(total[c].sum()) for c in ("calm", "toxic"))
    if calm and toxic:
        own = got[got["bucket"] >= 0]
        a, b = PRIOR * toxic / (calm + toxic), PRIOR * calm / (calm + toxic)
        odds[own["bucket"]] = np.log((own["toxic"] + a) / (toxic + a)) - np.log((own["calm"] + b) / (calm + b))
    return odds


def posterior_kernel(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Kernel that gives posterior, an array of the domains' probabilities."""
    spark = documents.sparkSession
    ship(spark)
    rows = written(labelled_rows(documents, labels, sample))
    odds = spark.sparkContext.broadcast(_word_odds(rows))
    model: Discriminant = fit(rows, "domain_", kernel=lambda t: domain_features(t, odds.value))

    def kernel(texts: Texts) -> dict:
        p = np.zeros((texts.n, len(DOMAINS)))
        if model.classes:
            p[:, model.classes] = model.posterior(domain_features(texts, odds.value))
        else:
            p[:] = 1 / len(DOMAINS)
        return {"posterior": list(p)}

    return kernel


def rate_of(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    r = np.ones(len(p))
    for s in steps:
        r = np.maximum(0, r - p @ s)
    return r


def _totals(table: DataFrame, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens by domain at the present rates, and the overlaps of the documents that are not at zero."""
    k = len(DOMAINS)

    def run(batches):
        out = np.zeros(k + k * k)
        for batch in batches:
            if len(batch):
                p = np.vstack(batch.column("posterior").to_numpy(zero_copy_only=False))
                t = batch.column("n_tokens").to_numpy().astype(float)
                r = rate_of(p, steps)
                out[:k] += (t * r) @ p
                out[k:] += ((p * (t * (r > 0))[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out))), pa.array(out)], names=["i", "v"])

    rows = table.select("posterior", "n_tokens").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(k + k * k)
    for x in rows:
        out[x.i] = x.v
    return out[:k], out[k:].reshape(k, k)


def fit_rates(table: DataFrame, targets: dict[str, float], budget: float = BUDGET, most: int = STEPS, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], float]:
    """Steps of the projected gradient, until every domain is within tolerance of the wanted total, and the gap that they leave."""
    weight = np.array([max(targets.get(d, 0.0), 0.0) for d in DOMAINS])
    steps: list[np.ndarray] = []
    now, overlap = _totals(table, steps)
    wanted = weight / max(weight.sum(), 1e-12) * budget * now.sum()
    for _ in range(most):
        off = now - wanted
        if np.abs(off).sum() <= tolerance * max(wanted.sum(), 1.0):
            break
        steps.append(np.linalg.lstsq(overlap + 1e-9 * max(np.trace(overlap), 1e-9) * np.eye(len(off)), off, rcond=None)[0])
        now, overlap = _totals(table, steps)
    return steps, float(np.abs(now - wanted).sum() / max(wanted.sum(), 1.0))


def mix(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = BUDGET, vocabulary_path: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, source, n_tokens, p_low, p_good, p_toxic, rate, copies, gap for each row of documents.

    copies is the whole part of the rate and, with the probability of the rest, one more; the
    chance is a hash of the id, so it falls the same way each time.
    """
    belief = posterior_kernel(documents, labels, sample)
    counts = tokens.counting_kernel(documents.sparkSession, tokens.read_vocabulary(vocabulary_path or tokens.default_vocabulary_path()))
    both = lambda t: {"n_tokens": counts(t)["n_tokens"], "posterior": belief(t)["posterior"]}
    table = written(with_kernel(documents.select("doc_id", "source", "text"), "text", both, "n_tokens long, posterior array<double>", keep=["doc_id", "source"]))
    steps, gap = fit_rates(table, targets or TARGETS, budget)
    rate, p = F.lit(1.0), F.col("posterior")
    for s in steps:
        rate = F.greatest(F.lit(0.0), rate - sum(p[k] * float(x) for k, x in enumerate(s)))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    out = table.withColumn("rate", rate)
    return out.select("doc_id", "source", "n_tokens", *[p[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long").alias("copies"), F.lit(gap).alias("gap"))
