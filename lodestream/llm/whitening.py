"""Embedding whitening: principal components of all vectors by a randomised range finder, and each vector along them.

Entries c of a vector become whole numbers x = floor(1024 c) + 100000, so counts, sums S and the
deviation of a row are exact. A pass over all rows gives V Q for a block of columns Q, V being
the covariance of x (centred first, divisor n): every task sums x' (x Q) of its rows, and Spark adds up
the tasks' sums. The range finder begins with random columns, OVERSAMPLING more than there are
components, and takes PASSES power passes at most, with orthogonal columns after each. Each pass's product also
gives the Rayleigh-Ritz values and vectors and their residuals. Where a residual is not below
TOLERANCE times the gap to the next value, which bounds the error of a component, nor down at what rounding leaves of the largest value, the columns
are completed to full dimension and the products of the new ones added; then the components are exact.

The driver holds a matrix of dimension x dimension at most, and a task one of BLOCK_CELLS entries: wider products are
made in several passes.

Defined results: rows whose vector is null, empty, or has an entry that is null, not finite or 2**31 or more in size (x
would leave no room for exact sums) are left out, as are those that have not the dimension of most
rows (of equally many, the smaller one). Repeated rows count as often as they stand there and have a result each; a null
vec_id is passed on. Directions without variance (an eigenvalue of up to 1e-12 of the largest) are no components, so there may be
fewer than COMPONENTS, and none for a single vector or an empty table. Components of equal eigenvalues are
any orthogonal ones. deviation is null where it fits in no long; deviation_exact has it then.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import ship

COMPONENTS, OVERSAMPLING, PASSES, SEED = 8, 8, 6, 12
#: Largest residual of a component, as a share of its gap, or as a share of the largest value, where it is rounding.
TOLERANCE, ROUNDING = 1e-12, 16 * np.finfo(float).eps
#: Entries of a task's product in one pass.
BLOCK_CELLS = 4 << 20
#: Eigenvalues of up to this share of the largest are rounding.
NO_VARIANCE = 1e-12
#: Rows that a kernel takes at once.
ROWS_AT_ONCE = 4096
# How entries become whole numbers, and how large an entry may be.
SCALE, SHIFT, ENTRY_LIMIT = 1024, 100_000, 2**31


@dataclass
class Moments:
    """Of the fit list: rows, dimension, and the sum of each dimension as Python integers."""

    n: int
    dim: int
    sums: list[int]

    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], dtype=np.int64)


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, entries) of the rows that take part, and their dimension (0 without rows)."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < ENTRY_LIMIT))
    rows = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fine, F.lit(False)))
    most = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = most.dim if most else 0
    return rows.where(F.size("embedding") == dim).select("vec_id", F.col("embedding").cast("array<double>").alias("entries")), dim


def _whole_numbers(column: pa.Array, dim: int):
    """Matrices of x of successive rows of a list column without nulls."""
    for at in range(0, len(column), ROWS_AT_ONCE):
        part = column.slice(at, ROWS_AT_ONCE)
        c = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)
        yield np.floor(SCALE * c).astype(np.int64) + SHIFT


def _sums(rows: DataFrame, kernel, cells: int) -> np.ndarray:
    """Sums over all rows of kernel(x), which gives so many doubles a matrix of rows: added up in the task, then by Spark."""

    def run(batches):
        total = None
        for batch in batches:
            for x in kernel_input(batch):
                got = kernel(x)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], names=["cell", "value"])

    dim = rows._lodestream_dim

    def kernel_input(batch):
        return _whole_numbers(batch.column(0), dim)

    out = np.zeros(cells)
    added = rows.select("entries").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    table = added.toArrow()
    out[table.column("cell").to_numpy()] = table.column("value").to_numpy()
    return out


def moments(rows: DataFrame, dim: int) -> Moments:
    """Exact counts and sums: whole numbers a batch, decimals between batches."""

    def run(batches):
        for batch in batches:
            for x in _whole_numbers(batch.column(0), dim):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array(np.append(x.sum(axis=0), len(x)))], names=["cell", "value"])

    added = rows.select("entries").mapInArrow(run, "cell int, value long").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    got = {r.cell: int(r.value) for r in added.collect()}
    return Moments(got[dim], dim, [got[k] for k in range(dim)])


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """x - S/n: the whole part of the mean goes off exactly."""
    return (x - whole) - rest / n


class Covariance:
    """Products of the covariance with columns, each a pass over all rows."""

    def __init__(self, rows: DataFrame, m: Moments):
        self.rows, self.m, self.trace = rows, m, None

    def times(self, q: np.ndarray) -> np.ndarray:
        m, whole, rest = self.m, self.m.whole(), self.m.rest()
        wide = max(1, BLOCK_CELLS // m.dim)
        out = []
        for at in range(0, q.shape[1], wide):
            block = np.ascontiguousarray(q[:, at : at + wide])

            def kernel(x, block=block, n=m.n):
                own = _centred(x, whole, rest, n)
                return np.append((own.T @ (own @ block)).ravel(), np.square(own).sum())

            got = _sums(self.rows, kernel, block.size + 1) / m.n
            self.trace = float(got[-1])
            out.append(got[:-1].reshape(block.shape))
        return np.hstack(out)


def _ritz(q: np.ndarray, g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The k largest Ritz values in span(q), their vectors, and whether residuals are small against gaps; g is V q."""
    t = q.T @ g
    value, u = np.linalg.eigh((t + t.T) / 2)
    value, u = value[::-1], u[:, ::-1]
    k = min(k, len(value))
    vector = q @ u[:, :k]
    residual = np.linalg.norm(g @ u[:, :k] - vector * value[:k], axis=0)
    apart = np.append(np.inf, -np.diff(value))
    gap = np.minimum(apart[:k], np.append(apart[1:], np.inf)[:k])
    return value[:k], vector, bool(len(value) > k and (residual <= np.maximum(TOLERANCE * gap, ROUNDING * value[0])).all())


def _completed(q: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that complete those of q to full dimension."""
    d, l = q.shape
    more = rng.standard_normal((d, d - l))
    for _ in range(2):
        more -= q @ (q.T @ more)
        more = np.linalg.qr(more)[0]
    return more


def components(cov: Covariance, k: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the covariance, k at most."""
    d = cov.m.dim
    rng = np.random.default_rng(SEED)
    q = np.linalg.qr(rng.standard_normal((d, min(d, k + oversampling))))[0]
    g = cov.times(q)
    value, vector, good = _ritz(q, g, k)
    for _ in range(passes if q.shape[1] < d else 0):
        if good:
            break
        q = np.linalg.qr(g)[0]
        g = cov.times(q)
        value, vector, good = _ritz(q, g, k)
    if not good and q.shape[1] < d:
        more = _completed(q, rng)
        q, g = np.hstack([q, more]), np.hstack([g, cov.times(more)])
        value, vector, _ = _ritz(q, g, k)
    real = value > NO_VARIANCE * max(value[0], 0.0) if len(value) else np.zeros(0, bool)
    real &= value > 0
    return value[real], vector[:, real]


def _deviations(u: np.ndarray, rest: np.ndarray, n: int) -> list[int]:
    """Sum over dimensions of (n u - r)**2 for each row of u = x - floor(S/n), exactly."""
    high = int(np.abs(u).max(initial=0)) * n + n
    if u.shape[1] * high * high < 2**63:
        return np.square(n * u - rest).sum(axis=1).tolist()
    top = int(np.abs(u).max(initial=0))
    if u.shape[1] * top * max(top, n) < 2**63:
        r2 = sum(int(r) ** 2 for r in rest)
        return [n * n * int(a) - 2 * n * int(b) + r2 for a, b in zip(np.square(u).sum(axis=1), u @ rest)]
    return [sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, rest)) for row in u]


def whiten(embeddings: DataFrame, k: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue, deviation_exact for each row and component."""
    spark = embeddings.sparkSession
    ship(spark)
    id_type = dict(embeddings.dtypes)["vec_id"]
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double, deviation_exact decimal(38,0)"
    rows, dim = usable(embeddings)
    if not dim:
        return spark.createDataFrame([], schema)
    rows._lodestream_dim = dim
    m = moments(rows, dim)
    cov = Covariance(rows, m)
    value, vector = components(cov, k, oversampling, passes)
    c, n, whole, rest = len(value), m.n, m.whole(), m.rest()
    if not c:
        return spark.createDataFrame([], schema)
    axes = vector / np.sqrt(value)

    def second(x):
        w = _centred(x, whole, rest, n) @ axes
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    got = _sums(rows, second, c + c * c) / n
    error = float(np.abs(got[c:].reshape(c, c) - np.outer(got[:c], got[:c]) - np.eye(c)).max())
    explained, numbers = value / cov.trace, np.arange(1, c + 1, dtype=np.int32)
    long_max, most = 2**63 - 1, 10**38 - 1
    fields = [f.split() for f in schema.replace("decimal(38,0)", "decimal").split(", ")]

    def project(batches):
        for batch in batches:
            at = 0
            for x in _whole_numbers(batch.column(1), dim):
                ids = batch.column(0).slice(at, len(x))
                at += len(x)
                w = _centred(x, whole, rest, n) @ axes
                off = _deviations(x - whole, rest, n)
                each = pa.array(np.repeat(np.arange(len(x)), c))
                short = pa.array([v if v <= long_max else None for v in off], pa.int64()).take(each)
                exact = pa.array([v if v <= most else None for v in off], pa.decimal128(38, 0)).take(each)
                tile = lambda v: pa.array(np.tile(v, len(x)))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(each), tile(numbers), tile(np.array([n], dtype=np.int64).repeat(c)), short, pa.array(w.ravel()), tile(explained), tile(np.full(c, error)), tile(value), exact],
                    names=[f[0] for f in fields],
                )

    return rows.mapInArrow(project, schema)
