"""Vector search by exact cosine, in blocks: a bounded set of query vectors against every row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.ranking import top_k
from lodestream.operators.storage import ship

#: Bytes of query vectors that are sent to the executors at once; more queries go in further blocks.
BLOCK_BYTES = 64 << 20
#: Query vectors that are multiplied with a batch of rows at once.
QUERIES_AT_ONCE = 512


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 where one has no length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(norm == 0, 0.0).otherwise(dot / norm)


def matrix_of(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length, as doubles, from its buffer of values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of no length stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def search(queries: DataFrame, corpus: DataFrame, k: int, least: float | None = None, exclude_self: bool = False, group: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k rows of corpus (id, vector) nearest to each of queries (query_id, vector).

    group: a column of both; only rows of a query's group count.

    Each task keeps the best k of its rows for every query, so what is shuffled is tasks * queries * k
    rows whatever the size of the corpus. Rows without a vector are never found.
    """
    found = None
    ship(corpus.sparkSession)
    own_group = F.lit(0).cast("long") if group is None else F.xxhash64(group)
    wanted = queries.where("vector is not null").select("query_id", "vector", own_group.alias("group_")).orderBy("query_id")
    size = wanted.agg(F.sum(F.size("vector") * 8)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = part.toArrow()
        if not rows.num_rows:
            continue
        ids, matrix, groups = rows.column("query_id").to_pylist(), unit(matrix_of(rows.column("vector"))), rows.column("group_").to_pylist()

        def best(batches, ids=ids, matrix=matrix, groups=groups):
            kept = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(ids)
            for batch in batches:
                if not len(batch):
                    continue
                own, of = batch.column("id").to_numpy(), batch.column("group_").to_numpy()
                rows = unit(matrix_of(batch.column("vector"))).T
                for q in range(len(ids)):
                    if q % QUERIES_AT_ONCE == 0:
                        score = np.round(matrix[q : q + QUERIES_AT_ONCE] @ rows, 9)
                    s, i = score[q % QUERIES_AT_ONCE], own
                    mask = np.ones(len(s), dtype=bool) if least is None else s >= least
                    if exclude_self:
                        mask &= i != ids[q]
                    if group is not None:
                        mask &= of == groups[q]
                    s, i = np.concatenate([kept[q][0], s[mask]]), np.concatenate([kept[q][1], i[mask]])
                    order = np.lexsort((i, -s))[:k]
                    kept[q] = (s[order], i[order])
            n = [len(x[0]) for x in kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(ids, dtype=np.int64), n)), pa.array(np.concatenate([x[1] for x in kept]).astype(np.int64)), pa.array(np.concatenate([x[0] for x in kept]))],
                names=["query_id", "id", "score"],
            )

        out = corpus.where("vector is not null").select(F.col("id").cast("long").alias("id"), "vector", own_group.alias("group_")).mapInArrow(best, "query_id long, id long, score double")
        found = out if found is None else found.unionByName(out)
    if found is None:
        return corpus.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    return top_k(found, ["query_id"], "score", "id", k)
