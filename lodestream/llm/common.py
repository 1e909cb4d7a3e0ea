"""What the corpus operators share: session helpers and byte kernels over Arrow text columns.

The kernels work on the UTF-8 bytes of a whole Arrow batch at once. White space is
``[\\x20\\x09-\\x0D]``, all single bytes in UTF-8, so words can be cut on bytes.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.storage import plain_unions

#: Text bytes that one pass of a kernel takes; a longer text goes alone. Bounds memory, not results.
CHUNK_BYTES = 1 << 20
#: Bytes of a batch that is handed to a Python worker: both sides hold a few of these a task.
BATCH_BYTES = 16 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or for tests one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that all of them share")
        found = f"file:///tmp/lodestream-shared-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    plain_unions(spark)
    path = f"{shared_dir(spark)}/lodestream-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestream_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made and that no later plan reads."""
    for t in tables:
        spark, path = t.sparkSession, t._lodestream_path
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once for each application, by Spark's own file server; bound the batches of its workers."""
    plain_unions(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()  # of the driver; its file server hands the archive out while the application runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def crc_bucket(doc_id, buckets: int = 5):
    """crc32 of the id's decimal text, modulo buckets."""
    return F.crc32(doc_id.cast("string")) % buckets


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64, wrapping."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[:n]


class Texts:
    """The bytes of some texts end to end; text k is data[offsets[k]:offsets[k + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._words = self._hashes = self._owners = None

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def lowered(self) -> Texts:
        out = Texts(_LOWER[self.data], self.offsets)
        out._words, out._owners = self._words, self._owners  # letters stay letters
        return out

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of member bytes within one text."""
        if not len(member):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = np.empty_like(member)
        before[0] = False
        before[1:] = member[:-1]
        after = np.empty_like(member)
        after[-1] = False
        after[:-1] = member[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(member))]
        before[inner] = False
        after[inner - 1] = False
        return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        if self._words is None:
            self._words = self.runs(~_SPACE[self.data])
        return self._words

    def word_owners(self) -> np.ndarray:
        """The text of each word."""
        if self._owners is None:
            self._owners = np.repeat(np.arange(self.n), np.diff(np.searchsorted(self.words()[0], self.offsets)))
        return self._owners

    def word_hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = self.span_hashes(*self.words())
        return self._hashes

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
        n = len(self.data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=total[1:])
        h = (total[ends] - total[starts]) * _power(_BASE_INV, n + 1)[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def texts_of(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    """(first row, Texts) of successive slices of about CHUNK_BYTES; a null text is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, Texts(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


_STEP = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(texts: Texts, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word windows, their texts, and the words of each text.

    A text of fewer words than width, but at least one, gives one hash of its whole sequence.
    """
    h = texts.word_hashes()
    doc = texts.word_owners()
    counts = np.bincount(doc, minlength=texts.n) if len(doc) else np.zeros(texts.n, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    n = len(h) - width + 1
    if n > 0:
        full = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            full = (full ^ h[k : k + n]) * _STEP[k % 5]
            full ^= full >> np.uint64(29)
        inside = doc[:n] == doc[width - 1 :]
        full, owner = mix(full[inside]), doc[:n][inside]
    else:
        full, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for j, d in enumerate(short):
            acc = int(counts[d])
            for x in h[first[d] : first[d + 1]]:
                acc = ((acc ^ int(x)) * 0xFF51AFD7ED558CCD + 1) & (2**64 - 1)
            whole[j] = acc
        full, owner = np.concatenate([full, mix(whole)]), np.concatenate([owner, short])
    return full, owner, counts


def with_kernel(df: DataFrame, text_column: str, kernel, fields: str, keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep, without the text) and what kernel(Texts) gives: arrays by name, one value a text."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    ship(df.sparkSession)
    passed = df.columns if keep is None else keep
    added = _parse_datatype_string(fields)
    schema = StructType([df.schema[c] for c in passed] + list(added.fields))
    names = [f.name for f in added.fields]

    def run(batches):
        for batch in batches:
            parts = [kernel(t) for _, t in texts_of(batch.column(text_column))]
            if parts:
                new = [np.concatenate([p[n] for p in parts]) if isinstance(parts[0][n], np.ndarray) else pa.array([x for p in parts for x in p[n]]) for n in names]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in passed] + [pa.array(x) for x in new], names=[*passed, *names])

    return df.select(*dict.fromkeys([*passed, text_column])).mapInArrow(run, schema)
