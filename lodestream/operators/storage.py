"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or for tests a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that all of them share")
        found = f"file:///tmp/lodestream-shared-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def plain_unions(spark: SparkSession) -> None:
    """Let no plan rely on how a union is dealt out.

    Spark 4.1 takes a union of children that are dealt out alike for dealt out so itself; where
    adaptive execution then coalesces the children apart, an aggregate above has a group twice.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join by sorting that is never broadcast.

    Spark guesses a table's size from its compressed columns and takes exploded rows for as large as what they come from,
    so by its own threshold it collects tables of hundreds of MB in the driver, several at once.
    """
    return df.hint("merge")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    plain_unions(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/lodestream-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestream_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made and that no later plan reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._lodestream_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once for each application, by Spark's own file server."""
    plain_unions(spark)
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
