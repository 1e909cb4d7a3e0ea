"""Archives as a Spark data source: rows become files in ZIP shards, and a manifest tells what is there once all of them are.

Each task writes shards of its own in a folder of the job. On commit these get their final names and the manifest is written
last; the folder goes with what failed attempts have left, on abort too. So a folder with a manifest is whole, and one without has no shard.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lodestream.operators.storage import ship

FORMAT = "lodestream_archive"
#: Bytes of texts after which a task begins another shard.
SHARD_BYTES = 256 << 20
MANIFEST, UNFINISHED = "manifest.json", ".unfinished"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Shards(WriterCommitMessage):
    """What a task has written: temporary names with their number of files and bytes of texts."""

    shards: list[tuple[str, int, int]] = field(default_factory=list)


class ArchiveWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.limit, self.overwrite = options["path"].rstrip("/"), int(options.get("shard_bytes", SHARD_BYTES)), overwrite
        self.note, self.job = options.get("note", ""), f"{UNFINISHED}-{uuid.uuid4().hex}"
        files, root = _files(self.path)
        files.create_dir(f"{root}/{self.job}", recursive=True)  # by the driver: a task that is late finds no folder any more

    def write(self, iterator: Iterator) -> Shards:
        files, root = _files(f"{self.path}/{self.job}")
        out = Shards()
        name = stream = archive = None
        count = size = 0

        def close():
            nonlocal archive
            if archive is not None:
                archive.close()
                stream.close()
                out.shards.append((name, count, size))
                archive = None

        for row in iterator:
            if archive is not None and size >= self.limit:
                close()
            if archive is None:
                name, count, size = f"{uuid.uuid4().hex}.zip", 0, 0
                stream = files.open_output_stream(f"{root}/{name}")
                archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
            data = (row["content"] or "").encode()
            archive.writestr(row["name"], data)
            count, size = count + 1, size + len(data)
        close()
        return out

    def _clear_old(self) -> None:
        """Remove an old archive, its manifest first."""
        from pyarrow import fs

        files, root = _files(self.path)
        for f in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda f: f.base_name != MANIFEST):
            if f.base_name == MANIFEST or f.base_name.startswith("shard-"):
                files.delete_file(f.path)

    def commit(self, messages: list[Shards | None]) -> None:
        files, root = _files(self.path)
        if self.overwrite:
            self._clear_old()
        shards = [s for m in messages if m is not None for s in m.shards]
        listed = []
        for k, (name, count, size) in enumerate(shards):
            final = f"shard-{uuid.uuid4().hex[:8]}-{k:05d}.zip"
            files.move(f"{root}/{self.job}/{name}", f"{root}/{final}")
            listed.append({"file": final, "entries": count, "text_bytes": size})
        files.delete_dir(f"{root}/{self.job}")
        manifest = {"shards": listed, "entries": sum(s["entries"] for s in listed), "text_bytes": sum(s["text_bytes"] for s in listed), "note": self.note}
        with files.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(manifest, ensure_ascii=False, indent=2).encode())

    def abort(self, messages: list[Shards | None]) -> None:
        files, root = _files(self.path)
        files.delete_dir(f"{root}/{self.job}")


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), overwrite)


def export(entries: DataFrame, path: str, note: str = "", shard_bytes: int = SHARD_BYTES) -> dict:
    """Write entries (name, content), whose names differ, as shards below path; returns the manifest."""
    spark = entries.sparkSession
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    entries.select("name", "content").write.format(FORMAT).mode("overwrite").options(path=path, note=note, shard_bytes=shard_bytes).save()
    files, root = _files(path)
    with files.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of all shards below path."""
    import io

    def unpack(batches):
        for batch in batches:
            for data in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(data.as_buffer())) as z:
                    for info in z.infolist():
                        yield pa.RecordBatch.from_arrays([pa.array([info.filename]), pa.array([z.read(info).decode()])], names=["name", "content"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.zip").load(path).select("content").mapInArrow(unpack, "name string, content string")
