"""Connectors as a Spark data source: raw objects by page, in batches and as a stream that goes on from an opaque cursor.

``spark.read.format("lodestream_connector")`` with the options connector, path (or whatever the client needs),
cursor (where the last sync stopped) and until gives rows (connector, updated_at, page, value); a filter
``updated_at > t`` is pushed into the reader, so objects that are not newer never leave it (Spark 4.1 keeps a pushed filter with
the loaded frame: load anew for another). As a stream the cursor is the offset, so
Spark's checkpoint keeps it. ``connectors.read`` makes documents of the rows.

A client stands for the API of a service: it lists pages between two cursors and gives a page's objects. The one
here has folders of JSON lines as pages; another is named by the option client, as module:Class.
"""

from __future__ import annotations

import base64
import importlib
import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, GreaterThan, InputPartition

from lodestream.operators.storage import ship
from lodestream.sources import connectors

FORMAT = "lodestream_connector"
SCHEMA = "connector string, updated_at timestamp, page string, value string"
#: Where the objects of a connector have their time of change.
UPDATED = {
    "jira": [["fields", "updated"]], "confluence": [["version", "when"]], "notion": [["last_edited_time"]], "github": [["updated_at"], ["published_at"]], "gdrive": [["modifiedTime"]],
}


class FolderClient:
    """Pages are files of JSON lines below a folder, in the order of their names; the cursor is the last one's name, encoded."""

    def __init__(self, options: dict[str, str]):
        from pyarrow import fs

        path = options["path"].rstrip("/")
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def _names(self) -> list[str]:
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        names = (f.path.removeprefix(self.root).lstrip("/") for f in found if f.is_file)
        return sorted(n for n in names if not any(part.startswith((".", "_")) for part in n.split("/")))

    @staticmethod
    def _decode(cursor: str | None) -> str:
        return base64.urlsafe_b64decode(cursor).decode() if cursor else ""

    def head(self) -> str:
        """The cursor after all pages that there are."""
        names = self._names()
        return base64.urlsafe_b64encode(names[-1].encode()).decode() if names else ""

    def pages(self, cursor: str | None, until: str | None) -> list[str]:
        low, high = self._decode(cursor), self._decode(until)
        return [n for n in self._names() if n > low and (until is None or n <= high)]

    def objects(self, page: str) -> Iterator[str]:
        with self.files.open_input_stream(f"{self.root}/{page}") as stream:
            rest = b""
            while block := stream.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from (x.decode(errors="replace") for x in lines if x.strip())
            if rest.strip():
                yield rest.decode(errors="replace")


def client_of(options: dict[str, str]):
    module, name = options.get("client", f"{__name__}:FolderClient").split(":")
    return getattr(importlib.import_module(module), name)(options)


def updated_at(connector: str, value: str) -> datetime | None:
    """When an object was last changed, in UTC; None where it does not say so."""
    try:
        top = json.loads(value)
    except ValueError:
        return None
    for path in UPDATED[connector]:
        at = top
        for key in path:
            at = at.get(key) if isinstance(at, dict) else None
        if isinstance(at, str):
            try:
                found = datetime.fromisoformat(at)
            except ValueError:
                continue
            return found.replace(tzinfo=timezone.utc) if found.tzinfo is None else found.astimezone(timezone.utc)
    return None


class Page(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reads:
    """What batch and stream have in common."""

    def __init__(self, options: dict[str, str]):
        self.options, self.connector, self.since = dict(options), options["connector"], None

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # there are no pages
            return
        for value in client_of(self.options).objects(partition.name):
            at = updated_at(self.connector, value)
            if self.since is None or (at is not None and at > self.since):
                yield self.connector, at, partition.name, value


class BatchReader(_Reads, DataSourceReader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, GreaterThan) and tuple(f.attribute) == ("updated_at",):
                value = f.value.replace(tzinfo=timezone.utc) if f.value.tzinfo is None else f.value.astimezone(timezone.utc)
                self.since = value if self.since is None else max(self.since, value)
            else:
                yield f

    def partitions(self) -> list[Page]:
        return [Page(n) for n in client_of(self.options).pages(self.options.get("cursor"), self.options.get("until"))]


class StreamReader(_Reads, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"cursor": self.options.get("cursor", "")}

    def latestOffset(self) -> dict:
        return {"cursor": client_of(self.options).head()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(n) for n in client_of(self.options).pages(start["cursor"], end["cursor"])]

    def commit(self, end: dict) -> None:
        pass


class ConnectorSource(DataSource):
    def __init__(self, options):
        super().__init__(options)
        if options.get("connector") not in UPDATED:
            raise ValueError(f"no connector is called {options.get('connector')}; there are {', '.join(sorted(UPDATED))}")

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ConnectorSource)


def sync(spark: SparkSession, connector: str, options: dict[str, str], cursor: str | None = None, since: str | None = None) -> tuple[DataFrame, str]:
    """(documents after cursor, strictly newer than since if it is given; the next cursor, to be kept once they are stored)."""
    register(spark)
    head = client_of(options).head()
    own = {**options, "connector": connector, "until": head, **({"cursor": cursor} if cursor else {})}
    raw = spark.read.format(FORMAT).options(**own).load()
    if since is not None:
        raw = raw.where(F.col("updated_at") > F.lit(since).cast("timestamp"))
    return connectors.read(connector, raw.select("value")), head


def follow(spark: SparkSession, connector: str, options: dict[str, str], out: str, checkpoint: str):
    """A stream of a connector's documents into a table, a folder a batch; it goes on from the cursor in its checkpoint."""
    register(spark)

    def put(batch: DataFrame, n: int) -> None:
        connectors.read(connector, batch.select("value")).write.mode("overwrite").parquet(f"{out}/batch={n}")

    raw = spark.readStream.format(FORMAT).options(**options, connector=connector).load()
    return raw.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
