"""A session cache as streaming state: entries with a time to live, extended by touches, dropped by timers.

The log of a cache has rows (session, op, record, at, ttl_seconds) with op one of

- cache: the record is written and lives ttl_seconds from then on, and so does the session's index;
- extend: every record that is still alive, if the index is, lives ttl_seconds from then on, and so does the index;
- delete: the record is dropped; invalidate: the session is.

Rows take effect in the order of their times, whatever the order and the batches in which they come: they wait
in state until the watermark has passed them, and a timer wakes their session then. Of rows of one time extensions
come first, then writes, then drops, of equal ones the shorter lived first. So a replay, a restart in mid-log and another cut of the log into batches give
the same rows. Rows later than the watermark allows are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestream.operators.storage import ship

LOG_SCHEMA = "session long, op string, record string, at timestamp, ttl_seconds long"
OUT_SCHEMA = "session long, record string, cached_at timestamp, expires timestamp, live boolean"
_CHANGES = "session long, record string, cached_at long, expires long, live boolean"
#: Transformations with state need this store.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
# Seconds that an entry lives if nothing else is said, and the order of rows of one time.
DEFAULT_TTL = 14_400
_ORDER = {"extend": 0, "cache": 1, "delete": 2, "invalidate": 3}


class SessionCache(StatefulProcessor):
    """Of one session: rows that wait for the watermark, records with their times, and when the index ends. Times are microseconds.

    Each call to a state store is a round trip of its own, so all of this is one value, read and written once for all rows
    of a batch and once for a timer; rows that come do not look at what has been cached.
    """

    def __init__(self, default_ttl: int = DEFAULT_TTL):
        self.default_ttl = default_ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", "at array<long>, op array<string>, name array<string>, ttl array<long>, record array<string>, cached_at array<long>, expires array<long>, index long")

    def _read(self) -> tuple[list, dict[str, tuple[int, int]], int]:
        found = self.own.get()
        if found is None:
            return [], {}, 0
        at, op, name, ttl, record, cached, expires, index = found
        return list(zip(at, op, name, ttl)), dict(zip(record, zip(cached, expires))), index

    def _write(self, waiting: list, entries: dict[str, tuple[int, int]], index: int) -> None:
        if not waiting and not entries:
            self.own.clear()
            return
        turn = lambda rows, n: [list(c) for c in zip(*rows)] or [[] for _ in range(n)]
        self.own.update((*turn(waiting, 4), list(entries), *turn(entries.values(), 2), index))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        new = [(r["micros"], r["op"], r["record"] or "", (self.default_ttl if r["ttl_seconds"] is None else r["ttl_seconds"]) * 1_000_000) for r in rows]
        if new:
            waiting, entries, index = self._read()
            self._write(waiting + new, entries, index)
            self._wake([r[0] for r in new], timerValues.getCurrentWatermarkInMs(), list(self.handle.listTimers()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        watermark = timerValues.getCurrentWatermarkInMs()
        changed, moments = self._advance(watermark * 1000)
        self._wake(moments, watermark, [])  # Spark drops the timer that has expired, the only one
        for record, (cached, expires, live) in changed:
            yield Row(session=key[0], record=record, cached_at=cached, expires=expires, live=live)

    def _advance(self, now: int) -> tuple[list[tuple[str, tuple[int, int, bool]]], list[int]]:
        """Let all waiting rows up to now take effect, and entries end; what changed, in order, and the moments that are still to come."""
        rows, entries, index = self._read()
        due = sorted((r for r in rows if r[0] <= now), key=lambda r: (r[0], _ORDER.get(r[1], 9), r[2], r[3]))
        before = dict(entries)
        gone: list[tuple[str, tuple[int, int, bool]]] = []

        def end(records, moment=None):
            for r in records:
                cached, expires = entries.pop(r)
                gone.append((r, (cached, expires if moment is None else min(moment, expires), False)))

        for at, op, record, ttl in due:
            end([r for r, (_, e) in entries.items() if e <= at])
            if op == "cache":
                entries[record] = (at, at + ttl)
                index = at + ttl
            elif op == "extend" and at < index:
                entries = {r: (c, at + ttl if at > c else e) for r, (c, e) in entries.items()}
                index = at + ttl
            elif op == "delete" and record in entries:
                end([record], at)
            elif op == "invalidate":
                end(list(entries), at)
                index = 0
        end([r for r, (_, e) in entries.items() if e <= now])
        changed = [(r, v) for r, v in entries.items() if before.get(r) != v]
        left = [r for r in rows if r[0] > now]
        self._write(left, entries, index)
        return gone + [(r, (c, e, True)) for r, (c, e) in changed], [r[0] for r in left] + [e for _, e in entries.values()]

    def _wake(self, moments: list[int], watermark_ms: int, timers: list[int]) -> None:
        """The one timer of a session: when its next row takes effect or its next entry ends."""
        if not moments:
            return
        at = max(-(-min(moments) // 1000), watermark_ms + 1)
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def cache_changes(log: DataFrame, late: str = "1 hour", default_ttl: int = DEFAULT_TTL) -> DataFrame:
    """session, record, cached_at, expires, live: a row each time an entry gets other times, and one (live is false) when it ends.

    log is a stream of rows (session, op, record, at, ttl_seconds) that are at most late out of order.
    """
    ship(log.sparkSession)
    rows = log.where("session is not null and at is not null").withWatermark("at", late)
    micros = rows.withColumn("micros", F.unix_micros("at")).groupBy("session").transformWithState(SessionCache(default_ttl), _CHANGES, "Update", "EventTime")
    return micros.select("session", "record", F.timestamp_micros("cached_at").alias("cached_at"), F.timestamp_micros("expires").alias("expires"), "live")


def write_changes(changes: DataFrame, out: str, checkpoint: str):
    """Changes as a Parquet table, a folder a batch: a batch that runs again replaces its folder."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return changes.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(changes: DataFrame) -> DataFrame:
    """session, record, cached_at, expires of each record's last write, ended or not."""
    last = changes.groupBy("session", "record").agg(F.max(F.struct("cached_at", F.struct(F.when(F.col("live"), 0).otherwise(1).alias("ended"), F.when(F.col("live"), F.col("expires")).alias("e"), "expires").alias("v"))).alias("m"))
    return last.select("session", "record", F.col("m.cached_at").alias("cached_at"), F.col("m.v.expires").alias("expires"))
