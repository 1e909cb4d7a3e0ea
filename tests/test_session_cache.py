"""The session cache as a stream: against a loop over the log, over restarts and other cuts into batches."""

import datetime as dt
import random

import pytest

from lodestream.streaming import session_cache as S

T0 = dt.datetime(2024, 1, 1)
ORDER = {"extend": 0, "cache": 1, "delete": 2, "invalidate": 3}


def by_hand(log, default=S.DEFAULT_TTL):
    """(session, record, cached_at, ended at) of all lives of all records."""
    out = []
    for session in {r[0] for r in log}:
        live, index = {}, dt.datetime.min
        rows = sorted({r for r in log if r[0] == session}, key=lambda r: (r[3], ORDER[r[1]], r[2] or "", default if r[4] is None else r[4]))
        for _, op, record, at, ttl in [*rows, (session, "end", None, dt.datetime.max, 0)]:
            for r in [r for r, (_, e) in live.items() if e <= at]:
                out.append((session, r, *live.pop(r)))
            keep = dt.timedelta(seconds=default if ttl is None else ttl)
            if op == "cache":
                live[record] = (at, at + keep)
                index = at + keep
            elif op == "extend" and at < index:
                live = {r: (c, at + keep if at > c else e) for r, (c, e) in live.items()}
                index = at + keep
            elif op == "delete" and record in live:
                out.append((session, record, live.pop(record)[0], at))
            elif op == "invalidate":
                out += [(session, r, c, at) for r, (c, _) in live.items()]
                live, index = {}, dt.datetime.min
    return sorted(out)


@pytest.fixture(scope="module")
def log():
    rng = random.Random(6)
    rows = []
    for k in range(500):
        op = rng.choices(["cache", "extend", "delete", "invalidate"], [6, 4, 1, 0.3])[0]
        rows.append((rng.randrange(6), op, f"r{rng.randrange(4)}" if op in ("cache", "delete") else None, T0 + dt.timedelta(minutes=rng.randrange(9_000)), rng.choice([None, 3_600, 20_000, 60_000])))
    return sorted(rows, key=lambda r: r[3])


def replay(spark, log, cuts, folder, same_checkpoint=True):
    """All changes, the log coming in pieces, each by a query that starts at the checkpoint of the one before; a last row of another session ends it."""
    own = spark.newSession()
    for k, v in {**S.STATE_STORE, "spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC"}.items():
        own.conf.set(k, v)
    end = [(99, "extend", None, T0 + dt.timedelta(days=60), None)]
    rng = random.Random(1)
    for a, b in zip([0, *cuts], [*cuts, len(log)]):
        piece = log[a:b] + (end if b == len(log) else [])
        rng.shuffle(piece)
        own.createDataFrame(piece, S.LOG_SCHEMA).repartition(2).write.mode("append").parquet(f"{folder}/log")
        stream = own.readStream.schema(S.LOG_SCHEMA).parquet(f"{folder}/log")
        S.write_changes(S.cache_changes(stream), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("cuts", [[], [150, 151, 400]])
def test_lives_equal_a_loop(spark, log, cuts, tmp_path):
    got = replay(spark, log, cuts, str(tmp_path))
    ended = sorted((r.session, r.record, r.cached_at, r.expires) for r in got.where("not live").collect())
    assert ended == by_hand(log)


def test_records_that_were_never_extended_or_dropped(spark, tmp_path):
    """A write anew starts a new life; rows of one time, repeated rows, and a row without a session."""
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(1, "cache", "a", at(0), 600), (1, "cache", "a", at(5), 600), (1, "cache", "a", at(5), 600), (1, "extend", None, at(5), 600), (1, "cache", "a", at(30), 600), (2, "extend", None, at(3), 600), (None, "cache", "x", at(1), 600)]
    got = replay(spark, rows, [4], str(tmp_path))
    ended = sorted((r.record, r.cached_at, r.expires) for r in got.where("not live").collect())
    assert ended == [("a", at(5), at(15)), ("a", at(30), at(40))]
    assert [(r.session, r.record, r.cached_at, r.expires) for r in S.latest(got).collect()] == [(1, "a", at(30), at(40))]
