"""Streams with state and timers over several micro-batches, and refreshing by sessions."""

import datetime as dt
import time

import pytest

from corvane.sources.shared import new_folder
from corvane.streaming import jobs as J
from corvane.streaming import machines as M

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def run(spark, schema, batches, make):
    """The rows of every batch, each batch a file of its own."""
    folder = new_folder(spark, "test-streams")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # files are taken in order of time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with M.rocksdb(spark):
        J.run_available(make(stream), f"{folder}/out", f"{folder}/state", "append")
    return spark.read.parquet(f"{folder}/out").collect()


def test_legal_moves():
    moves = M.legal_moves()
    assert (None, "queued") in moves and ("failed", "queued") in moves and ("failed", "cancelled") in moves and ("writing", "live") in moves and ("chunking", "failed") in moves
    assert not moves & {(None, "live"), ("live", "cancelled"), ("cancelled", "queued"), ("queued", "chunking"), ("live", "failed"), ("failed", "failed")}


def test_jobs_over_several_batches(spark):
    schema = "job long, event_id long, ts timestamp, wanted string"
    batches = [
        [(1, 2, at(1), "extracting"), (1, 1, at(0), "queued"), (2, 3, at(0), "live"), (3, 20, at(0), "queued"), (3, 21, at(1), "cancelled")],
        [(1, 4, at(3), "embedding"), (1, 5, at(2), "chunking"), (1, 6, at(0.5), "failed"), (2, 7, at(4), "queued"), (2, 8, at(5), "failed"), (2, 9, at(6), "queued")],
        [(9, 10, at(600), "queued")],  # time goes on: what is done and silent is forgotten
        [(3, 11, at(601), "queued"), (1, 12, at(602), "writing"), (1, 13, at(603), "live"), (1, 14, at(604), "cancelled")],
    ]
    got = {r["event_id"]: (r["before"], r["wanted"], r["verdict"]) for r in run(spark, schema, batches, lambda s: M.job_moves(s, "1 minute", keep=3600))}
    assert got == {
        1: (None, "queued", "legal"), 2: ("queued", "extracting", "legal"), 3: (None, "live", "illegal"), 20: (None, "queued", "legal"), 21: ("queued", "cancelled", "legal"),
        5: ("extracting", "chunking", "legal"), 4: ("chunking", "embedding", "legal"), 6: ("extracting", "failed", "late"), 7: (None, "queued", "legal"), 8: ("queued", "failed", "legal"), 9: ("failed", "queued", "legal"),
        10: (None, "queued", "legal"), 11: (None, "queued", "legal"), 12: ("embedding", "writing", "legal"), 13: ("writing", "live", "legal"), 14: ("live", "cancelled", "illegal"),
    }


def test_leases_expire_without_a_sign_of_life(spark):
    schema = "resource long, event_id long, ts timestamp, worker long, release boolean"
    batches = [
        [(1, 1, at(0), 7, False), (1, 2, at(1), 7, False), (1, 3, at(1.5), 8, False), (2, 4, at(0), 7, False), (2, 5, at(0.5), 7, True), (2, 6, at(0.6), 8, False), (3, 7, at(0), 9, True)],
        [(1, 8, at(2), 8, False), (1, 9, at(3), 8, False), (4, 10, at(0.1), 5, False)],  # 7 was last seen at 1: until 2.5
        [(5, 11, at(60), 1, False)],
        [(1, 12, at(61), 7, False)],
    ]
    rows = run(spark, schema, batches, lambda s: M.leases(s, 90, "10 seconds"))
    got = {r["event_id"]: r["verdict"] for r in rows if r["event_id"] is not None}
    assert got == {1: "granted", 2: "renewed", 3: "refused", 4: "granted", 5: "released", 6: "granted", 7: "ignored", 8: "refused", 9: "granted", 10: "granted", 11: "granted", 12: "granted"}
    expired = {(r["resource"], r["worker"]) for r in rows if r["verdict"] == "expired"}
    assert expired == {(2, 8), (4, 5)}  # 1 had a new holder in the batch in which it would have expired


def test_the_session_keeps_its_store(spark):
    before = spark.conf.get(M.PROVIDER)
    with pytest.raises(ZeroDivisionError), M.rocksdb(spark):
        assert spark.conf.get(M.PROVIDER) == M.ROCKSDB
        raise ZeroDivisionError
    assert spark.conf.get(M.PROVIDER) == before


def test_refresh_is_idempotent_and_guarded(spark):
    folder = new_folder(spark, "test-refresh")
    schema = "bill string, title string, session int"
    table, news = f"{folder}/t", f"{folder}/new"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    state = lambda: sorted(map(tuple, spark.read.schema(schema).parquet(table).collect()), key=str)
    frame([("a", "old", 2022), ("b", "old", 2023), ("c", "old", 2024)]).write.partitionBy("session").parquet(table)
    batch = frame([("b", "new", 2023), ("c", "old", 2024), ("d", "new", 2024), ("z", "stale", 2022)])
    want = sorted([("a", "old", 2022), ("b", "new", 2023), ("c", "old", 2024), ("d", "new", 2024)], key=str)
    for _ in range(2):
        assert M.refresh_newest(batch, table, "session", ["bill"], news)
        assert state() == want
        assert sorted(r["bill"] for r in spark.read.parquet(news).collect()) == ["d"]
    for empty in (frame([]), frame([("d", "only", 2024)])):  # a session on file came back empty
        assert not M.refresh_newest(empty, table, "session", ["bill"], f"{folder}/none")
        assert state() == want
    assert M.refresh_newest(frame([("e", "x", 2025), ("f", "y", 2024)]), table, "session", ["bill"], f"{folder}/later")  # a new session begins
    assert state() == sorted([("a", "old", 2022), ("b", "new", 2023), ("e", "x", 2025), ("f", "y", 2024)], key=str)
