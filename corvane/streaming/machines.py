"""Stateful streams with timers: a job machine that knows its legal moves, and leases that expire without a heartbeat.

Both keep a row of state a key in the state store, take a key's rows of a micro-batch in order of time, and let go of state by event-time timers. What isn't
allowed comes out beside the rest, marked, so that it can go to a table of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# The stages of a job, and the moves beside those from stage to stage.
STAGES = ["queued", "extracting", "chunking", "embedding", "writing", "live"]
FINAL = ["live", "cancelled"]
LEASE_SECONDS = 90


def legal_moves(stages: list[str] = STAGES) -> set[tuple[str | None, str]]:
    """A new job is queued; a running one goes to its next stage, fails or is cancelled; a failed one may be queued again or cancelled."""
    moves = {(None, stages[0]), ("failed", stages[0]), ("failed", "cancelled")}
    moves |= set(zip(stages, stages[1:]))
    return moves | {(s, end) for s in stages[:-1] for end in ("failed", "cancelled")}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State with timers needs this store; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class JobMachine(StatefulProcessor):
    """Checks each wanted state against the legal moves; a finished job's state goes after ``keep`` seconds without an event."""

    def __init__(self, moves: set, keep: int):
        self.moves, self.keep = moves, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, at long, id long")

    def handleInputRows(self, key, rows, timerValues):
        held = self.now.get() if self.now.exists() else (None, None, None)
        state, last = held[0], (held[1], held[2])
        for row in sorted(((r["us"], r["event_id"], r["wanted"]) for r in rows), key=lambda r: r[:2]):
            us, event, wanted = row
            late = last[0] is not None and (us, event) < last
            if state in FINAL and us - last[0] > self.keep * 1_000_000:  # forgotten, whether or not the timer has run
                state = None
            legal = not late and (state, wanted) in self.moves
            yield Row(job=key[0], event_id=event, us=us, before=state, wanted=wanted, verdict="late" if late else "legal" if legal else "illegal")
            if not late:
                last = (us, event)
            if legal:
                state = wanted
        self.now.update((state, *last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state in FINAL:
            self.handle.registerTimer(last[0] // 1000 + self.keep * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.now.clear()
        return iter([])

    def close(self) -> None:
        pass


def job_moves(events: DataFrame, late: str = "1 hour", keep: int = 7 * 86400) -> DataFrame:
    """``job, event_id, ts, before, wanted, verdict`` of a stream of ``job, event_id, ts, wanted``.

    verdict: legal, illegal (the job stays as it is) or late (older than what the job has had in an earlier batch). A job that is
    done and silent for ``keep`` seconds is forgotten; an event after that is of a new job.
    """
    kind = events.schema["job"].dataType.simpleString()
    stamped = events.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    out = stamped.groupBy("job").transformWithState(JobMachine(legal_moves(), keep), f"job {kind}, event_id long, us long, before string, wanted string, verdict string", "Append", "EventTime")
    return out.select("job", "event_id", F.timestamp_micros("us").alias("ts"), "before", "wanted", "verdict")


class Leases(StatefulProcessor):
    """One holder a resource: it renews by any sign of life, others are refused until it is silent for the lease."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "worker long, beat long")

    def handleInputRows(self, key, rows, timerValues):
        worker, beat = self.held.get() if self.held.exists() else (None, None)
        for us, event, who, release in sorted((r["us"], r["event_id"], r["worker"], r["release"]) for r in rows):
            alive = worker is not None and us - beat <= self.seconds * 1_000_000
            if alive and who != worker:
                verdict = "refused"
            elif release:
                verdict = "released" if alive else "ignored"
                worker, beat = (None, None) if alive else (worker, beat)
            else:
                verdict = "renewed" if alive else "granted"
                worker, beat = who, us
            yield Row(resource=key[0], event_id=event, us=us, worker=who, verdict=verdict)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if worker is None:
            self.held.clear()
        else:
            self.held.update((worker, beat))
            self.handle.registerTimer(beat // 1000 + self.seconds * 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        worker, beat = self.held.get()
        self.held.clear()
        yield Row(resource=key[0], event_id=None, us=beat, worker=worker, verdict="expired")

    def close(self) -> None:
        pass


def leases(signs: DataFrame, seconds: int = LEASE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """``resource, event_id, ts, worker, verdict`` of a stream of ``resource, event_id, ts, worker, release``.

    verdict: granted (it is free, or its holder was silent for the lease), renewed, refused (another holds it), released, ignored (a release of what isn't held), and, when the
    watermark passes a lease's end, expired with the last sign of life. What is granted doesn't hang on when that is.
    """
    kind = signs.schema["resource"].dataType.simpleString()
    stamped = signs.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    out = stamped.groupBy("resource").transformWithState(Leases(seconds), f"resource {kind}, event_id long, us long, worker long, verdict string", "Append", "EventTime")
    return out.select("resource", "event_id", F.timestamp_micros("us").alias("ts"), "worker", "verdict")


# refreshing a table by its newest sessions


def refresh_newest(batch: DataFrame, path: str, session: str, key: list[str], new_rows: str, newest: int = 2) -> bool:
    """Replace the ``newest`` sessions of the table at ``path`` (partitioned by session) by the batch's rows; write those that are new by key to ``new_rows``.

    A session that is on file and has no rows in the batch is a fault of the source: nothing is changed then, and the result is False. Only the partitions of
    these sessions are overwritten, new rows first, and so the same batch again leaves both as they are.
    """
    spark = batch.sparkSession
    held = spark.read.schema(batch.schema).parquet(path)
    on_file, given = ({r[0] for r in df.select(session).distinct().orderBy(F.desc(session)).limit(newest).collect()} for df in (held, batch))
    wanted = sorted(on_file | given, reverse=True)[:newest]
    if not given or (on_file & set(wanted)) - given:
        return False
    now = batch.where(F.col(session).isin(wanted))
    if not _exists(spark, f"{new_rows}/_SUCCESS"):  # a batch done again has listed them; the table may hold them by now
        now.join(held.select(session, *key), [session, *key], "left_anti").write.mode("overwrite").parquet(new_rows)
    now.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(session).parquet(path)
    return True


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def refreshed(stream: DataFrame, path: str, session: str, key: list[str], checkpoint: str) -> Callable[[int], str]:
    """Run a stream of whole sessions into the table at ``path`` until there is no more; returns where batch n's new rows are."""
    folder = lambda n: f"{checkpoint}-new/batch={n}"
    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: refresh_newest(batch, path, session, key, folder(n))).trigger(availableNow=True).start().awaitTermination()
    return folder
