"""Structured Streaming jobs over event files: a job state machine, token folds and windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The files at ``path`` (a pattern) as a stream with the schema that they have."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling_counts(events: DataFrame, ts: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts by window and keys; rows later than ``late`` behind the newest are dropped."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).groupBy(F.window("_ts", width).alias("w"), *keys).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Counts by session and keys; a session ends when nothing comes for ``gap``."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).groupBy(F.session_window("_ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))


def fold_states(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """``key, state, transitions, n``: each key's state after the rows so far, kept across batches."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, moves, n = held.get if held.exists else (None, 0, 0)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        for s in rows[state]:
            moves += now is not None and s != now
            now = s
            n += 1
        held.update((now, int(moves), int(n)))
        yield pd.DataFrame({key: [k[0]], "state": [now], "transitions": [moves], "n": [n]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, state string, transitions long, n long", "state string, transitions long, n long", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str) -> None:
    """Process what is there and stop. In complete mode ``out`` holds the last result, else all batches by number."""

    def put(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out)
        else:  # a batch that is done again after a failure replaces its own folder
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
