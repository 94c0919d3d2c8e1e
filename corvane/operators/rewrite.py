"""Rewriting ids in nested values: JSON of any shape, and JSON inside its strings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.shared import saved, small

ID_TOKEN = r"[A-Za-z0-9][A-Za-z0-9_.:\-]*"


def rewritten(value, ids: dict[str, str]) -> tuple[object, int]:
    """The value with each string that is an id replaced, and how many were. Keys stay; a string that is itself an object or array of JSON is rewritten inside."""
    if isinstance(value, str):
        if value in ids:
            return ids[value], 1
        if value.lstrip()[:1] in ("{", "["):
            try:
                inner, n = rewritten(json.loads(value), ids)
            except ValueError:
                return value, 0
            return (json.dumps(inner, ensure_ascii=False), n) if n else (value, 0)
        return value, 0
    if isinstance(value, list):
        parts = [rewritten(v, ids) for v in value]
        return [v for v, _ in parts], sum(n for _, n in parts)
    if isinstance(value, dict):
        parts = {k: rewritten(v, ids) for k, v in value.items()}
        return {k: v for k, (v, _) in parts.items()}, sum(n for _, n in parts.values())
    return value, 0


def rewrite_ids(rows: DataFrame, key: list[str], payload: str, ids: DataFrame) -> DataFrame:
    """``*key, payload, rewrites, damaged``: payload as a variant, its ids replaced by ``ids`` (old, new; old is unique).

    The ids that a payload may hold are joined to it first, so that no task holds the map of ids; only payloads with a hit are
    taken apart. What isn't JSON is damaged: payload null, nothing rewritten. Null payloads stay null.
    """
    parsed = F.try_parse_json(payload)
    listed = saved(rows.select(*key, F.col(payload).alias("_raw"), F.monotonically_increasing_id().alias("_row"), (F.col(payload).isNotNull() & parsed.isNull()).alias("damaged")))
    tokens = listed.where("NOT damaged").select("_row", F.explode(F.array_distinct(F.regexp_extract_all("_raw", F.lit(f"({ID_TOKEN})"), F.lit(1)))).alias("old"))
    held = tokens.join(small(saved(ids.select("old", "new"))), "old").groupBy("_row").agg(F.collect_list("old").alias("_old"), F.collect_list("new").alias("_new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, raw, old, new = (batch.column(i).to_pylist() for i in range(4))
            out = [rewritten(json.loads(x), dict(zip(a, b))) for x, a, b in zip(raw, old, new)]
            yield pa.record_batch([pa.array(row, pa.int64()), pa.array([json.dumps(v, ensure_ascii=False) if n else None for v, n in out], pa.string()), pa.array([n for _, n in out], pa.int64())], ["_row", "_text", "rewrites"])

    done = listed.select("_row", "_raw").join(held, "_row").select("_row", "_raw", "_old", "_new").mapInArrow(run, "_row long, _text string, rewrites long")
    out = listed.join(done, "_row", "left")
    return out.select(*key, F.try_parse_json(F.coalesce("_text", "_raw")).alias("payload"), F.coalesce("rewrites", F.lit(0)).alias("rewrites"), "damaged")
