"""Streaming queries on the events table, run until the stream has no more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.plans.base import query, table
from corvane.sources.shared import new_folder
from corvane.streaming import jobs as J
from corvane.streaming import machines as M


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_windows(spark, sf_dir: str) -> DataFrame:
    """Hourly counts kept by a stream (windows and watermarks go beyond the batch operators)."""
    counts = J.tumbling_counts(J.event_stream(spark, f"{sf_dir}/events.parquet*"), "ts", ["event_type"], "1 hour", "1 hour")
    folder = new_folder(spark, "streams")
    J.run_available(counts, f"{folder}/out", f"{folder}/state", "complete")
    return spark.read.parquet(f"{folder}/out").select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("""WITH s AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), g AS (SELECT user_id, ts, sum((p IS NULL OR ts - p > INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM g GROUP BY user_id, session""")
def streamed_sessions(spark, sf_dir: str) -> DataFrame:
    """Each user's sessions, ended by half an hour of silence, kept by a stream."""
    sessions = J.session_counts(J.event_stream(spark, f"{sf_dir}/events.parquet*"), "ts", ["user_id"], "30 minutes", "1 hour")
    folder = new_folder(spark, "streams")
    J.run_available(sessions, f"{folder}/out", f"{folder}/state", "complete")
    read = spark.read.parquet(f"{folder}/out")
    return read.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), (F.col("w.end") - F.expr("INTERVAL 30 MINUTES")).cast("timestamp_ntz").alias("end"), "n")


@query("""WITH s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) FILTER (p IS NOT NULL AND p <> event_type) AS transitions, count(*) AS n FROM s GROUP BY user_id""")
def streamed_states(spark, sf_dir: str) -> DataFrame:
    """Each user's state machine folded by a stateful stream."""
    events = J.event_stream(spark, f"{sf_dir}/events.parquet*").select("user_id", "event_id", "ts", "event_type")
    folder = new_folder(spark, "streams")
    J.run_available(J.fold_states(events, "user_id", ["ts", "event_id"], "event_type"), f"{folder}/out", f"{folder}/state", "update")
    latest = spark.read.parquet(f"{folder}/out").groupBy("user_id").agg(F.max_by(F.struct("state", "transitions", "n"), "batch").alias("s"))
    return latest.select("user_id", "s.state", "s.transitions", "s.n")


_WANTED = ["extracting", "chunking", "embedding", "writing"]
_MOVES_SQL = "[" + ", ".join(f"'{a or ''}>{b}'" for a, b in sorted(M.legal_moves(), key=str)) + "]"


@query(f"""WITH w AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'live' ELSE {_WANTED}[1 + floor(value)::INT % 4] END AS wanted FROM events),
l AS (SELECT user_id, list({{'event_id': event_id, 'wanted': wanted, 'before': '', 'ok': false, 'state': ''}} ORDER BY ts, event_id) AS l FROM w GROUP BY user_id),
f AS (SELECT user_id, unnest(list_reduce(list_prepend([{{'event_id': -1, 'wanted': '', 'before': '', 'ok': false, 'state': ''}}], list_transform(l, lambda x: [x])), lambda acc, x: list_append(acc,
  {{'event_id': x[1].event_id, 'wanted': x[1].wanted, 'before': acc[-1].state, 'ok': list_contains({_MOVES_SQL}, acc[-1].state || '>' || x[1].wanted), 'state': CASE WHEN list_contains({_MOVES_SQL}, acc[-1].state || '>' || x[1].wanted) THEN x[1].wanted ELSE acc[-1].state END}}))) AS e FROM l)
SELECT user_id AS job, e.event_id AS event_id, nullif(e.before, '') AS before, e.wanted AS wanted, CASE WHEN e.ok THEN 'legal' ELSE 'illegal' END AS verdict FROM f WHERE e.event_id >= 0""")
def streamed_job_moves(spark, sf_dir: str) -> DataFrame:
    """Each wanted move of a job checked against the legal ones by a stateful stream with timers; illegal moves stay beside."""
    stage = F.get(F.array(*map(F.lit, _WANTED)), F.floor("value").cast("int") % 4)
    wanted = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "live").otherwise(stage)
    events = J.event_stream(spark, f"{sf_dir}/events.parquet*").select(F.col("user_id").alias("job"), "event_id", F.col("ts").cast("timestamp").alias("ts"), wanted.alias("wanted"))
    folder = new_folder(spark, "streams")
    with M.rocksdb(spark):
        J.run_available(M.job_moves(events, keep=366 * 86400), f"{folder}/out", f"{folder}/state", "append")
    return spark.read.parquet(f"{folder}/out").select("job", "event_id", "before", "wanted", "verdict")


_LEASE = 6 * 3600


@query(f"""WITH s AS (SELECT (props->>'k')::BIGINT AS resource, event_id, ts, user_id AS worker, event_type = 'purchase' AS release FROM events),
l AS (SELECT resource, list({{'event_id': event_id, 'ts': ts, 'worker': worker, 'release': release, 'verdict': '', 'holder': -1::BIGINT, 'beat': ts}} ORDER BY ts, event_id) AS l FROM s GROUP BY resource),
f AS (SELECT resource, list_reduce(list_prepend([{{'event_id': -1::BIGINT, 'ts': TIMESTAMP '1970-01-01', 'worker': -1::BIGINT, 'release': false, 'verdict': '', 'holder': -1::BIGINT, 'beat': TIMESTAMP '1970-01-01'}}], list_transform(l, lambda x: [x])), lambda acc, x: list_append(acc,
  {{'event_id': x[1].event_id, 'ts': x[1].ts, 'worker': x[1].worker, 'release': x[1].release,
  'verdict': CASE WHEN acc[-1].holder >= 0 AND x[1].ts - acc[-1].beat <= INTERVAL {_LEASE} SECOND THEN CASE WHEN acc[-1].holder <> x[1].worker THEN 'refused' WHEN x[1].release THEN 'released' ELSE 'renewed' END
    WHEN x[1].release THEN 'ignored' ELSE 'granted' END,
  'holder': CASE WHEN acc[-1].holder >= 0 AND x[1].ts - acc[-1].beat <= INTERVAL {_LEASE} SECOND THEN CASE WHEN acc[-1].holder = x[1].worker AND x[1].release THEN -1 ELSE acc[-1].holder END WHEN x[1].release THEN acc[-1].holder ELSE x[1].worker END,
  'beat': CASE WHEN (acc[-1].holder >= 0 AND x[1].ts - acc[-1].beat <= INTERVAL {_LEASE} SECOND AND acc[-1].holder <> x[1].worker) OR x[1].release THEN acc[-1].beat ELSE x[1].ts END}})) AS r FROM l)
SELECT resource, u.event_id AS event_id, u.worker AS worker, u.verdict AS verdict FROM (SELECT resource, unnest(r) AS u FROM f) WHERE u.event_id >= 0""")
def streamed_leases(spark, sf_dir: str) -> DataFrame:
    """Signs of life of workers for resources: one holder at a time, others refused until it is silent for the lease."""
    events = J.event_stream(spark, f"{sf_dir}/events.parquet*")
    signs = events.select(F.get_json_object("props", "$.k").cast("long").alias("resource"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("long").alias("worker"), (F.col("event_type") == "purchase").alias("release"))
    folder = new_folder(spark, "streams")
    with M.rocksdb(spark):
        J.run_available(M.leases(signs, _LEASE), f"{folder}/out", f"{folder}/state", "append")
    return spark.read.parquet(f"{folder}/out").where("event_id IS NOT NULL").select("resource", "event_id", "worker", "verdict")


@query("""WITH o AS (SELECT o_orderkey, year(o_orderdate) AS session, o_orderstatus, o_orderpriority FROM orders), n AS (SELECT max(session) AS newest FROM o)
SELECT o_orderkey, session, o_orderstatus FROM o, n WHERE session > newest - 2 OR o_orderpriority <> '1-URGENT'""")
def refreshed_sessions(spark, sf_dir: str) -> DataFrame:
    """A table of sessions (years of orders) that holds no urgent orders yet; a stream of all orders replaces its two newest sessions."""
    session = F.year("o_orderdate").alias("session")
    folder = new_folder(spark, "streams")
    held = table(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT'").select("o_orderkey", "o_orderstatus", session)
    held.write.partitionBy("session").parquet(f"{folder}/sessions")
    stream = J.event_stream(spark, f"{sf_dir}/orders.parquet*").select("o_orderkey", "o_orderstatus", session)
    M.refreshed(stream, f"{folder}/sessions", "session", ["o_orderkey"], f"{folder}/state")
    return spark.read.parquet(f"{folder}/sessions").select("o_orderkey", F.col("session").cast("long").alias("session"), "o_orderstatus")
