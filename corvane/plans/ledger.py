"""Queries on events (usage ledger, job journal) and conversations (transcripts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import ledger as L
from corvane.operators import rewrite as R
from corvane.plans.base import query, table

EV = "ev AS (SELECT *, (value * 100)::BIGINT AS cents, CASE WHEN event_id % 11 = 0 THEN NULL ELSE round(value * 100)::BIGINT END AS cost, (props::JSON ->> 'k')::BIGINT AS k FROM events)"


def _usage(spark, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.withColumns({"cost": F.when(F.col("event_id") % 11 == 0, None).otherwise(F.round(F.col("value") * 100).cast("long")), "k": F.get_json_object("props", "$.k").cast("long")})


@query(f"""WITH {EV}, p AS (SELECT 'user_id' AS dimension, coalesce(user_id::VARCHAR, '') AS key, cost, k FROM ev UNION ALL SELECT 'event_type', coalesce(event_type, ''), cost, k FROM ev)
SELECT dimension, key, sum(coalesce(cost, 0))::BIGINT AS cost, sum(coalesce(k, 0))::BIGINT AS tokens, count(*) AS n, count(*) FILTER (cost IS NULL) AS unknown_cost FROM p GROUP BY ALL""")
def usage_breakdown(spark, sf_dir: str) -> DataFrame:
    """Cost, tokens and rows of unknown cost by user and by type."""
    return L.usage_breakdown(_usage(spark, sf_dir), ["user_id", "event_type"], "cost", "k")


@query(f"""WITH {EV} SELECT coalesce(event_type, 'all') AS event_type, sum(cost)::BIGINT AS cost, count(*) AS n, grouping(event_type)::INT AS is_total FROM ev GROUP BY GROUPING SETS ((event_type), ())""")
def usage_totals(spark, sf_dir: str) -> DataFrame:
    """The groups and their total in one rollup."""
    return _usage(spark, sf_dir).rollup("event_type").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"), F.grouping("event_type").cast("int").alias("is_total")).withColumn("event_type", F.coalesce("event_type", F.lit("all")))


@query(f"""WITH {EV} SELECT user_id, strftime(ts - INTERVAL 7 HOURS, '%Y-%m') AS month, sum(cost)::BIGINT AS cost, count(*) AS n FROM ev GROUP BY ALL""")
def monthly_usage(spark, sf_dir: str) -> DataFrame:
    """Each user's calendar month at UTC-7."""
    return _usage(spark, sf_dir).groupBy("user_id", L.local_month(F.col("ts")).alias("month")).agg(F.sum("cost").alias("cost"), F.count("*").alias("n"))


@query(f"""WITH {EV}, m AS (SELECT user_id, sum(coalesce(cost, 0))::BIGINT AS used FROM ev GROUP BY ALL), l AS (SELECT *, CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 13 = 0 THEN 0 ELSE 300000 + user_id * 1000 END AS lim FROM m)
SELECT user_id, used, CASE WHEN user_id % 17 = 0 OR lim IS NULL THEN 'allowed' WHEN lim <= 0 OR used >= lim THEN 'blocked' WHEN used >= 0.8::DOUBLE * lim THEN 'warn' ELSE 'allowed' END AS status FROM l""")
def limit_status(spark, sf_dir: str) -> DataFrame:
    """Limits resolved (exempt, own, none) and compared with what was used."""
    used = _usage(spark, sf_dir).groupBy("user_id").agg(F.sum(F.coalesce("cost", F.lit(0))).alias("used"))
    u = F.col("user_id")
    limit = F.when(u % 10 == 0, None).when(u % 13 == 0, 0).otherwise(300000 + u * 1000)
    return used.select("user_id", "used", L.limit_status(F.col("used"), limit, u % 17 == 0).alias("status"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS queued, count(*) FILTER (event_type = 'refund') AS failed, count(*) FILTER (event_type NOT IN ('view', 'refund', 'purchase')) AS running,
max(ts) FILTER (event_type = 'purchase') AS newest, count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type NOT IN ('view', 'refund', 'purchase')) = 0 AS stalled FROM events GROUP BY user_id""")
def queue_summary(spark, sf_dir: str) -> DataFrame:
    """Counts by state, newest finished one, and whether the queue stands still."""
    ev, kind = table(spark, sf_dir, "events"), F.col("event_type")
    running = ~kind.isin("view", "refund", "purchase")
    out = ev.groupBy("user_id").agg(F.count_if(kind == "view").alias("queued"), F.count_if(kind == "refund").alias("failed"), F.count_if(running).alias("running"), F.max(F.when(kind == "purchase", F.col("ts"))).alias("newest"))
    return out.withColumn("stalled", (F.col("queued") > 0) & (F.col("running") == 0))


@query("""WITH s AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM s) SELECT user_id, segment::BIGINT AS segment, any_value(event_type) AS event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM n GROUP BY user_id, segment""")
def run_segments(spark, sf_dir: str) -> DataFrame:
    """runs of equal events of a user (gaps and islands)."""
    cut = L.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return cut.groupBy("user_id", "segment").agg(F.any_value("event_type").alias("event_type"), F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("""WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS day FROM events), r AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS run FROM d)
SELECT user_id, min(day) AS start, max(day) AS "end" FROM r GROUP BY user_id, run""")
def active_ranges(spark, sf_dir: str) -> DataFrame:
    """Consecutive days of each user."""
    days = table(spark, sf_dir, "events").select("user_id", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"))
    return L.contiguous_ranges(days, "user_id", "day")


@query("""SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_event(spark, sf_dir: str) -> DataFrame:
    """The newest row of each key."""
    return L.latest_per_key(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "ts", "event_type")


@query("""WITH t AS (SELECT user_id, event_id AS tag, ts AS at FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view'),
j AS (SELECT t.user_id, tag, max_by(f.event_id, (f.ts, f.event_id)) AS figure FROM t LEFT JOIN f ON f.user_id = t.user_id AND f.ts <= t.at GROUP BY ALL) SELECT user_id, tag, figure FROM j""")
def as_of_binding(spark, sf_dir: str) -> DataFrame:
    """Each purchase bound to the user's last view before it, by one sort of both (no join of all pairs)."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "view"))
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    figure = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return ev.withColumn("figure", figure).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("tag"), "figure")


@query("""SELECT user_id, event_id, value, running::DOUBLE AS running FROM (SELECT user_id, event_id, value, ts, round(sum(value::DECIMAL(18,2)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 2) AS running FROM events)""")
def running_spend(spark, sf_dir: str) -> DataFrame:
    """Cumulative sums in order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.sum(F.col("value").cast("decimal(18,2)")).over(w).cast("double").alias("running"))


@query("""SELECT user_id, k, first_id, attempts - 1 AS retries FROM (SELECT user_id, (props::JSON ->> 'k')::BIGINT AS k, min_by(event_id, (ts, event_id)) AS first_id, count(*) AS attempts FROM events GROUP BY ALL)""")
def first_attempts(spark, sf_dir: str) -> DataFrame:
    """the first attempt at each target, and how many followed."""
    return _usage(spark, sf_dir).groupBy("user_id", "k").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"), (F.count("*") - 1).alias("retries"))


@query("""WITH m AS (SELECT *, sum(length(text)) OVER w AS used, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn, role, used::BIGINT AS used FROM m WHERE used <= 600 OR n = 1""")
def context_window(spark, sf_dir: str) -> DataFrame:
    """Newest messages within a budget of characters."""
    return L.context_window(table(spark, sf_dir, "conversations"), 600).select("conv_id", "turn", "role", "used")


@query("""WITH h AS (SELECT *, instr(lower(text), 'the') AS spot FROM conversations WHERE contains(lower(text), 'the')), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM h) WHERE n = 1)
SELECT conv_id, turn, (CASE WHEN spot > 91 THEN '...' ELSE '' END) || substr(text, greatest(spot - 90, 1), least(spot - 1, 90) + 93) || (CASE WHEN length(text) > spot + 92 THEN '...' ELSE '' END) AS snippet FROM f""")
def history_search(spark, sf_dir: str) -> DataFrame:
    """First message of each conversation with the word, and 90 characters around it."""
    conv = table(spark, sf_dir, "conversations")
    at = F.instr(F.lower("text"), "the")
    hits = conv.where(at > 0).groupBy("conv_id").agg(F.min_by(F.struct("turn", "text"), "turn").alias("m")).select("conv_id", "m.turn", "m.text")
    start = F.greatest(at - 90, F.lit(1))
    snippet = F.concat(F.when(at > 91, "...").otherwise(""), F.substr("text", start, F.least(at - 1, F.lit(90)) + 93), F.when(F.length("text") > at + 92, "...").otherwise(""))
    return hits.select("conv_id", "turn", snippet.alias("snippet"))


@query("""SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS whole, count(*) AS n FROM conversations GROUP BY conv_id""")
def fragment_reassembly(spark, sf_dir: str) -> DataFrame:
    """Fragments put together in order."""
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"), F.count("*").alias("n"))
    return parts.select("conv_id", F.array_join("p.text", "\n").alias("whole"), "n")


@query("""SELECT c.conv_id, c.turn FROM conversations c WHERE c.role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant')""")
def unanswered_turns(spark, sf_dir: str) -> DataFrame:
    """Questions without a reply (anti join), which a repair would answer as cancelled."""
    conv = table(spark, sf_dir, "conversations")
    replies = conv.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return conv.where("role = 'user'").join(replies, ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


@query("""SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM conversations) WHERE role = 'assistant' AND n = 1""")
def latest_reply(spark, sf_dir: str) -> DataFrame:
    """The latest text of each conversation's pool."""
    return L.latest_per_key(table(spark, sf_dir, "conversations").where("role = 'assistant'"), "conv_id", ["turn"]).select("conv_id", "turn", "text")


@query("""SELECT event_type, count(*) AS n, array_to_string(list_sort(list_distinct(list(user_id))), ',') AS users FROM events WHERE value > 90 GROUP BY event_type""")
def error_summary(spark, sf_dir: str) -> DataFrame:
    """Count and distinct users of each kind."""
    return table(spark, sf_dir, "events").where("value > 90").groupBy("event_type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("user_id")), ",").alias("users"))


@query("""WITH a AS (SELECT user_id, event_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), b AS (SELECT *, floor((n - 1) / 40)::BIGINT AS batch FROM a)
SELECT user_id, batch, count(*) AS n, min(event_id) AS first_id FROM b GROUP BY ALL""")
def batch_formation(spark, sf_dir: str) -> DataFrame:
    """Batches of at most 40 in order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("batch", F.floor((F.row_number().over(w) - 1) / 40)).groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""SELECT user_id, max(ts) AS beat, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 12 HOURS AS stale FROM events GROUP BY user_id""")
def stale_claims(spark, sf_dir: str) -> DataFrame:
    """Last heartbeat, and whether it is older than twelve hours at the newest event."""
    ev = table(spark, sf_dir, "events")
    now = F.broadcast(ev.agg(F.max("ts").alias("now")))  # one row
    return ev.groupBy("user_id").agg(F.max("ts").alias("beat")).crossJoin(now).select("user_id", "beat", (F.col("beat") < F.col("now") - F.expr("INTERVAL 12 HOURS")).alias("stale"))


@query("""WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rung, value < 95 AS ok FROM events)
SELECT user_id, rung, CASE WHEN coalesce(bool_and(ok) OVER (PARTITION BY user_id ORDER BY rung ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN CASE WHEN ok THEN 'ok' ELSE 'failed' END ELSE 'not checked' END AS state FROM o""")
def short_circuit_checks(spark, sf_dir: str) -> DataFrame:
    """After a first failure the rest isn't checked."""
    w = Window.partitionBy("user_id").orderBy("rung")
    ev = table(spark, sf_dir, "events").withColumns({"rung": F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")), "ok": F.col("value") < 95})
    before = F.coalesce(F.bool_and("ok").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return ev.select("user_id", "rung", F.when(~before, "not checked").when(F.col("ok"), "ok").otherwise("failed").alias("state"))


@query("""WITH t AS (SELECT conv_id, turn, conv_id * 7 + turn AS x FROM conversations), d AS (SELECT DISTINCT doc_id FROM documents)
SELECT conv_id, turn, (2 * (a.doc_id IS NOT NULL)::INT + (b.doc_id IS NOT NULL)::INT)::BIGINT AS rewrites, CASE WHEN a.doc_id IS NULL THEN 'doc-' ELSE 'd/' END || x AS doc, CASE WHEN b.doc_id IS NULL THEN 'doc-' ELSE 'd/' END || (x + 1) AS called, 'see doc-' || x AS note, 'doc-' || x AS kept
FROM t LEFT JOIN d a ON a.doc_id = x LEFT JOIN d b ON b.doc_id = x + 1""")
def rewritten_history(spark, sf_dir: str) -> DataFrame:
    """Ids of documents in the turns' tool payloads rewritten at any depth, in arguments held as a string too; keys and longer texts stay."""
    x = F.col("conv_id") * 7 + F.col("turn")
    args = F.to_json(F.struct(F.format_string("doc-%d", x + 1).alias("doc_id"), F.lit(5).alias("k")))
    call = F.struct(F.lit("open").alias("name"), args.alias("args"))
    payload = F.to_json(F.struct(F.format_string("doc-%d", x).alias("doc_id"), F.array(call).alias("calls"), F.array(F.struct(F.array(F.format_string("doc-%d", x)).alias("of"))).alias("deep"), F.format_string("see doc-%d", x).alias("note"), F.create_map(F.format_string("doc-%d", x), F.lit(1)).alias("seen")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", payload.alias("payload"))
    ids = table(spark, sf_dir, "documents").select("doc_id").distinct().select(F.format_string("doc-%d", "doc_id").alias("old"), F.format_string("d/%d", "doc_id").alias("new"))
    out = R.rewrite_ids(turns, ["conv_id", "turn"], "payload", ids)
    at = lambda path: F.try_variant_get("payload", path, "string")
    seen = F.get(F.json_object_keys(F.to_json(F.try_variant_get("payload", "$.seen", "variant"))), F.lit(0))
    return out.select("conv_id", "turn", "rewrites", at("$.doc_id").alias("doc"), F.get_json_object(at("$.calls[0].args"), "$.doc_id").alias("called"), at("$.note").alias("note"), seen.alias("kept"))
