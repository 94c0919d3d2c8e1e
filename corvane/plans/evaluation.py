"""Evaluation queries: the expected chunks of a benchmark item are the lines that hold its longest line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import evaluation as E
from corvane.operators import scoring as S
from corvane.operators.corpus import ranked_percentile
from corvane.operators.retrieval import bm25, top_k, verbatim
from corvane.plans.base import CHUNKS_SQL, chunks, listed_chunks, query, table
from corvane.plans.retrieval import BM25_SQL
from corvane.sources.shared import saved, small

RUN_SQL = f"""WITH {CHUNKS_SQL}, {BM25_SQL}, run AS (SELECT query_id, chunk_id, score, rank FROM bm_ranked WHERE rank <= 20),
expected AS (SELECT item_id AS query_id, chunk_id AS expected_id FROM benchmark, chunks WHERE contains(chunks.text, benchmark.text)),
m AS (SELECT e.query_id, e.expected_id, min(r.rank) AS rank FROM expected e LEFT JOIN run r ON r.query_id = e.query_id AND r.chunk_id = e.expected_id GROUP BY ALL),
s AS (SELECT query_id, min(rank) AS lookup_rank, CASE WHEN count(rank) = count(*) THEN max(rank) END AS comparison_rank, count(*) AS expected FROM m GROUP BY query_id)"""


def _run(spark, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return saved(bm25(listed_chunks(spark, sf_dir), items, 20))


def _expected(spark, sf_dir: str) -> DataFrame:
    """A stated query set (the items) against all chunks: those that hold an item verbatim."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    return verbatim(chunks(spark, sf_dir).select("chunk_id", "text"), items).select("query_id", F.col("chunk_id").alias("expected_id"))


@query(RUN_SQL + " SELECT query_id, lookup_rank::INT AS lookup_rank, comparison_rank::INT AS comparison_rank, expected FROM s")
def lookup_scores(spark, sf_dir: str) -> DataFrame:
    """Ranks of the expected chunks of every query that has some."""
    return E.lookup_and_comparison(E.first_matches(_run(spark, sf_dir), _expected(spark, sf_dir)))


@query(RUN_SQL + """ SELECT coalesce(kind, 'all') AS kind, count(*) AS n, round(avg(CASE WHEN lookup_rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN lookup_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN lookup_rank <= 20 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_20
FROM (SELECT *, CASE WHEN expected > 1 THEN 'comparison' ELSE 'lookup' END AS kind FROM s) GROUP BY GROUPING SETS ((kind), ())""")
def recall_summary(spark, sf_dir: str) -> DataFrame:
    """Recall by type and over all."""
    scored = E.lookup_and_comparison(E.first_matches(_run(spark, sf_dir), _expected(spark, sf_dir)))
    scored = scored.withColumn("kind", F.when(F.col("expected") > 1, "comparison").otherwise("lookup"))
    return E.recall_summary(scored, [1, 5, 20], "kind").withColumn("kind", F.coalesce("kind", F.lit("all")))


@query(RUN_SQL + """, d AS (SELECT r.*, c.fiscal_year AS y FROM run r JOIN chunks c USING (chunk_id)),
p AS (SELECT a.query_id, round(sum((a.y > b.y)::INT)::DOUBLE / nullif(sum((a.y <> b.y)::INT), 0), 6) AS all_pairs FROM d a JOIN d b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY ALL),
l AS (SELECT query_id, y, lead(y) OVER (PARTITION BY query_id ORDER BY rank) AS ny FROM d)
SELECT query_id, any_value(p.all_pairs) AS all_pairs, round(coalesce(avg(CASE WHEN ny IS NOT NULL THEN (y >= ny)::INT::DOUBLE END), 1.0::DOUBLE), 6) AS adjacent FROM l LEFT JOIN p USING (query_id) GROUP BY query_id""")
def chronology(spark, sf_dir: str) -> DataFrame:
    """Both newest-first rates of every query."""
    # Years are in the index, a column beside the tokens; the texts aren't split again. Written, since three steps read it.
    dated = saved(listed_chunks(spark, sf_dir).select("chunk_id", "fiscal_year").join(small(_run(spark, sf_dir)), "chunk_id"))
    return E.concordance(dated)


@query("""WITH s AS (SELECT l.doc_id, floor(d.n_chars / 100)::INT AS score, l.quality = 0 AS bad FROM labels l JOIN documents d USING (doc_id)), g AS (SELECT unnest(range(1, 27)) AS t)
SELECT t::INT AS threshold, count(*) FILTER (score < t AND bad) AS tp, count(*) FILTER (score < t AND NOT bad) AS fp, round(count(*) FILTER (score < t AND bad)::DOUBLE / nullif(count(*) FILTER (score < t), 0), 6) AS precision,
round(count(*) FILTER (score < t AND bad)::DOUBLE / nullif(count(*) FILTER (bad), 0), 6) AS recall, round(count(*) FILTER (score >= t)::DOUBLE / count(*), 6) AS pass_rate FROM s, g GROUP BY t""")
def threshold_sweep(spark, sf_dir: str) -> DataFrame:
    """26 thresholds over the labelled documents."""
    scored = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(F.floor(F.col("n_chars") / 100).cast("int").alias("score"), (F.col("quality") == 0).alias("bad"))
    return E.threshold_sweep(scored, spark.range(1, 27).select(F.col("id").cast("int").alias("threshold")), "score", "bad")


@query(RUN_SQL + """, pool AS (SELECT r.query_id, r.chunk_id, r.score, c.fiscal_year - max(c.fiscal_year) OVER (PARTITION BY r.query_id) AS age FROM run r JOIN chunks c USING (chunk_id)),
w AS (SELECT unnest([0.0, 0.25, 0.85, 1.5])::DOUBLE AS weight), k AS (SELECT weight, query_id, chunk_id, row_number() OVER (PARTITION BY weight, query_id ORDER BY round(score + weight * age, 6) DESC, chunk_id) AS rank FROM pool, w)
SELECT weight, count(DISTINCT k.query_id) AS queries, count(DISTINCT CASE WHEN rank <= 5 AND e.expected_id IS NOT NULL THEN k.query_id END) AS hits FROM k LEFT JOIN expected e ON e.query_id = k.query_id AND e.expected_id = k.chunk_id GROUP BY weight""")
def recency_sweep(spark, sf_dir: str) -> DataFrame:
    """Captured pools ranked anew at each weight."""
    pool = chunks(spark, sf_dir).select("chunk_id", "fiscal_year").join(small(_run(spark, sf_dir).select("query_id", "chunk_id", "score")), "chunk_id")
    newest = pool.groupBy("query_id").agg(F.max("fiscal_year").alias("newest"))
    weights = F.explode(F.array(*map(F.lit, [0.0, 0.25, 0.85, 1.5]))).alias("weight")
    again = pool.join(newest, "query_id").select("query_id", "chunk_id", "score", (F.col("fiscal_year") - F.col("newest")).alias("age"), weights)
    again = again.select("weight", "chunk_id", "query_id", F.concat_ws(":", "weight", "query_id").alias("group"), F.round(F.col("score") + F.col("weight") * F.col("age"), 6).alias("s"))
    ranked = top_k(again, "group", "s", "chunk_id", 20)
    joined = ranked.join(_expected(spark, sf_dir).withColumnRenamed("expected_id", "chunk_id").distinct().withColumn("e", F.lit(True)), ["query_id", "chunk_id"], "left")
    return joined.groupBy("weight").agg(F.countDistinct("query_id").alias("queries"), F.countDistinct(F.when((F.col("rank") <= 5) & F.col("e"), F.col("query_id"))).alias("hits"))


@query(RUN_SQL + """, r AS (SELECT query_id, max(score) - min(score) AS spread FROM run GROUP BY query_id HAVING count(*) > 1) SELECT count(*) AS pools, round(list_sort(list(spread))[floor((count(*) - 1) * 0.5)::INT + 1], 6) AS median_spread, round(list_sort(list(spread))[floor((count(*) - 1) * 0.95)::INT + 1], 6) AS p95_spread FROM r""")
def score_spread(spark, sf_dir: str) -> DataFrame:
    """Median of each pool's score range."""
    spread = _run(spark, sf_dir).groupBy("query_id").agg((F.max("score") - F.min("score")).alias("s"), F.count("*").alias("n")).where("n > 1")
    # One number a query: the query set bounds the list.
    got = spread.agg(F.count("*").alias("pools"), F.collect_list("s").alias("l"))
    return got.select("pools", F.round(ranked_percentile(F.col("l"), 0.5), 6).alias("median_spread"), F.round(ranked_percentile(F.col("l"), 0.95), 6).alias("p95_spread"))


@query(RUN_SQL + " SELECT fiscal_year, count(*) AS n, count(DISTINCT query_id) AS queries FROM expected e JOIN chunks c ON c.chunk_id = e.expected_id GROUP BY fiscal_year")
def ground_truth_years(spark, sf_dir: str) -> DataFrame:
    """Expected chunks by year."""
    years = chunks(spark, sf_dir).select(F.col("chunk_id").alias("expected_id"), "fiscal_year")
    return _expected(spark, sf_dir).join(years, "expected_id").groupBy("fiscal_year").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"))


@query("""WITH c AS (SELECT conv_id, count(*) AS emitted, count(*) FILTER (role = 'assistant') AS covered, count(*) FILTER (role = 'user') AS claims FROM conversations GROUP BY conv_id)
SELECT conv_id, round(covered::DOUBLE / nullif(greatest(emitted, covered), 0), 6) AS precision, round(least(covered, claims)::DOUBLE / nullif(claims, 0), 6) AS recall FROM c""")
def claim_coverage(spark, sf_dir: str) -> DataFrame:
    """Precision and recall of covered claims."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("emitted"), F.count_if(F.col("role") == "assistant").alias("covered"), F.count_if(F.col("role") == "user").alias("claims"))
    return c.select("conv_id", F.round(F.col("covered") / F.nullif(F.greatest("emitted", "covered"), F.lit(0)), 6).alias("precision"), F.round(F.least("covered", "claims") / F.nullif("claims", F.lit(0)), 6).alias("recall"))


@query("""SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'assistant') AS replied, sum(length(text))::BIGINT AS chars, round(avg(length(text)) FILTER (role = 'assistant'), 6) AS mean_reply, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def transcript_scores(spark, sf_dir: str) -> DataFrame:
    """Derived columns of every transcript."""
    reply = F.col("role") == "assistant"
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.count_if(reply).alias("replied"), F.sum(F.length("text")).alias("chars"), F.round(F.avg(F.when(reply, F.length("text"))), 6).alias("mean_reply"), F.max("turn").alias("last_turn"))


@query("""WITH t AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS replied, sum(length(text)) AS chars FROM conversations GROUP BY conv_id)
SELECT count(*) AS runs, round(avg(turns), 6) AS mean_turns, round(sum(replied)::DOUBLE / sum(turns), 6) AS reply_rate, round(avg(CASE WHEN replied > 0 THEN chars::DOUBLE / turns END), 6) AS mean_chars FROM t""")
def run_summary(spark, sf_dir: str) -> DataFrame:
    """Means and ratios of sums over all runs."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("replied"), F.sum(F.length("text")).alias("chars"))
    return t.agg(F.count("*").alias("runs"), F.round(F.avg("turns"), 6).alias("mean_turns"), F.round(F.sum("replied") / F.sum("turns"), 6).alias("reply_rate"), F.round(F.avg(F.when(F.col("replied") > 0, F.col("chars") / F.col("turns"))), 6).alias("mean_chars"))


#: A user's events as the tool calls of a transcript: what they bought are the facts.
_CALLS_SQL = """c AS (SELECT user_id AS transcript, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'view' THEN 'retrieve' WHEN 'error' THEN 'retrieve' WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'cite' ELSE 'refuse' END AS tool,
  CASE WHEN event_type <> 'signup' THEN (props->>'k')::BIGINT % 10 END AS target, event_type = 'error' AS failed FROM events),
f AS (SELECT DISTINCT transcript, target FROM c WHERE tool = 'cite'),
r AS (SELECT *, row_number() OVER w = 1 AS first, coalesce(max(failed::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS again, coalesce(max((tool = 'retrieve' AND NOT failed)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen FROM c WINDOW w AS (PARTITION BY transcript, target ORDER BY n)),
o AS (SELECT transcript, count(*) AS calls, count(*) FILTER (tool = 'retrieve') AS retrieves, count(*) FILTER (failed) AS errors, count(DISTINCT target) AS targets, count(*) FILTER (target IS NOT NULL AND first AND NOT failed) AS clean, count(*) FILTER (target IS NOT NULL AND again) AS retries,
  count(*) FILTER (target IS NOT NULL AND again AND NOT failed) AS recovered, count(*) FILTER (tool = 'cite') AS cites, count(DISTINCT target) FILTER (tool = 'cite') AS emitted, count(DISTINCT target) FILTER (tool = 'cite' AND seen) AS covered, count(*) FILTER (tool = 'refuse') > 0 AS refused,
  coalesce(max(n) FILTER (tool = 'cite') = max(n), false) AS answered FROM r GROUP BY transcript),
m AS (SELECT f.transcript, f.target, (SELECT min(n) FROM c WHERE c.transcript = f.transcript AND c.target = f.target AND tool = 'retrieve' AND NOT failed) AS seen_at, EXISTS (SELECT 1 FROM r WHERE r.transcript = f.transcript AND r.target = f.target AND tool = 'cite' AND seen) AS cited FROM f),
p AS (SELECT transcript, count(*) AS facts, count(seen_at) AS facts_seen, count(*) FILTER (cited) AS facts_cited, CASE WHEN count(seen_at) = count(*) THEN max(seen_at) END AS sufficient_at FROM m GROUP BY transcript),
s AS (SELECT o.transcript, calls, retrieves, errors, targets, retries, recovered, cites, emitted, covered, refused, answered, coalesce(facts, 0) AS facts, coalesce(facts_seen, 0) AS facts_seen, coalesce(facts_cited, 0) AS facts_cited, sufficient_at,
  CASE WHEN sufficient_at IS NOT NULL THEN (SELECT count(*) FROM c WHERE c.transcript = o.transcript AND tool = 'retrieve' AND n > sufficient_at) END AS surplus,
  CASE WHEN targets > 0 THEN round(clean::DOUBLE / targets, 6) END AS first_try_rate, CASE WHEN retries > 0 THEN round(recovered::DOUBLE / retries, 6) END AS recovery_rate, CASE WHEN calls > 0 THEN round(errors::DOUBLE / calls, 6) END AS error_rate,
  CASE WHEN facts > 0 THEN round(facts_seen::DOUBLE / facts, 6) END AS fact_recall, CASE WHEN emitted > 0 THEN round(covered::DOUBLE / emitted, 6) END AS cite_precision, CASE WHEN facts > 0 THEN round(facts_cited::DOUBLE / facts, 6) END AS cite_recall, CASE WHEN retrieves > 0 THEN round(coalesce(facts_seen, 0)::DOUBLE / retrieves, 6) END AS efficiency
  FROM o LEFT JOIN p USING (transcript))"""


def _agent_scores(spark, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    tool = F.when(kind.isin("view", "error"), S.RETRIEVE).when(kind == "click", "open").when(kind == "purchase", S.CITE).otherwise(S.REFUSE)
    target = F.when(kind != "signup", F.get_json_object("props", "$.k").cast("long") % 10)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    calls = saved(table(spark, sf_dir, "events").select(F.col("user_id").alias("transcript"), n.alias("n"), tool.alias("tool"), target.alias("target"), (kind == "error").alias("failed")))
    return S.score_transcripts(calls, calls.where(F.col("tool") == S.CITE).select("transcript", "target"))


@query(f"WITH {_CALLS_SQL} SELECT * FROM s")
def agent_scores(spark, sf_dir: str) -> DataFrame:
    """A transcript's calls, retries, first tries, facts seen, sufficiency and cites (a user's events stand for its calls)."""
    return _agent_scores(spark, sf_dir)


_MEASURES_SQL = ", ".join(["count(*) AS transcripts", *(f"round(avg({c}), 6) AS mean_{c}" for c in S.MEANS), "round(sum(covered) / sum(emitted), 6) AS pooled_cite_precision", "round(sum(facts_cited) / sum(facts), 6) AS pooled_cite_recall", "round(sum(facts_seen) / sum(facts), 6) AS pooled_fact_recall", "round(avg(refused::INT), 6) AS refusal_rate", "round(avg(answered::INT), 6) AS answer_rate", "round(avg((sufficient_at IS NOT NULL)::INT), 6) AS sufficient_rate", "round(count(*) FILTER (refused AND facts_seen = 0)::DOUBLE / count(*) FILTER (refused), 6) AS refusal_precision"])


@query(f"WITH {_CALLS_SQL} SELECT CASE WHEN transcript % 2 = 0 THEN 'even' ELSE 'odd' END AS set, {_MEASURES_SQL} FROM s GROUP BY 1 UNION ALL SELECT 'all', {_MEASURES_SQL} FROM s")
def agent_summary(spark, sf_dir: str) -> DataFrame:
    """Means, ratios of sums and rates over a run's transcripts, over all and by set."""
    scores = saved(_agent_scores(spark, sf_dir).withColumn("set", F.when(F.col("transcript") % 2 == 0, "even").otherwise("odd")))
    return S.run_summary(scores, "set").unionByName(S.run_summary(scores).withColumn("set", F.lit("all")))
