"""Scores of agent runs: one row a transcript from its tool calls and facts, and a run's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.shared import saved

RETRIEVE, CITE, REFUSE = "retrieve", "cite", "refuse"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 6))


def score_transcripts(calls: DataFrame, facts: DataFrame) -> DataFrame:
    """One row a transcript of ``transcript, n, tool, target, failed`` (calls, n their order); ``facts``: transcript, target that the answer should rest on.

    First tries are of targets, a retry is a call to a target of which an earlier call failed. A fact is seen from the first retrieve of its target that didn't fail;
    the run is sufficient from the retrieve on by which all are seen, and what it retrieves after is surplus. A cite is covered if its target was seen before it; precision
    is of distinct cited targets, recall of facts. Ratios without a denominator are null.
    """
    by_target = Window.partitionBy("transcript", "target").orderBy("n")
    before = by_target.rowsBetween(Window.unboundedPreceding, -1)
    seen = (F.col("tool") == RETRIEVE) & ~F.col("failed")
    rows = calls.withColumns({
        "_first": F.row_number().over(by_target) == 1,
        "_again": F.coalesce(F.max(F.col("failed").cast("int")).over(before), F.lit(0)) == 1,
        "_seen": F.coalesce(F.max(seen.cast("int")).over(before), F.lit(0)) == 1,
    })
    rows = saved(rows)
    named = F.col("target").isNotNull()
    cite = F.col("tool") == CITE
    own = rows.groupBy("transcript").agg(
        F.count("*").alias("calls"), F.count_if(F.col("tool") == RETRIEVE).alias("retrieves"), F.count_if("failed").alias("errors"),
        F.count_distinct(F.when(named, F.col("target"))).alias("targets"), F.count_if(named & F.col("_first") & ~F.col("failed")).alias("_clean"), F.count_if(named & F.col("_again")).alias("retries"), F.count_if(named & F.col("_again") & ~F.col("failed")).alias("recovered"),
        F.count_if(cite).alias("cites"), F.count_distinct(F.when(cite, F.col("target"))).alias("emitted"), F.count_distinct(F.when(cite & F.col("_seen"), F.col("target"))).alias("covered"),
        (F.count_if(F.col("tool") == REFUSE) > 0).alias("refused"), F.max(F.when(cite, F.col("n"))).alias("_last_cite"), F.max("n").alias("_last"),
    )
    wanted = facts.select("transcript", "target").distinct()
    first = rows.where(seen).groupBy("transcript", "target").agg(F.min("n").alias("_at"))
    cited = rows.where(cite & F.col("_seen")).select("transcript", "target", F.lit(1).alias("_cited")).distinct()
    met = wanted.join(first, ["transcript", "target"], "left").join(cited, ["transcript", "target"], "left")
    per = met.groupBy("transcript").agg(F.count("*").alias("facts"), F.count("_at").alias("facts_seen"), F.count("_cited").alias("facts_cited"), F.when(F.count("_at") == F.count("*"), F.max("_at")).alias("sufficient_at"))
    surplus = rows.where(F.col("tool") == RETRIEVE).join(per.select("transcript", "sufficient_at"), "transcript").where(F.col("n") > F.col("sufficient_at")).groupBy("transcript").agg(F.count("*").alias("surplus"))
    out = own.join(per, "transcript", "left").join(surplus, "transcript", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("facts", "facts_seen", "facts_cited")}
    out = out.withColumns(zero).withColumn("surplus", F.when(F.col("sufficient_at").isNotNull(), F.coalesce("surplus", F.lit(0))))
    ratios = {
        "first_try_rate": _ratio(F.col("_clean"), F.col("targets")), "recovery_rate": _ratio(F.col("recovered"), F.col("retries")), "error_rate": _ratio(F.col("errors"), F.col("calls")),
        "fact_recall": _ratio(F.col("facts_seen"), F.col("facts")), "cite_precision": _ratio(F.col("covered"), F.greatest("emitted", "covered")), "cite_recall": _ratio(F.col("facts_cited"), F.col("facts")),
        "efficiency": _ratio(F.col("facts_seen"), F.col("retrieves")), "answered": F.coalesce(F.col("_last_cite") == F.col("_last"), F.lit(False)),
    }
    return out.withColumns(ratios).drop("_clean", "_last_cite", "_last")


MEANS = ["calls", "retrieves", "errors", "targets", "retries", "first_try_rate", "recovery_rate", "error_rate", "fact_recall", "cite_precision", "cite_recall", "efficiency", "surplus"]


def run_summary(scores: DataFrame, by: str | None = None) -> DataFrame:
    """Means (nulls skipped), ratios of sums and rates of transcripts' scores, over all or by a column."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    measures = [F.count("*").alias("transcripts"), *(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in MEANS)]
    measures += [_ratio(F.sum("covered"), F.sum("emitted")).alias("pooled_cite_precision"), _ratio(F.sum("facts_cited"), F.sum("facts")).alias("pooled_cite_recall"), _ratio(F.sum("facts_seen"), F.sum("facts")).alias("pooled_fact_recall")]
    measures += [rate("refused").alias("refusal_rate"), rate("answered").alias("answer_rate"), F.round(F.avg(F.col("sufficient_at").isNotNull().cast("int")), 6).alias("sufficient_rate"), _ratio(F.count_if(F.col("refused") & (F.col("facts_seen") == 0)), F.count_if("refused")).alias("refusal_precision")]
    return scores.groupBy(by).agg(*measures) if by else scores.agg(*measures)
