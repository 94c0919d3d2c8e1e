"""Evaluation metrics over ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_matches(results: DataFrame, expected: DataFrame) -> DataFrame:
    """``query_id, expected_id, rank``: where each expected id first stands in its query's results (null: nowhere)."""
    hit = results.select("query_id", F.col("chunk_id").alias("expected_id"), "rank")
    return expected.join(hit, ["query_id", "expected_id"], "left").groupBy("query_id", "expected_id").agg(F.min("rank").alias("rank"))


def lookup_and_comparison(matches: DataFrame) -> DataFrame:
    """Per query: the first rank of any expected id, and the last of all of them (null unless all are found)."""
    return matches.groupBy("query_id").agg(F.min("rank").alias("lookup_rank"), F.when(F.count("rank") == F.count("*"), F.max("rank")).alias("comparison_rank"), F.count("*").alias("expected"))


def recall_summary(scored: DataFrame, cuts: list[int], by: str) -> DataFrame:
    """Share of queries whose expected id is within each cut, for each type and over all (grouping sets)."""
    aggs = [F.round(F.avg(F.when(F.col("lookup_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in cuts]
    return scored.rollup(by).agg(F.count("*").alias("n"), *aggs)


def concordance(results: DataFrame, year: str = "fiscal_year") -> DataFrame:
    """Newest-first rates: over all dated pairs in rank order, ties apart (null if none), and over adjacent pairs, ties in order (1 if fewer than two)."""
    dated = results.where(F.col(year).isNotNull())
    a = dated.select("query_id", F.col("rank").alias("i"), F.col(year).alias("yi"))
    b = dated.select("query_id", F.col("rank").alias("j"), F.col(year).alias("yj"))
    # Pools are cut to a fixed number of ranks, so the pairs of a query are bounded.
    pairs = a.join(b, "query_id").where("i < j").groupBy("query_id").agg(F.round(F.sum((F.col("yi") > F.col("yj")).cast("int")) / F.nullif(F.sum((F.col("yi") != F.col("yj")).cast("int")), F.lit(0)), 6).alias("all_pairs"))
    w = Window.partitionBy("query_id").orderBy("rank")
    step = F.lead(year).over(w)
    near = dated.withColumn("_ok", F.when(step.isNotNull(), (F.col(year) >= step).cast("double"))).groupBy("query_id").agg(F.round(F.coalesce(F.avg("_ok"), F.lit(1.0)), 6).alias("adjacent"))
    return near.join(pairs, "query_id", "left")


def threshold_sweep(scored: DataFrame, thresholds: DataFrame, score: str, positive: str) -> DataFrame:
    """For each threshold: true and false positives of 'score below it', precision, recall and pass rate.

    Scores are first counted by value, so what meets the thresholds is their distinct values.
    """
    counts = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("int")).alias("p"), F.count("*").alias("n"))
    total = F.sum("p"), F.sum("n")
    grid = counts.join(F.broadcast(thresholds), F.lit(True)).groupBy("threshold").agg(F.sum(F.when(F.col("s") < F.col("threshold"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("s") < F.col("threshold"), F.col("n") - F.col("p")).otherwise(0)).alias("fp"), total[0].alias("pos"), total[1].alias("all"))
    return grid.select("threshold", "tp", "fp", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 6).alias("precision"), F.round(F.col("tp") / F.nullif("pos", F.lit(0)), 6).alias("recall"), F.round((F.col("all") - F.col("tp") - F.col("fp")) / F.col("all"), 6).alias("pass_rate"))
