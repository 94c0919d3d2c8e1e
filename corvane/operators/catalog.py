"""Catalogs, job records and the small joins around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def translated_filters(asked: DataFrame, members: DataFrame) -> DataFrame:
    """``request, slugs, years`` of requests with ``families`` and ``years``: families become their distinct members, year 0 goes."""
    slugs = asked.select("request", F.explode("families").alias("family")).join(members, "family").groupBy("request").agg(F.array_sort(F.collect_set("slug")).alias("slugs"))
    years = F.array_sort(F.array_distinct(F.filter("years", lambda y: y != 0)))
    return asked.select("request", years.alias("years")).join(slugs, "request")


def attention_reasons(jobs: DataFrame, attempts: DataFrame, failed: str, live: str, limit: float) -> DataFrame:
    """``job, reason``: held_out (failed and held out), swapped (live, and the first of several attempts isn't the kept one), degraded
    (live, and the last attempt of the kept extractor left more than ``limit`` unlabelled).

    ``jobs``: job, state, held_out; ``attempts``: job, i, extractor, unlabelled, coverage. The kept extractor is that of the best
    coverage, the earlier one of equals.
    """
    tried = attempts.groupBy("job").agg(F.count("*").alias("n"), F.min_by("extractor", "i").alias("first"), F.max_by("extractor", F.struct("coverage", (-F.col("i")).alias("i"))).alias("kept"))
    share = attempts.join(tried.select("job", F.col("kept").alias("extractor")), ["job", "extractor"]).groupBy("job").agg(F.max_by("unlabelled", "i").alias("share"))
    running = jobs.where(F.col("state") == live)
    held = jobs.where((F.col("state") == failed) & F.col("held_out")).select("job", F.lit("held_out").alias("reason"))
    swapped = running.join(tried, "job").where((F.col("n") >= 2) & (F.col("first") != F.col("kept"))).select("job", F.lit("swapped").alias("reason"))
    degraded = running.join(share, "job").where(F.col("share") > limit).select("job", F.lit("degraded").alias("reason"))
    return held.unionByName(swapped).unionByName(degraded)


def duplicate_probe(rows: DataFrame, key: str, content: str, live: str) -> DataFrame:
    """``key, duplicate_of, live``: for each row another one of equal content, a live one first, then by key.

    The two best rows of each content answer for all: a row takes the first that isn't itself.
    """
    w = Window.partitionBy(content).orderBy(F.desc(live), key)
    best = rows.withColumn("_n", F.row_number().over(w)).where("_n <= 2").groupBy(content).agg(F.min_by(F.struct(key, live), "_n").alias("_one"), F.max_by(F.struct(key, live), "_n").alias("_two"), F.count("*").alias("_m")).where("_m = 2")
    pick = F.when(F.col("_one")[key] != F.col(key), F.col("_one")).otherwise(F.col("_two"))
    return rows.select(key, content).join(best, content).select(key, pick.alias("_p")).select(key, F.col("_p")[key].alias("duplicate_of"), F.col("_p")[live].alias(live))


def cache_states(current: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """``key, state, current``: hit (stored hash equals the current one), stale, or missing."""
    joined = current.join(cache.withColumn("_held", F.lit(True)), key, "left")
    state = F.when(F.col("_held").isNull(), "missing").when(~F.col("stored").eqNullSafe(F.col("current")), "stale").otherwise("hit")
    return joined.select(key, state.alias("state"), "current")


def batch_outcomes(inputs: DataFrame, outputs: DataFrame, key: str, known: str) -> DataFrame:
    """``key, outcome, pages``: what is known beforehand, else ``pages`` if some were produced, else ``error``. One row an input."""
    made = outputs.groupBy(key).agg(F.count("*").alias("pages"))
    return inputs.join(made, key, "left").select(key, F.coalesce(F.col(known), F.when(F.col("pages") > 0, "pages"), F.lit("error")).alias("outcome"), F.coalesce("pages", F.lit(0)).alias("pages"))


def swept(jobs: DataFrame, terminal: Column) -> DataFrame:
    """Jobs with ``archived``: a null or other state stays in the queue. Sweeping again changes nothing."""
    return jobs.withColumn("archived", F.coalesce(terminal, F.lit(False)))


def year_of(year: Column, key: Column) -> Column:
    return F.coalesce(year.cast("int"), F.nullif(F.regexp_extract(key, r"-fy(\d{4})", 1), F.lit("")).cast("int"))


def quantised_dot(a: Column, b: Column) -> Column:
    """Dot product of vectors kept as integers of 127ths."""
    whole = lambda v: F.transform(v, lambda x: F.round(x.cast("double") * 127))
    return F.aggregate(F.zip_with(whole(a), whole(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v) / 16129.0
