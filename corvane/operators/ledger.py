"""Usage ledgers, limits, job journals and windows over event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_month(ts: Column, hours: int = -7) -> Column:
    """Calendar month of a UTC time at a fixed offset."""
    return F.date_format(ts + F.expr(f"INTERVAL {hours} HOURS"), "yyyy-MM")


def usage_breakdown(usage: DataFrame, keys: list[str], cost: str, tokens: str) -> DataFrame:
    """Cost, tokens, rows and rows of unknown cost by each of ``keys`` (missing: ''), in one pass; ``dimension`` names the key."""
    filled = usage.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("key")) for k in keys])).alias("part")
    return filled.select(parts, F.col(cost).alias("_cost"), F.col(tokens).alias("_tokens")).groupBy("part.dimension", "part.key").agg(
        F.sum(F.coalesce("_cost", F.lit(0))).alias("cost"), F.sum(F.coalesce("_tokens", F.lit(0))).alias("tokens"), F.count("*").alias("n"), F.count_if(F.col("_cost").isNull()).alias("unknown_cost")
    )


def limit_status(used: Column, limit: Column, exempt: Column) -> Column:
    """allowed, warn (four fifths used) or blocked; no limit or an exempt user is allowed, a limit of 0 or less blocks."""
    return F.when(exempt | limit.isNull(), "allowed").when(limit <= 0, "blocked").when(used >= limit, "blocked").when(used >= F.lit(0.8) * limit, "warn").otherwise("allowed")


def islands(df: DataFrame, by: list[str], order: list[str], signature: Column, out: str = "segment") -> DataFrame:
    """Number the runs of rows of equal ``signature`` within ``by``, from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = ~signature.eqNullSafe(F.lag(signature).over(w)) & (F.row_number().over(w) > 1)
    return df.withColumn("_changed", changed.cast("int")).withColumn(out, F.sum("_changed").over(w)).drop("_changed")


def contiguous_ranges(df: DataFrame, by: str, number: str) -> DataFrame:
    """``by, start, end``: the runs of consecutive numbers."""
    w = Window.partitionBy(by).orderBy(number)
    return df.select(by, number).distinct().withColumn("_run", F.col(number) - F.row_number().over(w)).groupBy(by, "_run").agg(F.min(number).alias("start"), F.max(number).alias("end")).drop("_run")


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def context_window(messages: DataFrame, budget: int, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The newest messages of each conversation that fit the budget together; the newest always stays."""
    w = Window.partitionBy(conversation).orderBy(F.desc(turn))
    total = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumns({"used": total, "_n": F.row_number().over(w)}).where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n")
