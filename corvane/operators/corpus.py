"""Corpus analytics: listings, coverage, label audits, change sets and key-wise maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def values_by_chunk(rows: DataFrame, value: str, doc: str = "doc_id") -> DataFrame:
    """Chunks per value, and the document that has most of them (ties: the lowest id)."""
    per = rows.groupBy(value, doc).agg(F.count("*").alias("n"))
    return per.groupBy(value).agg(F.sum("n").alias("n_chunks"), F.min_by(doc, F.struct(-F.col("n"), F.col(doc))).alias("sample_doc"))


def year_gaps(years: Column) -> Column:
    """Years missing between the first and the last of an array."""
    return F.array_except(F.sequence(F.array_min(years), F.array_max(years)), years)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``old`` with ``new`` put over it; of several new rows of a key the last by ``order`` counts."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    last = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def change_set(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value differs, null-safe: ``key, before, after``."""
    joined = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key)
    return joined.where(~F.col("before").eqNullSafe(F.col("after")))


def full_comparison(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Declared against found: same, changed, missing or orphan."""
    a, b = left.select(key, F.col(value).alias("a")), right.select(key, F.col(value).alias("b"))
    state = F.when(F.col("a").isNull(), "orphan").when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def letter_share(text: Column) -> Column:
    """Letters among the characters that aren't blank."""
    return F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.nullif(F.length(F.regexp_replace(text, r"[ \t\n\x0B\f\r]", "")), F.lit(0))


def ranked_percentile(values: Column, share: float) -> Column:
    """Element floor((n - 1) * share) of the sorted array: the lower nearest rank."""
    return F.get(F.array_sort(values), F.floor((F.size(values) - 1) * share).cast("int"))


def lower_percentile(df: DataFrame, by: str, value: str, share: float, out: str) -> DataFrame:
    """``by, out``: the lower nearest rank of each group, from counts of its distinct values: no group is held."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(by)
    ranked = counts.withColumns({"_upto": F.sum("_c").over(w.orderBy(value)), "_all": F.sum("_c").over(w)})
    return ranked.where(F.col("_upto") > F.floor((F.col("_all") - 1) * share)).groupBy(by).agg(F.min(value).alias(out))


def best_attempt(df: DataFrame, by: str, coverage: str, unlabelled: str, key: str, band: float = 0.75) -> DataFrame:
    """Among attempts within ``band`` of the best coverage the least unlabelled, then the best covered; ties by ``key``."""
    near = F.col(coverage) >= band * F.max(coverage).over(Window.partitionBy(by))
    w = Window.partitionBy(by).orderBy(F.col("_near").desc(), F.when(F.col("_near"), F.col(unlabelled)).asc_nulls_last(), F.desc(coverage), key)
    return df.withColumn("_near", near).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_near", "_n")


def stratified_sample(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """``n`` rows taken from all groups in turn, in an order fixed by a hash of the key."""
    w = Window.partitionBy(by).orderBy(F.md5(F.col(key).cast("string")))
    return df.withColumn("_turn", F.row_number().over(w)).orderBy("_turn", by).limit(n).drop("_turn")
