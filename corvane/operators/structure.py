"""Document structuring: outlines, greedy packing, forward fill and table assembly."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.sources.shared import saved


def forward_fill(df: DataFrame, by: str, order: list[str], value: Column, out: str) -> DataFrame:
    """The last non-null value before or at each row; rows before the first have none."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def sections(df: DataFrame, by: str, order: str, heading: Column, out: str = "section") -> DataFrame:
    """A running section number: each heading begins one; what is before the first is section 0."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(heading.cast("int")).over(w))


def nearest_ancestors(df: DataFrame, by: str, order: str, level: Column, deepest: int) -> DataFrame:
    """``parent``: the order of the last row above with a smaller level than the row's own (null: none).

    The last place of each level is kept by a window; levels are few, so the greatest of those below decides.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_at{k}": F.max(F.when(level == k, F.col(order))).over(w) for k in range(1, deepest)})
    above = [F.when(level > k, F.col(f"_at{k}")) for k in range(1, deepest)]
    return df.withColumn("parent", F.greatest(F.lit(None).cast("int"), *above)).drop(*[f"_at{k}" for k in range(1, deepest)])


def greedy_pack(df: DataFrame, by: str, order: str, size: str, target: int) -> DataFrame:
    """Add ``bin`` by running sums: a row goes into the open bin unless that would exceed ``target``; larger rows are alone.

    The sums depend on where the last bin ended, so rows are dealt by group and sorted, and pass one after the other: no group is
    held, however long. A null size counts as 0; a null group is a group.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("bin", T.LongType())])
    names = schema.fieldNames()
    group_at, size_at = df.columns.index(by), df.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bin_, used = object(), 0, 0
        for batch in batches:
            out = []
            for group, n in zip(batch.column(group_at).to_pylist(), batch.column(size_at).to_pylist()):
                n = n or 0
                if group != now:
                    now, bin_, used = group, 0, n
                elif used > 0 and used + n > target:
                    bin_, used = bin_ + 1, n
                else:
                    used += n
                out.append(bin_)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=names)

    return df.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)


def outline_paths(nodes: DataFrame, by: str, order: str, parent: str) -> DataFrame:
    """``by, order, path``: the orders from a root down to each node, by pointer jumping: every round doubles the part of the path that is known."""
    now = saved(nodes.select(by, order, F.col(parent).alias("_up"), F.array(order).alias("path")))
    while not now.where("_up IS NOT NULL").isEmpty():
        above = now.select(by, F.col(order).alias("_up"), F.col("_up").alias("_far"), F.col("path").alias("_above"))
        met = now.join(above, [by, "_up"], "left")
        now = saved(met.select(by, order, F.col("_far").alias("_up"), F.when(F.col("_above").isNull(), F.col("path")).otherwise(F.concat("_above", "path")).alias("path")))
    return now.select(by, order, "path")


def deepest_matches(paths: DataFrame, hits: DataFrame, by: str, order: str, query: str) -> DataFrame:
    """``query, by, path``: of the nodes that a query hits (``query, by, order``) the path of the deepest, the first of equal depth."""
    met = hits.join(paths, [by, order])
    return met.groupBy(query, by).agg(F.min_by("path", F.struct(-F.size("path"), order)).alias("path"))
