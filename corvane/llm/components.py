"""Connected components of an edge table, by rounds of star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import checkpointed

CLOSE_EDGES = 200_000  # 3 MB


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the smallest node that each reaches through them: labels spread and jump."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return nodes, nodes[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def forest(held: list) -> tuple[np.ndarray, np.ndarray]:
        nodes, roots = local_roots(*(np.concatenate(x) for x in zip(*held)))
        other = nodes != roots
        return nodes[other], roots[other]

    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size > 1_000_000:  # a forest has fewer edges than nodes: what is held stays bounded by the nodes seen
            held = [forest(held)]
            size = 0
    if held:
        a, b = forest(held)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if held:
        nodes, roots = local_roots(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of the undirected edges ``a, b`` (longs); component is the smallest node reached.

    Loops, repeated edges and rows with a null end add nothing (a node with a loop alone isn't returned).
    Each partition contracts its own edges to a forest. If these hold at most ``CLOSE_EDGES`` edges together (a count says so),
    one task closes them; else rounds of large and small stars go on until none changes, linear in the edges and about
    log(nodes) many. Both give the same rows.
    """
    live = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    now = checkpointed(live.mapInArrow(_contract, "a long, b long").distinct())
    if now.count() <= CLOSE_EDGES:
        return checkpointed(now.coalesce(1).mapInArrow(_closed, "node long, component long"))
    before = None
    while True:
        # Large star: each neighbour above a node is tied to the smallest around it.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = checkpointed(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = mark
