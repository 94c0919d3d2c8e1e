"""Operator 3: near-duplicate embeddings by a random-projection tree forest.

Each label's vectors are split again and again by random projections. A cut has a band to both sides, as wide as a share of
what two linked vectors differ by in a projection; vectors within it go to both children (spill). Of several cuts about the
median the one with fewest vectors in its band is taken, and a node is a leaf when every cut has most of it there:
it is a dense cluster, which further splits would only copy. Many trees with other projections make it likely that near
vectors share a leaf. The trees are fitted on a bounded sample; below the nodes that the sample can split, cuts follow
from the quantiles of the node's sample, with a narrower band, so that leaves stay small however many vectors there are; each such
level parts some near pairs, so a label gets more trees the more levels it takes.
Every vector is routed through all trees. Pairs are compared within leaves, counted in the first leaf
that they share, and the links are united.

Equal vectors are one node. A leaf that is too large for one task is compared in blocks, each pair of blocks a
task, so no leaf size is a limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import read_table, released, saved
from corvane.llm.components import connected_components, local_roots

MAX_SAMPLE = 20_000  # vectors the trees are fitted on (in expectation)
TREES = 6  # at least; more for labels that are split more often (see trees_for)
LEAF = 500  # vectors a leaf should hold
# Of one tree, measured on pairs at a cosine of 0.93 to 0.95: the share that has a leaf in common after 8 levels, and what each further level leaves of it.
SHARED_AT_8, SHARED_A_LEVEL = 0.62, 0.935
RECALL = 0.95  # that the trees together are meant to reach
LEAST_IN_NODE = 32  # sampled vectors that a node must hold to be split by their own cut
BAND = 0.35  # half a band's width, in standard deviations of what linked vectors differ by in a projection
DEEP_OVERLAP = 0.03  # below sampled nodes: share of the sample on each side of the median within the band
MOST_COPIED = 1.5  # both children of a node hold at most so many times its vectors
MAX_DEPTH = 40
BLOCK = 1024
BROADCAST_ROWS = 100_000


def unit_rows(raw: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Vectors of one length given as bytes, as rows of length 1 in double precision."""
    x = np.stack([np.frombuffer(r, kind) for r in raw.to_pylist()]).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable_vectors(df: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, str]:
    """``vec_id, label, raw``: raw is the vector's bytes (null if it can't be linked), and the kind of its numbers."""
    single = isinstance(df.schema[embedding].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for v, lab in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                good = lab is not None and v is not None and len(v) > 0 and None not in v
                x = np.array(v, kind) + np.zeros(1, kind) if good else None  # + 0: -0 and 0 are equal
                raw.append(x.tobytes() if good and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(raw, pa.binary())], names=["vec_id", "label", "raw"])

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{'float' if single else 'double'}>").alias("v"), F.col(label).cast("string").alias("label"))
    return rows.mapInArrow(released(run), "vec_id long, label string, raw binary"), kind


def trees_for(count: int) -> int:
    """Trees that find ``RECALL`` of the pairs just over the limit among so many vectors of a label."""
    levels = max(np.log2(max(count, 1) / LEAF), 8)
    one = SHARED_AT_8 * SHARED_A_LEVEL ** (levels - 8)
    return max(TREES, int(np.ceil(np.log(1 - RECALL) / np.log(1 - one))))


class Forest:
    """Cuts by (label, dimension), tree and path. The direction at each depth of a tree is the same in all its nodes."""

    def __init__(self, limit: float) -> None:
        self.limit = limit
        self.cuts: dict[tuple[Any, int, int], tuple[float, float]] = {}
        self.trees: dict[Any, int] = {}
        self.deep: dict[tuple[Any, int, int], tuple[np.ndarray, np.ndarray]] = {}  # of unsplit sampled nodes: a cut a level

    @staticmethod
    @lru_cache(maxsize=64)
    def directions(tree: int, size: int) -> np.ndarray:
        ways = np.random.default_rng([tree, size]).standard_normal((MAX_DEPTH, size))
        return ways / np.linalg.norm(ways, axis=1, keepdims=True)

    @staticmethod
    def cut(at: np.ndarray, half: float) -> tuple[float, float] | None:
        """The band about the cut that fewest values lie in; none if too many would be in both children."""
        at = np.sort(at)
        middle = np.quantile(at, np.linspace(0.3, 0.7, 9))
        low, high = np.searchsorted(at, middle - half, "left"), np.searchsorted(at, middle + half, "right")
        both = high - low + 0.2 * np.abs(np.linspace(0.3, 0.7, 9) - 0.5) * len(at)
        k = int(both.argmin())
        if max(len(at) - low[k], high[k]) >= 0.9 * len(at) or len(at) + high[k] - low[k] > MOST_COPIED * len(at):
            return None
        return float(middle[k] - half), float(middle[k] + half)

    def grow(self, kind: tuple[str, int], sample: np.ndarray, count: int) -> None:
        """Split until ``count`` vectors of which ``sample`` are some would lie in leaves of about ``LEAF``."""
        half = BAND * np.sqrt(2 * (1 - self.limit) / kind[1])
        scale = count / len(sample)
        self.trees[kind] = trees_for(count)
        for tree in range(self.trees[kind]):
            at = sample @ self.directions(tree, kind[1]).T
            todo = [(1, 0, np.arange(len(sample)))]
            while todo:
                path, depth, own = todo.pop()
                if len(own) * scale <= LEAF or depth >= MAX_DEPTH:
                    continue
                if len(own) < LEAST_IN_NODE:
                    more = min(int(np.ceil(np.log2(len(own) * scale / LEAF))), MAX_DEPTH - depth)
                    bands = np.quantile(at[own, depth : depth + more], [0.5 - DEEP_OVERLAP, 0.5 + DEEP_OVERLAP], axis=0)
                    self.deep[kind, tree, path] = bands[0], bands[1]
                    continue
                if (band := self.cut(at[own, depth], half)) is None:
                    continue
                self.cuts[kind, tree, path] = band
                todo += [(2 * path, depth + 1, own[at[own, depth] <= band[1]]), (2 * path + 1, depth + 1, own[at[own, depth] >= band[0]])]

    def leaves(self, kind: tuple[str, int], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each row reaches; a leaf is ``tree << 48 | path``."""
        rows, leaves = [], []
        for tree in range(self.trees.get(kind, 1)):
            if (kind, tree, 1) not in self.cuts and (kind, tree, 1) not in self.deep:
                if not tree:  # the label is one leaf: one tree is enough
                    return np.arange(len(x)), np.full(len(x), 1)
                continue
            at = x @ self.directions(tree, kind[1]).T
            todo = [(1, 0, np.arange(len(x)))]
            while todo:
                path, depth, own = todo.pop()
                if not len(own):
                    continue
                if (band := self.cuts.get((kind, tree, path))) is not None:
                    here = at[own, depth]
                    todo += [(2 * path, depth + 1, own[here <= band[1]]), (2 * path + 1, depth + 1, own[here >= band[0]])]
                    continue
                paths = np.full(len(own), path)
                for low, high in zip(*self.deep.get((kind, tree, path), ((), ()))):
                    here = at[own, depth]
                    left, right = here <= high, here >= low
                    own, paths, depth = np.concatenate([own[left], own[right]]), np.concatenate([2 * paths[left], 2 * paths[right] + 1]), depth + 1
                rows.append(own)
                leaves.append(paths | tree << 48)
        return np.concatenate(rows), np.concatenate(leaves)


def fit_forest(nodes: DataFrame, number: str, limit: float, max_sample: int | None = None) -> Forest:
    """Grow the trees from a sample of ``label, size, raw`` by hash, with at most ``max_sample`` rows in expectation.

    Labels of at most ``LEAF`` vectors are one leaf and not sampled: at most (vectors / LEAF) counts come to the driver.
    """
    counts = nodes.groupBy("label", "size").count().where(F.col("count") > LEAF)
    known = counts.collect()
    total = sum(r["count"] for r in known)
    forest = Forest(limit)
    if not total:
        return forest
    part = min(1.0, (max_sample or MAX_SAMPLE) / total)
    drawn = nodes.where(F.pmod(F.xxhash64("raw"), F.lit(1_000_003)) < part * 1_000_003).join(counts.select("label", "size"), ["label", "size"], "left_semi")
    got = drawn.select("label", "size", "raw").orderBy("label", "size", "raw").toArrow()
    kinds: dict[tuple[str, int], list[int]] = {}
    for i, k in enumerate(zip(got.column("label").to_pylist(), got.column("size").to_pylist())):
        kinds.setdefault(k, []).append(i)
    for r in known:
        if own := kinds.get((r["label"], r["size"])):
            forest.grow((r["label"], r["size"]), unit_rows(got.column("raw").take(pa.array(own)), number), r["count"])
    return forest


def in_leaves(nodes: DataFrame, forest: Forest, number: str, with_vectors: bool) -> DataFrame:
    """One row per node and leaf; with vectors also the node's vector, copies and all its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, sizes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows_of: dict[tuple[str, int], list[int]] = {}
            for i, kind in enumerate(zip(labels, sizes)):
                rows_of.setdefault(kind, []).append(i)
            for kind, members in rows_of.items():
                own = np.array(members)
                raw = batch.column(3).take(pa.array(own))
                row, leaf = forest.leaves(kind, unit_rows(raw, number))
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                arrays = [batch.column(0).take(pa.array(own[row])), pa.array([kind[0]] * len(row), pa.string()), pa.array(np.full(len(row), kind[1]), pa.int32()), pa.array(leaf)]
                if with_vectors:
                    held = [x.tobytes() for x in np.split(leaf, np.flatnonzero(row[1:] != row[:-1]) + 1)]
                    arrays += [raw.take(pa.array(row)), batch.column(4).take(pa.array(own[row])), pa.array(held, pa.binary()).take(pa.array(row))]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "label", "size", "leaf", "raw", "copies", "leaves"][: len(arrays)])

    schema = "node long, label string, size int, leaf long" + (", raw binary, copies long, leaves binary" if with_vectors else "")
    return nodes.select("node", "label", "size", "raw", "copies").mapInArrow(released(run), schema)


def compare(table: pa.Table, limit: float, number: str) -> pa.Table:
    """``node, links, root`` for one leaf or a pair of its blocks: copies linked for the first time here, and the smallest node reached."""
    node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
    leaf = table.column("leaf")[0].as_py()
    x = unit_rows(table.column("raw"), number)
    # A pair counts here unless it shares an earlier leaf: told by what earlier leaves each row is in.
    earlier = [np.frombuffer(b, np.int64) for b in table.column("leaves").to_pylist()]
    kinds: dict[bytes, int] = {}
    kind = np.array([kinds.setdefault(e[e < leaf].tobytes(), len(kinds)) for e in earlier])
    sets = [set(np.frombuffer(k, np.int64).tolist()) for k in kinds]
    two = block.min() != block.max()
    first = np.flatnonzero(block == block.min())
    second = np.flatnonzero(block == block.max()) if two else first
    links, ends = np.zeros(len(node), np.int64), []
    for at in range(0, len(first), 256):
        rows = first[at : at + 256]
        i, j = np.nonzero(x[rows] @ x[second].T >= limit)
        i, j = rows[i], second[j]
        if not two:
            i, j = i[i < j], j[i < j]
        ends.append(np.stack([i, j]))
        pair, which = np.unique(kind[i] * len(sets) + kind[j], return_inverse=True)
        new = np.array([sets[p // len(sets)].isdisjoint(sets[p % len(sets)]) for p in pair.tolist()], bool)[which]
        links += np.bincount(i[new], weights=copies[j[new]], minlength=len(node)).astype(np.int64)
        links += np.bincount(j[new], weights=copies[i[new]], minlength=len(node)).astype(np.int64)
    i, j = np.concatenate(ends, 1)
    root = node.copy()
    if len(i):
        named, roots = local_roots(node[i], node[j])
        spot = np.minimum(np.searchsorted(named, node), len(named) - 1)
        root = np.where(named[spot] == node, roots[spot], node)
    some = (links > 0) | (root != node)
    return pa.table({"node": node[some], "links": links[some], "root": root[some]})


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", limit: float = 0.93) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels are linked when their cosine in double precision is at least ``limit``. A null,
    zero or empty vector, one with null or non-finite components, or a row of null vec_id is linked with nothing. Vectors
    of different dimensions are never linked. Repeated rows, and several vectors under one id, are vectors each and link
    with one another. component_id is the smallest vec_id reached; kept
    means that it is the row's own (also for a null id, which has a null component). An empty table gives an empty one; other columns are ignored.
    """
    rows, number = usable_vectors(df, vec_id, embedding, label)
    rows = saved(rows)
    live = rows.where(F.col("raw").isNotNull() & F.col("vec_id").isNotNull())
    distinct = live.groupBy("label", "raw").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    # Written with their numbers, so that these stay.
    nodes = saved(distinct.select(F.monotonically_increasing_id().alias("node"), "label", (F.octet_length("raw") / int(number[-1])).cast("int").alias("size"), "raw", "copies", "first_id"))
    forest = fit_forest(nodes, number, limit)
    sizes = in_leaves(nodes, forest, number, False).groupBy("label", "size", "leaf").count().where(F.col("count") > BLOCK)
    large = saved(sizes.select("label", "size", "leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    if large.count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    spread = in_leaves(nodes, forest, number, True).join(large, ["label", "size", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("block", F.pmod(F.hash("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    found = saved(spread.groupBy("label", "size", "leaf", "low", "high").applyInArrow(lambda table: compare(table, limit, number), "node long, links long, root long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = nodes.join(counts, "node", "left").join(reached, "node", "left").select("label", "raw", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = whole.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_vector = whole.join(least, "component").select("label", "raw", "n_links", "component_id")
    linked = live.join(by_vector, ["label", "raw"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("raw").isNull() | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), n AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
), c AS (
  SELECT a, min(b) AS low FROM reach GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id, vec_id <= coalesce(c.low, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
