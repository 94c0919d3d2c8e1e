"""Operator 7: packing token sequences with a grouping genetic algorithm.

Pieces are dealt to shards at random (a shard is a bounded number of pieces, so their number follows the
data). Several islands evolve packings of each shard; after each epoch an island's best packing migrates to the
next island of its shard. A crossover injects whole well-filled bins of one parent into the other,
removes the bins that hold the same pieces, and best-fits the displaced ones. What poorly filled bins are
left in all shards is packed anew together.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bpe import encoder
from corvane.llm.common import checkpointed, partitions_for, read_table, released, row_groups, text_buffers

SHARD_ITEMS = 16384
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 12
POPULATION = 4
LOOSE_FILL = 0.97


def tokenized_pieces(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids`` (binary) and ``row_no``, a number of its own.

    A document is its ids and ``end_id``. If longer than ``max_tokens`` it is cut into pieces of that length of
    which the first may be shorter. A null or empty text gives one piece that holds ``end_id`` alone; a
    null ``doc_id`` stays null; repeated rows give pieces each.
    """
    key_type = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys = batch.column(0)
            data, offsets = text_buffers(batch.column(1))
            for a, b in row_groups(offsets, 1 << 20):
                got, at = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                got = got.astype("<u4")
                rows, piece, start, length, ids = [], [], [], [], []
                tail = np.array([end_id], "<u4").tobytes()
                for i in range(b - a):
                    own = got[at[i] : at[i + 1]].tobytes() + tail
                    n = len(own) // 4
                    edges = [0, *range((n - 1) % max_tokens + 1, n + 1, max_tokens)]
                    for k, (x, y) in enumerate(zip(edges, edges[1:])):
                        rows.append(a + i)
                        piece.append(k)
                        start.append(x)
                        length.append(y - x)
                        ids.append(own[4 * x : 4 * y])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(np.arange(number, number + len(rows)))], names=["doc_id", "piece", "start", "length", "ids", "row_no"])
                number += len(rows)

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(released(run, lambda: encoder(tokenizer_path).forget()), f"doc_id {key_type}, piece int, start long, length long, ids binary, row_no long")


class Room:
    """Open bins by their free space."""

    def __init__(self) -> None:
        self.free: list[int] = []
        self.bins: dict[int, list[int]] = {}

    def put(self, space: int, bin_: int) -> None:
        if space > 0:
            if not self.bins.get(space):
                insort(self.free, space)
                self.bins[space] = []
            self.bins[space].append(bin_)

    def take(self, size: int) -> tuple[int, int]:
        """The fullest bin that still holds ``size``; (0, -1) if none does."""
        k = bisect_left(self.free, size)
        if k == len(self.free):
            return 0, -1
        space = self.free[k]
        bin_ = self.bins[space].pop()
        if not self.bins[space]:
            del self.free[k]
        return space, bin_


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, free: dict[int, int], capacity: int) -> None:
    """Put the items of ``order``, one by one, where they leave least space; ``bins`` is filled in place."""
    room, new = Room(), max(free, default=-1) + 1
    for b, space in free.items():
        room.put(space, b)
    size = lengths.tolist()
    for i in order.tolist():
        space, b = room.take(size[i])
        if b < 0:
            space, b, new = capacity, new, new + 1
        bins[i] = b
        room.put(space - size[i], b)


def fill_of(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lengths)


def quality(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    fill = fill_of(lengths, bins) / capacity
    return -int((fill > 0).sum()), float((fill**2).sum())


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = fill_of(lengths, b)
    full = np.flatnonzero(fill >= np.quantile(fill[fill > 0], 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[full[rng.random(len(full)) < 0.5]] = True
    injected = chosen[b]
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[injected]] = True  # bins of a that hold an injected piece
    loose = fill_of(lengths, a) < LOOSE_FILL * capacity
    broken |= loose[: len(broken)]
    displaced = broken[a] & ~injected
    child = a.copy()
    child[injected] = b[injected] + len(broken)
    kept = ~displaced
    _, child[kept] = np.unique(child[kept], return_inverse=True)
    free = dict(enumerate((capacity - fill_of(lengths[kept], child[kept])).astype(int).tolist())) if kept.any() else {}
    order = np.flatnonzero(displaced)
    noise = lengths[order] * (1 + 0.05 * rng.standard_normal(len(order)))
    best_fit(lengths, order[np.argsort(-noise, kind="stable")], child, free, capacity)
    return child


def evolve(lengths: np.ndarray, founders: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS) -> np.ndarray:
    """The best packing (item -> bin) after some generations; stops where no packing can have fewer bins."""
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // capacity)
    population = list(founders)
    while len(population) < POPULATION:
        bins = np.zeros(len(lengths), np.int64)
        noise = lengths * (1 + (0.02 * len(population)) * rng.standard_normal(len(lengths)))
        best_fit(lengths, np.argsort(-noise, kind="stable"), bins, {}, capacity)
        population.append(bins)
        if -quality(lengths, bins, capacity)[0] <= least:
            return bins
    scored = sorted(((quality(lengths, p, capacity), k, p) for k, p in enumerate(population)), reverse=True)
    for _ in range(generations):
        if -scored[0][0][0] <= least:
            break
        i, j = rng.permutation(len(scored))[:2]
        child = crossover(lengths, scored[min(i, j)][2], scored[max(i, j)][2], capacity, rng)
        scored = sorted([*scored, (quality(lengths, child, capacity), len(scored), child)], key=lambda x: x[0], reverse=True)[:POPULATION]
    return scored[0][2]


def migrated(state: DataFrame) -> DataFrame:
    """Every island keeps its best packing and gets its neighbour's; ``origin`` tells them apart."""
    return state.withColumn("origin", F.col("island")).withColumn("island", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))))


def pack(items: DataFrame, capacity: int = 2048, key: str = "row_no", length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that hold a unique ``key`` and a ``length`` of 0 to ``capacity``.

    Sequences hold at most ``capacity`` and have no gaps. Rows longer than ``capacity`` or of null length aren't
    placed (null ``sequence_id`` and ``offset``). Columns of these two names are replaced, all others kept. An empty table gives
    an empty one. ``items`` should be materialised: it is read more than once. Nothing is ever in one task but a shard
    (``SHARD_ITEMS`` rows) or the loose bins of 64 shards, hundreds of each at most.
    """
    slim = items.where(F.col(length).between(0, capacity)).select(F.col(key).alias("k"), F.col(length).cast("long").alias("n"))
    count = slim.count()
    shards = -(-count // SHARD_ITEMS) or 1
    spark = items.sparkSession
    width = partitions_for(spark, count * ISLANDS, 200_000)
    dealt = slim.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)).cast("long"))

    def epoch(key_: tuple, own: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key_[0]), int(key_[1])
        own = own.sort_values(["origin", "k"], kind="stable")
        parts = [p for _, p in own.groupby("origin", sort=True)]
        lengths = parts[0]["n"].to_numpy()
        founders = [p["bin"].to_numpy() for p in parts if p["origin"].iat[0] >= 0]
        bins = evolve(lengths, founders, capacity, (shard * 1009 + island) * 31 + int(own["epoch"].iat[0]))
        return pd.DataFrame({"shard": shard, "island": island, "k": parts[0]["k"].to_numpy(), "n": lengths, "bin": bins})

    def settle(key_: tuple, own: pd.DataFrame) -> pd.DataFrame:
        best = max((p for _, p in own.groupby("island", sort=True)), key=lambda p: quality(p["n"].to_numpy(), p["bin"].to_numpy(), capacity))
        return placed(best)

    def placed(best: pd.DataFrame) -> pd.DataFrame:
        best = best.sort_values(["bin", "k"], kind="stable")
        offset = best.groupby("bin")["n"].cumsum() - best["n"]
        fill = best.groupby("bin")["n"].transform("sum")
        return pd.DataFrame({"shard": best["shard"], "k": best["k"], "n": best["n"], "bin": best["bin"], "at": offset, "fill": fill})

    def again(key_: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("k", kind="stable")
        bins = evolve(own["n"].to_numpy(), [np.unique(own["shard"] * (1 << 32) + own["bin"], return_inverse=True)[1]], capacity, int(key_[0]))
        return placed(pd.DataFrame({"shard": -1 - int(key_[0]), "k": own["k"], "n": own["n"], "bin": bins}))

    state = dealt.withColumn("island", F.explode(F.array([F.lit(i) for i in range(ISLANDS)]))).withColumns({"bin": F.lit(0).cast("long"), "origin": F.lit(-1)})
    for e in range(EPOCHS):
        if e:
            state = migrated(state)
        state = state.withColumn("epoch", F.lit(e)).repartition(width, "shard", "island").groupBy("shard", "island").applyInPandas(epoch, "shard long, island int, k long, n long, bin long")
    schema = "shard long, k long, n long, bin long, at long, fill long"
    first = checkpointed(state.groupBy("shard").applyInPandas(settle, schema))
    loose = F.col("fill") < LOOSE_FILL * capacity
    rest = first.where(loose).withColumn("pool", F.floor(F.col("shard") / 64)).groupBy("pool").applyInPandas(again, schema)
    done = first.where(~loose).unionByName(rest)
    # Shards count from 0 and pools from -1 down: each gets numbers of its own.
    done = done.select(F.col("k").alias(key), (F.col("shard") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), F.col("at").alias("offset"))
    kept = [c for c in items.columns if c not in ("sequence_id", "offset")]
    return items.select(*kept).join(done, key, "left").select(*kept, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Pieces of the documents with the sequence and offset of each; of the ids their crc32 is kept.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (see ``tokenized_pieces`` for nulls and empty
    texts); other columns, of whatever names, are ignored. Repeated rows are packed each. An empty table gives an empty one.
    """
    pieces = tokenized_pieces(docs, tokenizer_path, max_tokens=capacity)
    items = checkpointed(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "row_no"))
    return pack(items, capacity).drop("row_no")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
