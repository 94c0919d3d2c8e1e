"""Operator 5: scoring texts by context-tree weighting over bytes.

A text is its lower-cased words joined by single spaces and one end byte. Each byte is eight binary
decisions; each decision has a tree of contexts made of the bytes before it. Every node holds a
Krichevsky-Trofimov estimate, and a node's weighted probability is the mean of its own estimate's and the
product of its children's, so all depths up to ``DEPTH`` are mixed with weights that the training texts decide.

Counts are gathered per partition, merged by the two most recent bytes of the context, and stay in a table. Frequent pairs of
bytes, found on a bounded sample that decides nothing else, are dealt by three bytes; their own nodes are summed apart. Texts
are dealt to blocks of bounded size; a block asks for its distinct contexts and words and gets one number for each,
so neither model nor vocabulary is ever whole in one place. Only the nodes of depth 0 and 1 (255 * 257 at
most) and those of the frequent pairs (255 * ``HEAVY_PAIRS`` at most) go through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LOWER_ASCII, id_bucket, partitions_for, read_table, released, row_groups, saved, span_hashes, text_buffers, word_spans

DEPTH = 6
BLOCK_BYTES = 12 << 20
GROUP_BYTES = 2 << 20
PART_KEYS = 1_500_000
HEAVY_PAIRS = 512  # pairs of bytes with a larger share of the contexts than one in so many are dealt by three bytes
HEAVY_SAMPLE = 2_000  # documents, in expectation, on which they are found
END = 0x0A
PAIR = 1 << 32


# Texts to keys


def context_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bytes of the canonical texts, and how many each text has. A key is the context, latest byte first, then the byte."""
    pad = bytes([END]) * depth
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    x = np.frombuffer(b"".join([pad + t + bytes([END]) for t in texts]), np.uint8).astype(np.uint64)
    key = np.zeros(max(len(x) - depth, 0), np.uint64)
    for back in range(1, depth + 1):
        key = (key << np.uint64(8)) | x[depth - back : len(x) - back]
    key = (key << np.uint64(8)) | x[depth:]
    begin = np.cumsum(size + depth) - size - depth
    stop = np.cumsum(size)
    return key[np.repeat(begin - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)], size


def canonical(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = data.tobytes().lower()  # of bytes: A-Z alone
    return [b" ".join(raw[a:b].split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, at = word_spans(data, offsets)
    return span_hashes(LOWER_ASCII[data], starts, ends), np.diff(at)


def counted(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often (or with what weight) each is there."""
    if weight is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weight[order], first) if len(keys) else weight


def planes(numbers: np.ndarray) -> bytes:
    """64-bit integers by byte planes: of sorted keys and of small counts most planes are runs, which a shuffle compresses."""
    return np.ascontiguousarray(numbers.astype("<i8" if numbers.dtype.kind == "i" else "<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def looked_up(table_keys: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The values of keys that are all in the table: in the keys' order, so that the search walks through memory once."""
    order = np.argsort(keys)
    out = np.empty(len(keys))
    out[order] = values[np.searchsorted(table_keys, keys[order])]
    return out


# The tree


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up where it is exact enough."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that a Krichevsky-Trofimov estimator gives a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def weighted(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes, and the weight of their own estimate in what they predict."""
    total = np.logaddexp(own, children) - math.log(2)
    return total, np.exp(own - math.log(2) - total)


class Forest:
    """The nodes of depth 2 and more that the given keys (distinct, sorted) touch."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int) -> None:
        self.levels: list[dict] = []  # from the deepest up to depth 2
        level_keys, level_counts, up = keys, counts.astype(np.float64), np.arange(len(keys))
        for d in range(depth, 1, -1):
            bits = []
            for j in range(8):
                first = np.append(True, (level_keys[1:] >> np.uint64(8 - j)) != (level_keys[:-1] >> np.uint64(8 - j))) if len(level_keys) else np.zeros(0, bool)
                head = np.flatnonzero(first)
                bit = (level_keys >> np.uint64(7 - j)) & np.uint64(1)
                ones = np.add.reduceat(level_counts * bit, head) if len(head) else np.zeros(0)
                total = np.add.reduceat(level_counts, head) if len(head) else np.zeros(0)
                bits.append({"node": np.cumsum(first) - 1, "head": head, "bit": bit.astype(bool), "ones": ones, "zeros": total - ones, "own": log_kt(total - ones, ones)})
            self.levels.append({"keys": level_keys, "up": up, "bits": bits})
            if d > 2:  # the same keys without the oldest byte of their context
                short = ((level_keys >> np.uint64(16)) << np.uint64(8)) | (level_keys & np.uint64(255))
                up_keys, up = np.unique(short, return_inverse=True)
                level_counts = np.bincount(up, weights=level_counts, minlength=len(up_keys))
                level_keys = up_keys
        # From the leaves up: each level's "up" maps the level below to it.
        for i, level in enumerate(self.levels):
            for j, b in enumerate(level["bits"]):
                if i == 0:
                    b["log"], b["weight"], b["below"] = b["own"], np.ones(len(b["own"])), np.zeros(len(b["own"]))
                else:
                    below = self.levels[i - 1]["bits"][j]
                    parent = b["node"][level["up"][below["head"]]]
                    b["below"] = np.bincount(parent, weights=below["log"], minlength=len(b["own"]))
                    b["log"], b["weight"] = weighted(b["own"], b["below"])

    def pairs(self, j: int) -> np.ndarray:
        """The nodes of depth 2 of the j-th decision: latest two bytes << 8 | decision."""
        keys = self.levels[-1]["keys"][self.levels[-1]["bits"][j]["head"]]
        return ((keys >> np.uint64(8)) << np.uint64(8) | np.uint64(1 << j) | ((keys & np.uint64(255)) >> np.uint64(8 - j))).astype(np.int64)

    def shallow(self, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What depth 1 needs: node (latest byte << 8 | decision), zeros, ones, and the sum of its children's logs.

        Of heavy pairs, of which this is but a part, the nodes of depth 2 themselves (``PAIR`` | node) with the sum of their children's logs.
        """
        node, zeros, ones, logs = [], [], [], []
        for j, b in enumerate(self.levels[-1]["bits"]):
            pair = self.pairs(j)
            part = heavy[pair >> 8]
            node.append(np.where(part, PAIR | pair, (pair >> 16) << 8 | pair & 255))
            zeros.append(b["zeros"])
            ones.append(b["ones"])
            logs.append(np.where(part, b["below"], b["log"]))
        nodes, back = np.unique(np.concatenate(node), return_inverse=True)
        return nodes, *(np.bincount(back, weights=np.concatenate(x), minlength=len(nodes)) for x in (zeros, ones, logs))

    def complete(self, top: Shallow) -> Forest:
        """With the heavy pairs' nodes of depth 2 as all parts together make them."""
        for j, b in enumerate(self.levels[-1]["bits"]):
            pair = self.pairs(j)
            at = np.minimum(np.searchsorted(top.pairs, pair), max(len(top.pairs) - 1, 0))
            hit = top.pairs[at] == pair if len(top.pairs) else np.zeros(len(pair), bool)
            for name, values in (("zeros", top.pair_zeros), ("ones", top.pair_ones), ("weight", top.pair_weight)):
                b[name][hit] = values[at[hit]]
        return self

    def log10(self, top: Shallow) -> np.ndarray:
        """log10 probability of every key's byte in its context."""
        keys = self.levels[0]["keys"]
        total = np.zeros(len(keys))
        latest = (keys >> np.uint64(8 * len(self.levels) + 8)) & np.uint64(255)
        byte = keys & np.uint64(255)
        for j in range(8):
            row, chance = np.arange(len(keys)), None
            steps = []
            for level in self.levels:
                row = level["up"][row]
                b = level["bits"][j]
                node = b["node"][row]
                right = np.where(b["bit"][row], b["ones"][node], b["zeros"][node])
                steps.append((b["weight"][node], (right + 0.5) / (b["ones"][node] + b["zeros"][node] + 1)))
            for weight, kt in steps:
                chance = kt if chance is None else weight * kt + (1 - weight) * chance
            decision = (np.uint64(1 << j) | (byte >> np.uint64(8 - j))).astype(np.int64)
            bit = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            for weight, one in ((top.weight1[latest.astype(np.int64), decision], top.one1[latest.astype(np.int64), decision]), (top.weight0[decision], top.one0[decision])):
                chance = weight * np.where(bit, one, 1 - one) + (1 - weight) * chance
            total += np.log10(chance)
        return total


class Shallow:
    """Weights and estimates of the nodes of depth 0 and 1, by decision, and of heavy pairs' nodes of depth 2."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, logs: np.ndarray) -> None:
        of_pair = node >= PAIR
        order = np.flatnonzero(of_pair)[np.argsort(node[of_pair])]
        self.pairs, self.pair_zeros, self.pair_ones = node[order] - PAIR, zeros[order], ones[order]
        whole, self.pair_weight = weighted(log_kt(self.pair_zeros, self.pair_ones), logs[order])
        node, back = np.unique(np.concatenate([node[~of_pair], (self.pairs >> 16) << 8 | self.pairs & 255]), return_inverse=True)
        zeros, ones, logs = (np.bincount(back, weights=np.concatenate(x), minlength=len(node)) for x in ((zeros[~of_pair], self.pair_zeros), (ones[~of_pair], self.pair_ones), (logs[~of_pair], whole)))
        self.weight1, self.one1 = np.full((256, 256), 0.5), np.full((256, 256), 0.5)
        total, weight = weighted(log_kt(zeros, ones), logs)
        at = node >> 8, node & 255
        self.weight1[at], self.one1[at] = weight, (ones + 0.5) / (zeros + ones + 1)
        z, o, below = (np.bincount(node & 255, weights=x, minlength=256) for x in (zeros, ones, total))
        _, self.weight0 = weighted(log_kt(z, o), below)
        self.one0 = (o + 0.5) / (z + o + 1)


# Jobs


def heavy_pairs(docs: DataFrame, documents: int, depth: int) -> np.ndarray:
    """Which pairs of bytes are to be dealt by three bytes: those frequent in a sample of ``doc_id, text``, drawn by hash."""
    heavy = np.zeros(1 << 16, bool)
    if depth < 3:
        return heavy

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in row_groups(offsets, GROUP_BYTES):
                keys, _ = context_keys(canonical(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), 2)
                total += np.bincount((keys >> np.uint64(8)).astype(np.int64), minlength=1 << 16)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(1_000_003)) <= min(1.0, HEAVY_SAMPLE / max(documents, 1)) * 1_000_003)
    found = drawn.select("text").mapInArrow(released(count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    share = sum(r["n"] for r in found) / HEAVY_PAIRS
    heavy[[r["pair"] for r in found if r["n"] > share]] = True
    return heavy


def _part_of(keys: np.ndarray, kind: int, depth: int, parts: int, heavy: np.ndarray) -> np.ndarray:
    """Contexts go by their two latest bytes, those of heavy pairs by three; words by their hash."""
    if kind == 0:
        pair = keys >> np.uint64(8 * (depth - 2) + 8)
        if heavy.any():
            pair = np.where(heavy[pair.astype(np.int64)], (keys >> np.uint64(8 * (depth - 3) + 8)) + np.uint64(1 << 24), pair)
        keys = pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
    return (keys % np.uint64(parts)).astype(np.int64)


def _dealt(kind: int, keys: np.ndarray, counts: np.ndarray | None, depth: int, parts: int, heavy: np.ndarray):
    """(kind, part, keys, counts) of each part that has keys; keys stay in order."""
    part = _part_of(keys, kind, depth, parts, heavy)
    order = np.argsort(part, kind="stable")
    part, keys = part[order], keys[order]
    counts = counts[order] if counts is not None else None
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(edges, np.append(edges[1:], len(part))):
        yield kind, int(part[a]), keys[a:b], counts[a:b] if counts is not None else None


def training_counts(docs: DataFrame, depth: int, parts: int, heavy: np.ndarray) -> DataFrame:
    """``kind, part, keys, counts`` over all rows of ``text``, merged by part; kind 0: contexts, 1: words (key 0: the end)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]
        size = 0

        def merged(kind: int):
            return counted(np.concatenate([k for k, _ in held[kind]]), np.concatenate([c for _, c in held[kind]]))

        def out():
            rows = [x for kind in (0, 1) if held[kind] for x in _dealt(kind, *merged(kind), depth, parts, heavy)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([planes(r[2]) for r in rows], pa.binary()), pa.array([planes(r[3].astype(np.int64)) for r in rows], pa.binary())], names=["kind", "part", "keys", "counts"])

        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in row_groups(offsets, GROUP_BYTES):
                own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                held[0].append(counted(context_keys(canonical(own, at), depth)[0]))
                held[1].append(counted(word_keys(own, at)[0]))
                held[1].append((np.zeros(1, np.uint64), np.array([b - a])))
                size += sum(len(h[-1][0]) for h in held)
                if size > 3_000_000:
                    held[0], held[1] = [merged(0)], [merged(1)]
                    size = 0
                    if sum(len(h[0][0]) for h in held) > 2_000_000:
                        yield out()
                        held = [[], []]
        yield out()

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = counted(*(np.concatenate([from_planes(x, t) for x in table.column(c).to_pylist()]) for c, t in (("keys", np.uint64), ("counts", np.int64))))
        return pa.table({"kind": table.column("kind")[:1], "part": table.column("part")[:1], "keys": pa.array([planes(keys)], pa.binary()), "counts": pa.array([planes(counts)], pa.binary())})

    schema = "kind int, part int, keys binary, counts binary"
    return docs.select("text").mapInArrow(released(gather), schema).groupBy("kind", "part").applyInArrow(merge, schema)


def ctw_scores(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Trained on the rows for which ``train`` holds (null: no). A text's tokens are its words (runs of bytes other than
    ASCII white space, A-Z in lower case) and one end; a null text is an empty one and has the end alone. score is the
    log10 probability that the context trees give the words joined by single spaces and the end. base_score is that of
    add-one token frequencies. Repeated rows are scored, and counted, each. With no training rows all estimates are
    1/2 a bit and 1/(0 + 1) a token. Whole texts are read: a very long one makes a block of its own, which one task holds with
    about 100 bytes a byte of text. A byte's log probability travels in single precision (a relative error of 6e-8). An empty
    table gives an empty one; other columns, of whatever names, are ignored.
    """
    spark = docs.sparkSession
    key_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    total, documents = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = (total or 0) // BLOCK_BYTES + 1
    parts = partitions_for(spark, blocks * 400_000, PART_KEYS)
    heavy = heavy_pairs(rows.where("train"), documents, depth)
    counts = saved(training_counts(rows.where("train"), depth, parts, heavy))

    def shallow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                node, zeros, ones, logs = Forest(from_planes(keys), from_planes(n, np.int64), depth).shallow(heavy)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(zeros), pa.array(ones), pa.array(logs)], names=["node", "zeros", "ones", "logs"])

    nodes = counts.where("kind = 0").select("keys", "counts").mapInArrow(released(shallow_rows), "node long, zeros double, ones double, logs double").groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("logs")).orderBy("node").collect()
    top = Shallow(*(np.array([r[k] for r in nodes], np.int64 if k == 0 else np.float64) for k in range(4)))

    def token_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [from_planes(x, np.int64) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in own], pa.int64()), pa.array([int(x.sum()) for x in own], pa.int64())], names=["v", "n"])

    v, n_train = (x or 0 for x in counts.where("kind = 1").select("counts").mapInArrow(token_sums, "v long, n long").agg(F.sum("v"), F.sum("n")).first())
    end_row = counts.where((F.col("kind") == 1) & (F.col("part") == 0)).first()
    end_count = 0
    if end_row is not None and len(end_row["keys"]) and from_planes(end_row["keys"])[0] == 0:
        end_count = int(from_planes(end_row["counts"], np.int64)[0])
    log_all = math.log10(n_train + v + 1)
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(blocks)).cast("long"))

    def distinct_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_buffers(table.column("text"))
        found: list[list] = [[], []]
        for a, b in row_groups(offsets, GROUP_BYTES):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            found[0].append(counted(context_keys(canonical(own, at), depth)[0])[0])
            found[1].append(counted(word_keys(own, at)[0])[0])
        return tuple(counted(np.concatenate(x))[0] if x else np.zeros(0, np.uint64) for x in found)

    def ask(table: pa.Table) -> pa.Table:
        both = distinct_keys(table)
        got = [x for kind in (0, 1) for x in _dealt(kind, both[kind], None, depth, parts, heavy)]
        return pa.table({"kind": pa.array([x[0] for x in got], pa.int32()), "part": pa.array([x[1] for x in got], pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(got), pa.int64()), "asked": pa.array([planes(x[2]) for x in got], pa.binary())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        lists = [from_planes(x) for x in asked.column("asked").to_pylist()]
        own = [from_planes(x, t) for c, t in (("keys", np.uint64), ("counts", np.int64)) for x in (known.column(c).to_pylist() if known.num_rows else [b""])]
        wanted = counted(np.concatenate(lists))[0] if lists else np.zeros(0, np.uint64)
        kind = asked.column("kind")[0].as_py() if lists else 1
        if kind == 0:
            keys, n = counted(np.concatenate([own[0], wanted]), np.concatenate([own[1], np.zeros(len(wanted), np.int64)]))
            value = Forest(keys, n, depth).complete(top).log10(top)
        else:
            keys, n = counted(np.concatenate([own[0], wanted]), np.concatenate([own[1], np.zeros(len(wanted), np.int64)]))
            value = np.log10(n + 1.0)
        data = [value[np.searchsorted(keys, x)].astype(np.float64 if kind else np.float32).tobytes() for x in lists]
        return pa.table({"block": asked.column("block"), "kind": asked.column("kind"), "part": asked.column("part"), "values": pa.array(data, pa.binary())})

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        both = distinct_keys(table)
        answers = {(k, p): x for k, p, x in zip(told.column("kind").to_pylist(), told.column("part").to_pylist(), told.column("values").to_pylist())}
        value = []
        for kind in (0, 1):
            own = np.zeros(len(both[kind]))
            part = _part_of(both[kind], kind, depth, parts, heavy)
            order = np.argsort(part, kind="stable")
            own[order] = np.concatenate([np.zeros(0), *(np.frombuffer(answers[kind, p], np.float64 if kind else np.float32) for p in np.unique(part).tolist())])
            value.append(own)
        data, offsets = text_buffers(table.column("text"))
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for a, b in row_groups(offsets, GROUP_BYTES):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            keys, size = context_keys(canonical(own, at), depth)
            words, n = word_keys(own, at)
            row = np.repeat(np.arange(b - a), n)
            known = looked_up(both[1], value[1], words)
            out[0].append(n + 1)
            out[1].append(np.bincount(row, weights=known > 0, minlength=b - a).astype(np.int64) + (end_count > 0))
            out[2].append(np.bincount(row, weights=known, minlength=b - a) + math.log10(end_count + 1) - log_all * (n + 1))
            out[3].append(np.bincount(np.repeat(np.arange(b - a), size), weights=looked_up(both[0], value[0], keys), minlength=b - a))
            out[4].append(size)
        n_tokens, n_known, base, ctw, size = (np.concatenate(x) for x in out)
        return pa.table({"doc_id": table.column("doc_id"), "held_out": pa.array([not x for x in table.column("train").to_pylist()], pa.bool_()), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(len(n_tokens), n_train), "base_score": base, "score": ctw, "bits_per_byte": -ctw / math.log10(2) / size})

    # More blocks than the session's partitions: as many partitions, so that a task has few blocks whatever the size.
    own = (lambda df: df.repartition(blocks, "block")) if blocks > int(spark.conf.get("spark.sql.shuffle.partitions")) else (lambda df: df)
    asked = own(blocked).groupBy("block").applyInArrow(ask, "kind int, part int, block long, asked binary")
    told = asked.groupBy("kind", "part").cogroup(counts.groupBy("kind", "part")).applyInArrow(answer, "block long, kind int, part int, values binary")
    return own(blocked).groupBy("block").cogroup(own(told).groupBy("block")).applyInArrow(score, f"doc_id {key_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def op5_ctw_scores(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return ctw_scores(docs, id_bucket(F.col("doc_id"), 7) != 2)
