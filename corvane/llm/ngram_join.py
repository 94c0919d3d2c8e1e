"""Operator 8: n-gram Jaccard join by parity sketches.

A document's shingle hashes are dealt to blocks of a sketch in which each flips one bit, so the
Hamming distance of two sketches is never more than the size of the sets' symmetric difference. Two sets that are
similar enough differ in at most d shingles, d following from their sizes. Documents are joined within size
bands: with more than d blocks one block at least holds none of the differing shingles, so both documents agree in
that block's bits and in a checksum of its shingles. With spare blocks (a quarter more than needed), blocks
with fewer than two bits need no key: they are what unrelated documents share.

Equal sets are one node. The documents of a bucket (an agreeing block) are paired with one leader each, never with one
another: as many pairs as documents. Among a leader's documents whole sketches, about as many bits as a set has shingles, then
tell which may be near enough; what hangs together by that is a family, and two documents that are similar enough are always
of one. Each document's text meets the text of one document of its family, the first, which verifies that pair and gives the
exact difference of the two sets. Of two documents of a family these differences alone say how far they are apart, so what
is not linked to the first is compared with the others on differences: exactly, and with hardly any work where they have
nothing in common.

A shingle is a 64-bit hash of its words' hashes (see ``span_hashes``); sets are told apart by 128 bits: half names the
set, and if the other half ever differs under one name, all hashes are drawn anew with another seed.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LOWER_ASCII, mix64, partitions_for, read_table, released, row_groups, saved, span_hashes, text_buffers, word_spans
from corvane.llm.components import connected_components

FLUSH_KEYS = 600_000
GROUP_BYTES = 3 << 20
KEYS_PER_PART = 400_000
BROADCAST_ROWS = 1_000_000
LEADER_SETS = 64  # of leaders, kept while their documents pass
BLOCK_ROWS = 8192  # of a leader's documents compared in one task, and the bytes of their sketches or differences
BLOCK_BYTES = 12 << 20
FEW_ROWS = 256  # of a leader that is compared together with others, pairs compared at once, and bytes of their sketches
PAIRS_AT_ONCE = 1 << 19
SKETCH_BYTES = 8 << 20
_STEP = mix64(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int, seed: int = 0) -> list[np.ndarray]:
    """Sorted distinct hashes of every row's shingles of ``words`` words; a shorter row is one shingle."""
    data = LOWER_ASCII[data]
    starts, ends, at = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends, seed)
    n = np.diff(at)
    row_end = np.repeat(at[1:], n)
    place = np.arange(len(hashes))
    total = np.zeros(len(hashes), np.uint64)
    size = np.minimum(row_end - place, words)
    for k in range(words):
        inside = size > k
        total[inside] += hashes[place[inside] + k] * _STEP[k]
    total = mix64(total + size.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    out = []
    for i in range(len(n)):
        own = total[at[i] : at[i] + max(n[i] - words + 1, min(n[i], 1))]
        own.sort()
        out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
    return out


def set_names(own: np.ndarray, seed: int = 0) -> tuple[int, int] | tuple[None, None]:
    """A set's name and a second one that tells sets of one name apart, 64 bits each, as signed integers; none for an empty set."""
    if not len(own):
        return None, None
    name = np.frombuffer(blake2b(own.tobytes(), digest_size=16, key=seed.to_bytes(8, "little")).digest(), np.int64)
    return int(name[0]), int(name[1])


def most_different(sizes: np.ndarray | int, percent: int):
    """The largest symmetric difference of two sets of so many members together that are similar enough."""
    return sizes * (100 - percent) // (100 + percent)


def size_bands(largest: int, percent: int) -> list[tuple[int, int, int]]:
    """Bands of set sizes: first and last size, and the largest size that a partner may have."""
    bands, low = [], 1
    while low <= largest:
        high = max(low, -(-low * 100 // percent) - 1)
        bands.append((low, high, high * 100 // percent))
        low = high + 1
    return bands


def block_keys(own: np.ndarray, band: int, limit: int) -> np.ndarray:
    """Join keys of a set in a band whose pairs differ in at most ``limit`` shingles."""
    if limit < 1:
        return np.zeros(0, np.uint64)
    spare = limit // 4
    blocks = limit + 1 + spare
    block = (own >> np.uint64(17)) % np.uint64(blocks)
    order = np.argsort(block, kind="stable")
    held, own = block[order], own[order]
    first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    bits, check = np.zeros(blocks, np.uint64), np.zeros(blocks, np.uint64)
    at = held[first].astype(np.int64)
    bits[at] = np.bitwise_xor.reduceat(np.uint64(1) << (own & np.uint64(63)), first)
    check[at] = np.bitwise_xor.reduceat(own, first)
    keys = mix64(mix64(bits + np.uint64(band << 40)) ^ check ^ mix64(np.arange(1, blocks + 1, dtype=np.uint64)))
    low = np.bitwise_count(bits) < 2
    return keys[~low] if low.sum() <= spare else keys


def _sets_of(batches: Iterator[pa.RecordBatch], words: int, seed: int = 0):
    """(batch, first row, sets) of row groups; the text is the batch's last column."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(batch.num_columns - 1))
        for a, b in row_groups(offsets, GROUP_BYTES):
            yield batch, a, shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words, seed)


def whole_sketch(own: np.ndarray) -> bytes:
    """A parity bit for each of a power of two of places, between half as many and as many as the set's members twice over (512 at least)."""
    size = 1 << max(9, int(2 * len(own)).bit_length() - 1)
    flips = np.bincount(((own >> np.uint64(7)) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def shingle_summary(docs: DataFrame, doc_id: str, text: str, words: int, seed: int) -> DataFrame:
    """``doc_id, n_shingles, fp, other, sketch`` of every row; fp names the set (null for an empty one), other tells equal names apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, sets in _sets_of(batches, words, seed):
            names = [set_names(s, seed) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, len(sets)), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([n[k] for n in names], pa.int64()) for k in (0, 1)), pa.array([whole_sketch(s) if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "fp", "other", "sketch"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(released(run), "doc_id long, n_shingles long, fp long, other long, sketch binary")


KEY_BYTES = 6  # of a key's hash that are sent: a chance match is one more candidate


def packed_keys(key: np.ndarray, name: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted keys by byte planes, the distinct sets, and for each key the number of its set, by planes."""
    names, number = np.unique(name, return_inverse=True)
    planes = lambda x, n: np.ascontiguousarray(x.astype(f"<u{8 if n > 4 else 4}").view(np.uint8).reshape(len(x), -1).T[:n]).tobytes()
    return planes(key, KEY_BYTES), names.tobytes(), planes(number, 4)


def unpacked_keys(keys: bytes, names: bytes, numbers: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(numbers) // 4
    key = np.zeros((n, 8), np.uint8)
    key[:, :KEY_BYTES] = np.frombuffer(keys, np.uint8).reshape(KEY_BYTES, n).T
    number = np.ascontiguousarray(np.frombuffer(numbers, np.uint8).reshape(4, n).T).view("<u4").ravel()
    return key.view("<u8").ravel(), np.frombuffer(names, np.uint64)[number]


def candidate_rows(docs: DataFrame, text: str, words: int, percent: int, largest: int, parts: int, seed: int) -> DataFrame:
    """``part, keys, fps, numbers``: block keys and the sets that hold them, packed (see ``packed_keys``)."""
    bands = size_bands(largest, percent)
    limit = [int(most_different(high + partner, percent)) for _, high, partner in bands]
    low_of = np.array([low for low, _, _ in bands])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        names: list[np.ndarray] = []
        size = 0

        def flush():
            key, name = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (keys, names))
            part = ((key >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
            key &= np.uint64((1 << 8 * KEY_BYTES) - 1)
            order = np.lexsort((name, key, part))
            part, key, name = part[order], key[order], name[order]
            fresh = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])) if len(key) else np.zeros(0, bool)
            part, key, name = part[fresh], key[fresh], name[fresh]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(part))
            rows = [packed_keys(key[x:y], name[x:y]) for x, y in zip(first, last)]
            return pa.RecordBatch.from_arrays([pa.array(part[first]), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(3))], names=["part", "keys", "fps", "numbers"])

        for _, _, sets in _sets_of(batches, words, seed):
            for own in sets:
                if not len(own):
                    continue
                name = np.uint64(set_names(own, seed)[0] & 0xFFFFFFFFFFFFFFFF)
                band = int(np.searchsorted(low_of, len(own), "right")) - 1
                for k in (band, band - 1):  # its own band, and as a larger partner the one below
                    if k >= 0 and len(own) <= bands[k][2]:
                        got = block_keys(own, k, limit[k])
                        keys.append(got)
                        names.append(np.full(len(got), name))
                        size += len(got)
                if size > FLUSH_KEYS:
                    yield flush()
                    keys, names, size = [], [], 0
        yield flush()

    return docs.select(F.col(text).alias("text")).mapInArrow(released(run), "part int, keys binary, fps binary, numbers binary")


def leader_pairs(rows: DataFrame) -> DataFrame:
    """``a, b``: the members b of each bucket with its leader a, the bucket's smallest name. A part holds 14 bytes a key."""

    def pairs(table: pa.Table) -> pa.Table:
        key, name = (np.concatenate(x) for x in zip(*(unpacked_keys(*(c.as_py() for c in r)) for r in zip(*(table.column(c) for c in ("keys", "fps", "numbers"))))))
        name = name.view(np.int64)
        order = np.lexsort((name, key))
        key, name = key[order], name[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        lead = np.repeat(name[first], np.diff(np.append(first, len(key))))
        member = name != lead
        ends = np.stack([lead[member], name[member]], 1)
        ends = np.unique(ends, axis=0) if len(ends) else ends
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return rows.groupBy("part").applyInArrow(pairs, "a long, b long").distinct()


def by_leader(rows: DataFrame, load: DataFrame) -> DataFrame:
    """Deal ``rows`` (a, b, stray) to tasks that hold whole leaders: ``dealt, low, high`` name a task.

    ``load``: a, m (rows), strays and bytes. Of a leader of many or long rows each row is at ``home`` in one block, and each stray will ``visit`` all
    blocks, in one of as many groups as strays take: a task is a block and a group of visitors. Rows that aren't strays are as many times there as there are groups, so
    while strays fit a block (``BLOCK_ROWS``), rows grow in proportion to a leader's documents.
    """
    spark = rows.sparkSession
    whole = lambda n, size: F.ceil(F.greatest(n / BLOCK_ROWS, size / BLOCK_BYTES, F.lit(1))).cast("int")
    total = load.agg(F.sum("m"), F.sum("bytes")).first()
    groups = partitions_for(spark, max((total[0] or 0) * 512, total[1] or 0), BLOCK_BYTES)
    sized = load.select("a", whole(F.col("m"), F.col("bytes")).alias("blocks"), whole(F.col("strays"), F.col("bytes") * F.col("strays") / F.col("m")).alias("parties"))
    spread = rows.join(sized, "a").withColumns({"own": F.pmod(F.hash("b"), F.col("blocks")), "party": F.when(F.col("stray"), F.pmod(F.hash("b"), F.col("parties")))})
    at_home = F.transform(F.sequence(F.lit(0), F.col("parties") - 1), lambda p: F.struct(F.col("own").alias("low"), p.alias("high")))
    away = F.when(F.col("stray"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(x.alias("low"), F.col("party").alias("high")))).otherwise(F.array().cast("array<struct<low: int, high: int>>"))
    spread = spread.withColumn("at", F.explode(F.array_distinct(F.concat(at_home, away))))
    spread = spread.withColumns({"low": F.col("at.low"), "high": F.col("at.high"), "home": F.col("at.low") == F.col("own"), "visit": F.coalesce(F.col("at.high") == F.col("party"), F.lit(False))})
    spread = spread.withColumn("dealt", F.when((F.col("blocks") == 1) & (F.col("parties") == 1), F.pmod(F.xxhash64("a"), F.lit(groups))).otherwise(F.col("a")))
    return spread.drop("blocks", "parties", "own", "party", "at")


def leader_rows(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The table's rows by leader, each document once, and where each leader's begin (and the last's end)."""
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    order = np.lexsort((b, a))
    order = order[np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))]
    table, a = table.take(pa.array(order)), a[order]
    return table, np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a))


def leaders_of(table: pa.Table) -> Iterator[pa.Table]:
    """The table's rows leader by leader, each document once."""
    table, edges = leader_rows(table)
    for x, y in zip(edges, edges[1:]):
        yield table.slice(x, y - x)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of half, a quarter .. as many bits: the parity of places that are that far apart."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), 0)


def sketch_words(*columns: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the sketches of some columns, one after the other: all of them, where each sketch begins, and how many it has."""
    flat, words = [], []
    for column in columns:
        column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        flat.append(np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(np.uint64) if offsets[-1] > offsets[0] else np.zeros(0, np.uint64))
        words.append(np.diff(offsets) // 8)
    words = np.concatenate(words)
    return np.concatenate(flat), np.cumsum(words) - words, words


def near_by_sketch(i: np.ndarray, j: np.ndarray, size: np.ndarray, sketches: tuple[np.ndarray, np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Of pairs of places whether the sets may be similar enough, by their sizes and by their sketches (see ``sketch_words``), folded to the length of the shorter one."""
    flat, start, words = sketches
    s, t = size[i], size[j]
    near = 100 * np.minimum(s, t) >= percent * np.maximum(s, t)
    at = np.flatnonzero(near)
    width = np.minimum(words[i[at]], words[j[at]])
    for w in np.unique(width).tolist():
        of_width, step = at[width == w], max(SKETCH_BYTES // (8 * w), 1)
        for x in range(0, len(of_width), step):
            own = of_width[x : x + step]
            used, place = np.unique(np.concatenate([i[own], j[own]]), return_inverse=True)
            n = words[used]
            own_words = flat[np.repeat(start[used] - np.cumsum(n) + n, n) + np.arange(n.sum())].reshape(-1, w)
            bits = np.bitwise_xor.reduceat(own_words, (np.cumsum(n) - n) // w, axis=0)
            apart = np.bitwise_count(bits[place[: len(own)]] ^ bits[place[len(own) :]]).sum(1, dtype=np.int64)
            near[own] = apart <= most_different(s[own] + t[own], percent)
    return near


def families_of_few(table: pa.Table, edges: np.ndarray, few: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """What ``families_by_sketch`` gives for the leaders ``few`` (see ``leader_rows``), taken together: such groups are so small that one by one each costs more than its comparisons."""
    size, home, stray, visit = (table.column(c).to_numpy(zero_copy_only=False) for c in ("n", "home", "stray", "visit"))
    leader = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    own = np.isin(leader, few)
    at_home, visitors = np.flatnonzero(home & own), np.flatnonzero(visit & own)
    begins = np.searchsorted(at_home, edges)
    many = np.diff(begins)[leader[visitors]]
    sketches = sketch_words(table.column("sketch"))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    found = []
    stops = np.cumsum(many)
    first = 0
    while first < len(visitors):
        last = max(int(np.searchsorted(stops, (stops[first - 1] if first else 0) + PAIRS_AT_ONCE, "right")), first + 1)
        n = many[first:last]
        i = np.repeat(visitors[first:last], n)
        j = at_home[np.repeat(begins[leader[visitors[first:last]]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        fresh = (i != j) & ~(visit[j] & home[i] & (j < i))
        i, j = i[fresh], j[fresh]
        near = near_by_sketch(i, j, size, sketches, percent)
        i, j = i[near], j[near]
        # Rows that aren't strays hang together by their leader: they are one, numbered below all rows.
        for x, y, one in zip(i.tolist(), j.tolist(), np.where(stray[j], j, -1 - leader[j]).tolist()):
            a, b = root(x), root(one)
            if a != b:
                parent[a] = b
                found.append((x, y))
        first = last
    return found


def tied(label: np.ndarray, i: int, close: np.ndarray) -> np.ndarray:
    """Of the rows close to row i one for each label; all of these labels become that of i."""
    found, at = np.unique(label[close], return_index=True)
    label[np.isin(label, found)] = label[i]
    return close[at]


def families_by_sketch(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Pairs of rows of one leader that tie each visitor with the rows at home that it hangs together with by sketches.

    Rows that aren't strays hang together already, by their leader.
    """
    size, home, stray, visit = (table.column(c).to_numpy(zero_copy_only=False) for c in ("n", "home", "stray", "visit"))
    bits = [np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]
    width = min(map(len, bits))
    bits = np.stack([folded(x, width) for x in bits])
    label = np.arange(len(size))
    label[~stray] = len(size)
    found = []
    for i in np.flatnonzero(visit):
        other = np.flatnonzero(home & (label != label[i]))
        s, t = size[i], size[other]
        close = other[(100 * np.minimum(s, t) >= percent * np.maximum(s, t)) & (np.bitwise_count(bits[other] ^ bits[i]).sum(1) <= most_different(s + t, percent))]
        if len(close):
            found += [(i, j) for j in tied(label, i, close)]
    return found


def told_by_leader(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``a, b, stray, bytes`` of all documents b of each leader, itself included: whether b differs too much from a by their sketches (``fp, n, sketch``)."""
    lead = pairs.select("a").distinct().join(sketches.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
    rows = pairs.join(sketches, F.col("b") == F.col("fp")).select("a", "b", "n", "sketch").join(lead, "a").select("a", "b", "n", "n_a", "sketch", "sketch_a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.concatenate([batch.column(c).to_numpy() for c in ("n", "n_a")])
            place = np.arange(len(batch))
            near = near_by_sketch(place, place + len(batch), size, sketch_words(batch.column("sketch"), batch.column("sketch_a")), percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(~near), pc.binary_length(batch.column("sketch")).cast(pa.int64())], names=["a", "b", "stray", "bytes"])

    told = rows.mapInArrow(released(run), "a long, b long, stray boolean, bytes long")
    return saved(told.unionByName(lead.select("a", F.col("a").alias("b"), F.lit(False).alias("stray"), F.octet_length("sketch_a").cast("bigint").alias("bytes"))))


def near_edges(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b``, a forest by task, that tie the documents of each leader which may be similar enough by sketches (``fp, n, sketch``).

    Each is compared with its leader first. Only strays, which differ too much from it, are compared with the others.
    """
    told = told_by_leader(pairs, sketches, percent)
    load = told.groupBy("a").agg(F.count("*").alias("m"), F.count_if("stray").alias("strays"), F.sum("bytes").alias("bytes")).where("strays > 0")

    def run(table: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 2]
        table, edges = leader_rows(table)
        few = np.flatnonzero(np.diff(edges) <= FEW_ROWS)
        groups = [(table, families_of_few(table, edges, few, percent))]
        for k in np.flatnonzero(np.diff(edges) > FEW_ROWS):
            own = table.slice(edges[k], edges[k + 1] - edges[k])
            groups.append((own, families_by_sketch(own, percent)))
        for own, found in groups:
            if found:
                name = own.column("b").to_numpy()
                i, j = np.array(found).T
                out.append((name[i], name[j]))
        a, b = (np.concatenate(x) for x in zip(*out))
        return pa.table({"a": a, "b": b})

    dealt = by_leader(told.drop("bytes"), load).join(sketches, F.col("b") == F.col("fp")).select("a", "b", "stray", "home", "visit", "low", "high", "dealt", "n", "sketch")
    strays = dealt.groupBy("dealt", "low", "high").applyInArrow(run, "a long, b long")
    return told.where("NOT stray AND a <> b").select("a", "b").unionByName(strays)


def difference(lead: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a sorted set holds beyond its leader's, and of each of the leader's members whether it is missing."""
    at = np.searchsorted(lead, own)
    shared = lead[np.minimum(at, len(lead) - 1)] == own
    missing = np.ones(len(lead), bool)
    missing[at[shared]] = False
    return own[~shared], missing


def star_rows(pairs: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """``a, b, n_a, n_b, apart, linked, extra, missing`` of pairs ``a, b, members, text_a, text_b``: whether the two sets are similar
    enough and, if the leader has other members, b's set as its difference from a's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            lead = batch.column(0).to_pylist()
            text_a, members = batch.column(batch.schema.get_field_index("text_a")), batch.column(batch.schema.get_field_index("members")).to_pylist()
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index("text_b")))
            for x, y in row_groups(offsets, GROUP_BYTES):
                sets = shingle_sets(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], words, seed)
                out: list[list] = [[], [], [], [], [], []]
                for i, own in enumerate(sets, x):
                    if lead[i] not in held:
                        held[lead[i]] = shingle_sets(*text_buffers(text_a.slice(i, 1)), words, seed)[0]
                        if len(held) > LEADER_SETS:
                            held.popitem(last=False)
                    held.move_to_end(lead[i])
                    extra, missing = difference(held[lead[i]], own)
                    n_a, n_b, apart = len(missing), len(own), len(extra) + int(missing.sum())
                    for column, v in zip(out, (n_a, n_b, apart, apart <= most_different(n_a + n_b, percent), extra.tobytes() if members[i] > 1 else None, np.packbits(missing).tobytes() if members[i] > 1 else None)):
                        column.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), batch.column(1).slice(x, y - x), *(pa.array(v, k) for v, k in zip(out, kinds))], names=["a", "b", "n_a", "n_b", "apart", "linked", "extra", "missing"])

    return pairs.select("a", "b", "members", "text_a", "text_b").mapInArrow(released(run), "a long, b long, n_a long, n_b long, apart long, linked boolean, extra binary, missing binary")


def links_by_difference(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Pairs of rows of one leader's documents that are similar enough, of a visitor (not linked to the leader) and one at home: as many as tie them.

    All sets are given by their differences from one set. That may be any set: shingles in which most documents
    differ from the leader are turned over, so that hardly any is in many differences. The symmetric
    difference of two documents is the sum of their differences less twice what both hold.
    """
    size, home, stray, visit = (table.column(c).to_numpy(zero_copy_only=False) for c in ("n_b", "home", "stray", "visit"))
    n_a, m = table.column("n_a")[0].as_py(), table.num_rows
    extra = [np.frombuffer(x, np.uint64) for x in table.column("extra").to_pylist()]
    bits = np.frombuffer(b"".join(table.column("missing").to_pylist()), np.uint8).reshape(m, -1)
    row_of, place = np.nonzero(np.unpackbits(bits, axis=1, count=n_a))
    kinds, number = np.unique(np.concatenate(extra), return_inverse=True)
    item = np.concatenate([number, place + len(kinds)])
    row = np.concatenate([np.repeat(np.arange(m), [len(x) for x in extra]), row_of])
    often = np.bincount(item, minlength=len(kinds) + n_a)
    turned = np.flatnonzero(2 * often > m)
    if len(turned):
        lacks = np.ones((len(turned), m), bool)
        spot = np.full(len(often), -1)
        spot[turned] = np.arange(len(turned))
        over = spot[item] >= 0
        lacks[spot[item[over]], row[over]] = False
        t, r = np.nonzero(lacks)
        item, row = np.concatenate([item[~over], turned[t]]), np.concatenate([row[~over], r])
        often = np.bincount(item, minlength=len(often))
    apart = np.bincount(row, minlength=m)
    shared = often[item] > 1
    item, row = item[shared], row[shared]
    by_item = np.argsort(item, kind="stable")
    holders, begin = row[by_item], np.cumsum(often * (often > 1)) - often * (often > 1)
    by_row = np.argsort(row, kind="stable")
    own, edge = item[by_row], np.searchsorted(row[by_row], np.arange(m + 1))
    label = np.arange(m)
    label[~stray] = m
    found = []
    for i in np.flatnonzero(visit):
        items = own[edge[i] : edge[i + 1]]
        n = often[items]
        stop = np.cumsum(n)
        both = np.bincount(holders[np.repeat(begin[items] - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)], minlength=m)
        close = np.flatnonzero(home & (label != label[i]) & (apart[i] + apart - 2 * both <= most_different(size[i] + size, percent)))
        if len(close):
            found += [(i, j) for j in tied(label, i, close)]
    return found


def links_within_stars(rows: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` (a forest of them by task) between documents of one leader of which one at least isn't linked to it.

    Only strays, documents that aren't linked to their leader, are compared with the others (see ``by_leader``).
    """
    rows = rows.withColumn("stray", ~F.col("linked"))
    load = rows.groupBy("a").agg(F.count("*").alias("m"), F.count_if("stray").alias("strays"), F.sum(8 * F.col("apart") + F.octet_length("missing")).alias("bytes")).where("m > 1 AND strays > 0")

    def run(table: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 2]
        for own in leaders_of(table):
            names, ends = own.column("b").to_numpy(), links_by_difference(own, percent)
            if ends:
                i, j = np.array(ends).T
                out.append((names[i], names[j]))
        a, b = (np.concatenate(x) for x in zip(*out))
        return pa.table({"a": a, "b": b})

    return by_leader(rows, load).groupBy("dealt", "low", "high").applyInArrow(run, "a long, b long")


def ngram_jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Words are runs of bytes other than ASCII white space, with A-Z in lower case; a text's set is its distinct
    shingles of ``words`` words (a shorter text's whole sequence is its one). Two rows are linked
    when 100 * |A and B| >= percent * |A or B|; component_id is the smallest doc_id reached. Null, empty and blank texts
    have empty sets and are linked with nothing; a row of null doc_id has a null component and isn't joined.
    Repeated rows, and several texts under one id, give rows each. A very long text is read whole: its set is in one
    task (about 50 bytes a byte of text). An empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    seed = 0
    while True:  # once, but for a chance of about (number of sets)^2 / 2^65
        summary = saved(shingle_summary(docs, doc_id, text, words, seed))
        live = summary.where(F.col("doc_id").isNotNull() & F.col("fp").isNotNull())
        nodes = saved(live.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.min("other").alias("low"), F.max("other").alias("high")))
        total, largest, clashes = nodes.agg(F.sum("n"), F.max("n"), F.count_if(F.col("low") != F.col("high"))).first()
        if not clashes:
            break
        seed += 1
    parts = partitions_for(spark, (total or 0) // 2, KEYS_PER_PART)
    pairs = saved(leader_pairs(candidate_rows(docs.where(F.col(doc_id).isNotNull()), text, words, percent, largest or 0, parts, seed)))

    def first_ids(names: DataFrame) -> DataFrame:
        """``fp, first_id`` of sets by name."""
        rows = saved(names.distinct().join(nodes.select("fp", "first_id"), "fp"))
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    involved = first_ids(pairs.select(F.explode(F.array("a", "b")).alias("fp")))
    sketches = saved(live.select(F.col("doc_id").alias("first_id"), "fp", F.col("n_shingles").alias("n"), "sketch").join(involved, ["fp", "first_id"], "left_semi"))
    families = connected_components(near_edges(pairs, sketches, percent))
    pairs = families.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    wanted = first_ids(families.select(F.col("node").alias("fp")))
    texts = saved(_right_rows(docs.select(F.col(doc_id).cast("long").alias("first_id"), F.col(text).alias("text")).join(wanted, "first_id").select("fp", "text"), words, seed))

    stars = pairs.groupBy("a").agg(F.count("*").alias("members"))
    left, right = (texts.select(F.col("fp").alias(k), F.col("text").alias(f"text_{k}")) for k in ("a", "b"))
    rows = saved(star_rows(pairs.join(stars, "a").join(right, "b").join(left, "a"), words, percent, seed))
    links = rows.where("linked").select("a", "b").unionByName(links_within_stars(rows, percent))
    component = connected_components(links)

    # A component's smallest id, over all rows that hold its sets.
    whole = nodes.select("fp", "first_id").join(component, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = whole.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = whole.join(least, "component").select("fp", "component_id")
    joined = live.select("doc_id", "n_shingles", "fp").join(by_fp, "fp").select("doc_id", "n_shingles", "component_id")
    alone = summary.where(F.col("doc_id").isNull() | F.col("fp").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone)


def _right_rows(df: DataFrame, words: int, seed: int) -> DataFrame:
    """Rows whose text has the set ``fp``: an id may be held by several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, sets in _sets_of(batches, words, seed):
            part = batch.slice(a, len(sets))
            yield part.filter(pa.array([set_names(s, seed)[0] == f for s, f in zip(sets, part.column(0).to_pylist())], pa.bool_()))

    return df.mapInArrow(released(run), "fp long, text string")


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read_table(spark, sf_dir, "documents"))
