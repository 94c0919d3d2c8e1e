"""Operator 12: a Merkle manifest of a dataset, with an inclusion proof for every row.

Rows are leaves of a ternary tree per source, the sources' roots are leaves of one more such tree. Inner nodes are records digest -> children,
addressed by their content; those of a subtree of ``HEIGHT`` levels are stored together, under the digest at its top (a pack).
Proofs come by descent: requests go down from the root through the store by the digits of a leaf's rank, and collect the
children that they don't select; requests that share a way down go it together, pack by pack. A path is gathered from the root down
and its segments are reversed for the proof, which goes from the leaf up.

A rank within a source is a row's place in a table sorted by ranges plus the rows of earlier ranges, so that no task
holds a whole source. Null fields hash as ``-``; a null source is a source of its own and comes first; null ids come first in their source and
aren't tampered with. Rows that are repeated are leaves of their own, in any order, as they are alike. A tree of one leaf is that leaf. An empty table gives no
rows; columns that aren't asked for are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import partitions_for, read_table, saved

FANOUT = 3
HEIGHT = 5  # levels of a pack: it holds up to 243 nodes at its bottom
WIDE = FANOUT**HEIGHT
BROADCAST_ROWS = 200_000
ROWS_A_PARTITION = 1_000_000

ASK = "rank bigint, digest string"
LEAF_ASK = "rank bigint, digest string, doc_id bigint, shown string"
RECORDS = "array<struct<node: string, children: array<string>>>"


def node_digest(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def depth(nodes: int, fanout: int = FANOUT) -> int:
    """Levels above so many nodes until one remains."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def leaf_digest(columns: list[Column]) -> Column:
    """The hash of the columns, each as its UTF-8 byte count, a colon and its value, or ``-`` for null."""
    framed = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*framed), 256)


def source_key(source: Column) -> Column:
    """A key in the order of sources, null first."""
    return F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 0, by ``order`` within ``tree``) and ``n`` (rows of the tree) to a written table.

    Rows are sorted by ranges; a row's rank is its place in its range and the tree's rows in the ranges before.
    """
    spark = rows.sparkSession
    spread = rows.withColumn("_row", F.monotonically_increasing_id())  # keeps rows that are alike from one range
    ranges = spread.repartitionByRange(partitions_for(spark, rows.count(), ROWS_A_PARTITION), "tree", *order, "_row").sortWithinPartitions("tree", *order)
    placed = saved(ranges.drop("_row").withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    counts = placed.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_n").over(Window.partitionBy("tree"))
    offsets = saved(counts.select("tree", "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), total.alias("n")))
    return placed.join(_small(offsets), ["tree", "_range"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def pack_up(rows: DataFrame, ask: list[str]) -> DataFrame:
    """``tree, pack, n, asks, digest, records``: up to 243 neighbours of a tree, the subtree above them as records, and its top.

    rows have tree, rank, n (nodes of the tree at this level), digest and the columns ``ask``. asks lists a pack's rows by rank.
    """
    packs = rows.groupBy("tree", F.floor(F.col("rank") / WIDE).alias("pack")).agg(F.array_sort(F.collect_list(F.struct("rank", "digest", *ask))).alias("asks"), F.first("n").alias("n"))
    packs = packs.select("tree", "pack", "n", "asks", F.col("asks.digest").alias("_nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("node", pa.string()), ("children", pa.list_(pa.string()))]))
        for batch in batches:
            tops, stored = [], []
            for n, nodes in zip(batch.column("n").to_pylist(), batch.column("_nodes").to_pylist()):
                records = []
                for _ in range(HEIGHT if n > WIDE else depth(n)):
                    runs = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
                    nodes = [node_digest(run) for run in runs]
                    records += [{"node": d, "children": run} for d, run in zip(nodes, runs)]
                tops.append(nodes[0])
                stored.append(records)
            kept = [batch.column(c) for c in ("tree", "pack", "n", "asks")]
            yield pa.record_batch([*kept, pa.array(tops, pa.string()), pa.array(stored, kind)], ["tree", "pack", "n", "asks", "digest", "records"])

    asks = f"array<struct<{LEAF_ASK if ask else ASK}>>".replace(" bigint", ": bigint").replace(" string", ": string")
    return saved(packs.mapInArrow(run, f"tree string, pack bigint, n bigint, asks {asks}, digest string, records {RECORDS}"))


def forest(rows: DataFrame, most: int, ask: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The tables of packs, from the leaves up, and ``tree, digest, level, leaves``: each tree's root and the level of the pack that holds it."""
    levels, roots = [], None
    rows = rows.withColumn("leaves", F.col("n"))
    leaves = rows.select("tree", "leaves").distinct()
    while True:
        packs = pack_up(rows, ask if not levels else [])
        own = packs.where(F.col("n") <= WIDE).select("tree", "digest", F.lit(len(levels)).alias("level"))
        roots = own if roots is None else roots.unionByName(own)
        levels.append(packs)
        if most <= WIDE:
            return levels, saved(roots.join(leaves, "tree"))
        most = -(-most // WIDE)
        rows = packs.where(F.col("n") > WIDE).select("tree", F.col("pack").alias("rank"), "digest", F.ceil(F.col("n") / WIDE).alias("n"))


def _walk(top: str, records: dict[str, list[str]], levels: int, rank: int) -> tuple[str, list[str]]:
    """The node that the digits of rank lead to, and each level's place and unselected children, from the top down."""
    node, way = top, []
    for j in range(levels - 1, -1, -1):
        digit = rank // FANOUT**j % FANOUT
        children = records[node]
        way.append(str(digit) + "".join(children[:digit] + children[digit + 1 :]))
        node = children[digit]
    return node, way


def _stored(requests: DataFrame, packs: DataFrame) -> DataFrame:
    """Requests with the records stored under their digest."""
    store = packs.select("digest", "records").dropDuplicates(["digest"])  # equal subtrees are stored under one address
    return requests.join(store, "digest")


#: A request: the pack of its tree (of so many leaves) that it has come to, the pack's digest, and the way there from the root.
REQUEST = ["tree", "pack", "leaves", "digest", "subroot", "root", "way"]


def descend(requests: DataFrame, packs: DataFrame, level: int) -> DataFrame:
    """Requests for packs of a level, led on to the packs below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = -(-row["leaves"] // WIDE**level)
                records = {r["node"]: r["children"] for r in row["records"]}
                out = []
                for rank in range(min(WIDE, n - row["pack"] * WIDE)):
                    node, way = _walk(row["digest"], records, HEIGHT if n > WIDE else depth(n), rank)
                    out.append({**row, "pack": row["pack"] * WIDE + rank, "digest": node, "way": row["way"] + way})
                yield pa.RecordBatch.from_pylist(out, batch.schema).select(REQUEST)

    return _stored(requests, packs).select(*REQUEST, "records").mapInArrow(run, "tree string, pack bigint, leaves bigint, digest string, subroot string, root string, way array<string>")


def fold(leaf: str, way: list[str]) -> str:
    """The root that follows from a leaf and its way (from the leaf up)."""
    for step in way:
        before = 1 + 64 * int(step[0])
        leaf = sha256((step[1:before] + leaf + step[before:]).encode()).hexdigest()
    return leaf


def _proofs(requests: DataFrame, packs: DataFrame) -> DataFrame:
    """One row for every leaf of the lowest packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for batch in batches:
            for row in batch.to_pylist():
                levels = HEIGHT if row["leaves"] > WIDE else depth(row["leaves"])
                records = {r["node"]: r["children"] for r in row["records"]}
                out = {c: [] for c in names}
                for ask in row["asks"]:
                    leaf, own = _walk(row["digest"], records, levels, ask["rank"] - row["pack"] * WIDE)
                    way = [*row["way"], *own][::-1]
                    root = fold(ask["shown"], way)
                    proof = sha256("".join(step[1:] for step in way).encode()).hexdigest()
                    for c, v in zip(names, (ask["doc_id"], leaf, row["subroot"], row["root"], proof, root, root == row["root"])):
                        out[c].append(v)
                types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.record_batch([pa.array(out[c], t) for c, t in zip(names, types)], names)

    asked = packs.select("tree", "pack", "asks")
    rows = _stored(requests, packs).join(asked, ["tree", "pack"]).select("pack", "leaves", "digest", "subroot", "root", "way", "records", "asks")
    return rows.mapInArrow(run, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def merkle_manifest(df: DataFrame, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None, column: str = "text") -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``tampered`` is what a verifier finds in ``column`` in place of what the manifest was made of (default: the same);
    folded_root is the root that follows from it and the original siblings.
    """
    found = {f: F.col(f) for f in fields}
    leaf = leaf_digest([found[f] for f in fields])
    seen = leaf if tampered is None else leaf_digest([tampered if f == column else found[f] for f in fields])
    leaves = saved(df.select(F.col(key).cast("bigint").alias("doc_id"), source_key(F.col(source)).alias("tree"), leaf.alias("digest"), seen.alias("shown")))
    most = leaves.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    levels, subroots = forest(ranked(leaves, ["doc_id", "digest"]), most, ["doc_id", "shown"])

    tops = ranked(saved(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("_order"), "digest")), ["_order"])
    upper, root = forest(tops.drop("_order"), subroots.count(), [])
    none = F.array().cast("array<string>")
    asks = root.select("tree", F.lit(0).cast("bigint").alias("pack"), "leaves", "digest", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), none.alias("way"))
    for level in range(len(upper) - 1, -1, -1):
        asks = descend(asks, upper[level], level)
    # A request for the k-th source's subroot goes on in the tree of that source; subroots differ, as their leaves hold the source.
    held = subroots.select("tree", "level", "leaves", F.col("digest").alias("subroot"))
    asks = saved(asks.select(F.col("digest").alias("subroot"), "root", "way").join(held, "subroot"))
    below = None
    for level in range(len(levels) - 1, -1, -1):
        own = asks.where(F.col("level") == level).select("tree", F.lit(0).cast("bigint").alias("pack"), "leaves", F.col("subroot").alias("digest"), "subroot", "root", "way")
        now = own if below is None else below.unionByName(own)
        if level:
            below = descend(now, levels[level], level)
    return _proofs(now, levels[0])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proofs of all documents; the texts of about half of them have lost their line ends since."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(changed, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle_manifest(read_table(spark, sf_dir, "documents"), tampered=tampered)


_FRAMED = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars"))
#: The parity of crc32 by its bits: 8 shifts for each byte of the decimal id.
_CRC = "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"
OP12_SQL = f"""WITH RECURSIVE l AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, sha256({_FRAMED} || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
  sha256({_FRAMED} || CASE WHEN text IS NULL THEN '-' ELSE strlen(shown) || ':' || shown END) AS shown
  FROM (SELECT *, CASE WHEN {_CRC} & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS shown FROM documents)),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY tree) AS n FROM l),
a AS (SELECT tree, 0 AS lvl, r, leaf AS d, n FROM r UNION ALL SELECT tree, lvl + 1, r // 3, sha256(string_agg(d, '' ORDER BY r)), (n + 2) // 3 FROM a WHERE n > 1 GROUP BY tree, lvl, r // 3, n),
s AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS r, count(*) OVER () AS n FROM a WHERE n = 1),
b AS (SELECT 0 AS lvl, r, subroot AS d, n FROM s UNION ALL SELECT lvl + 1, r // 3, sha256(string_agg(d, '' ORDER BY r)), (n + 2) // 3 FROM b WHERE n > 1 GROUP BY lvl, r // 3, n),
w AS (SELECT tree, lvl, r, coalesce(lag(d, 2) OVER z, '') || coalesce(lag(d) OVER z, '') AS h, coalesce(lead(d) OVER z, '') || coalesce(lead(d, 2) OVER z, '') AS t
  FROM (SELECT tree, lvl, r, d, n FROM a UNION ALL SELECT 'top', lvl, r, d, n FROM b) WHERE n > 1 WINDOW z AS (PARTITION BY tree, lvl, r // 3 ORDER BY r)),
c AS (SELECT doc_id, leaf, tree, 0 AS lvl, r, '' AS proof, shown AS folded, n FROM r UNION ALL
  SELECT c.doc_id, c.leaf, c.tree, c.lvl + 1, c.r // 3, c.proof || w.h || w.t, sha256(w.h || c.folded || w.t), (c.n + 2) // 3 FROM c JOIN w ON w.tree = c.tree AND w.lvl = c.lvl AND w.r = c.r WHERE c.n > 1),
e AS (SELECT c.doc_id, c.leaf, s.subroot, 0 AS lvl, s.r, c.proof, c.folded, s.n FROM c JOIN s USING (tree) WHERE c.n = 1 UNION ALL
  SELECT e.doc_id, e.leaf, e.subroot, e.lvl + 1, e.r // 3, e.proof || w.h || w.t, sha256(w.h || e.folded || w.t), (e.n + 2) // 3 FROM e JOIN w ON w.tree = 'top' AND w.lvl = e.lvl AND w.r = e.r WHERE e.n > 1)
SELECT e.doc_id, leaf, subroot, b.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b.d AS verified FROM e, b WHERE e.n = 1 AND b.n = 1"""
