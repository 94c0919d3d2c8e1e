"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space that ends a word: space and \t \n \v \f \r.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


BATCH_ROWS = 500


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``. Rows of text are long, so the session's Arrow batches are made small: that keeps workers and buffers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables: that of ``spark.checkpoint.dir``.

    Where the session names none, a local master (tests, a laptop) gets a temporary folder; on a cluster that would be
    one machine's own, so it is an error there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Partitions that hold about ``per_partition`` rows each, at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition), 1)


def released(run: Callable, before: Callable = lambda: None) -> Callable:
    """``run`` over Arrow batches, after whose end (and that of ``before``) the worker gives free memory back: it lives on for the next stage."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            before()
            give_back()

    return held


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call in this C library
        pass


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, max_bytes: int, max_rows: int = 1 << 30):
    """Row ranges of at most ``max_rows`` texts that hold about ``max_bytes`` together; a longer text is alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = min(max(start + 1, int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1), start + max_rows)
        yield start, min(end, n)
        start = min(end, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_SALT = np.uint64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of ``data[start:end]`` for every span.

    Spans of up to eight bytes are read as one integer and mixed, which no two such spans of one length share; longer
    ones, of which there are far fewer, get the first eight bytes of their BLAKE2b digest. None of it is linear.
    """
    size = ends - starts
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    tail = min(len(data), 8)
    padded = np.concatenate([data[-tail:], np.zeros(8, np.uint8)])
    near_end = starts > len(data) - 8
    word = np.empty(len(starts), np.uint64)
    if len(data) >= 8:
        lanes = np.lib.stride_tricks.as_strided(np.ascontiguousarray(data).view(np.uint8), (len(data) - 7, 8), (1, 1))
        word[~near_end] = np.ascontiguousarray(lanes[starts[~near_end]]).view("<u8").ravel()
    if near_end.any():
        at = starts[near_end] - (len(data) - tail)
        word[near_end] = np.ascontiguousarray(padded[at[:, None] + np.arange(8)]).view("<u8").ravel()
    word &= _FIRST_BYTES[np.minimum(size, 8)]
    out = mix64(mix64(word + np.uint64(seed * int(_SALT) % (1 << 64))) + size.astype(np.uint64) * _SALT)
    long = np.flatnonzero(size > 8)
    if len(long):
        raw, key = data.tobytes(), seed.to_bytes(8, "little")
        known: dict[bytes, int] = {}
        found = []
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            own = raw[a:b]
            value = known.get(own)
            if value is None:
                value = known[own] = int.from_bytes(blake2b(own, digest_size=8, key=key).digest(), "little")
            found.append(value)
        out[long] = np.array(found, np.uint64)
    return out


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the n + 1 offsets of each row's words; ends_word tells the bytes that part words."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~ends_word[data]
    step = np.diff(inside)
    begins = step == 1
    stops = step == -1
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]  # words that meet at a row's border
    begins[cut] = True
    stops[cut] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, offsets)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage is cut, columns can be pruned."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
