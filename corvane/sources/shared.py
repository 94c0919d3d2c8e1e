"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """That of ``spark.checkpoint.dir``. Where none is set a local master gets a temporary folder; on a cluster it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    path = new_folder(df.sparkSession, "tables")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """A written table, marked for a broadcast if it has at most ``max_rows`` rows; else the join shuffles."""
    return F.broadcast(df) if df.count() <= max_rows else df


def dealt(df: DataFrame) -> DataFrame:
    """Marked for a join by exchange and sort: the files of a written table of keys are so small that Spark would gather millions of its rows in the driver to broadcast them."""
    return df.hint("merge")


_built: dict[tuple[str, str, tuple], DataFrame] = {}


def built_once(df: DataFrame, name: str, path: str) -> DataFrame:
    """``df``, derived from the files of ``path`` alone, written once for as long as these files stay as they are."""
    spark = df.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    mark = files.agg(F.count("*"), F.sum("length"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, f"{name} {path}", tuple(mark))
    if key not in _built:
        _built[key] = saved(df)
    return _built[key]
