"""Versioned tables: a write is a new version folder, complete once Spark has put _SUCCESS there, so readers never see half of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.corpus import upsert


class VersionedTable:
    """A Parquet table at ``root`` with folders ``v00000001``, ``v00000002``, ...; the newest complete one is current.

    One writer at a time is assumed. Works on any file system that Spark can list.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(root)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._new_path = jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self._fs.exists(self._new_path(f"{self.root}/{n}/_SUCCESS")))

    def folder(self, version: int) -> str:
        return f"{self.root}/v{version:08d}"

    def read(self, version: int | None = None) -> DataFrame | None:
        """The current (or a given) version; None if there is none: a missing table is never made by reading it."""
        have = self.versions()
        if not have or (version is not None and version not in have):
            return None
        return self.spark.read.parquet(self.folder(have[-1] if version is None else version))

    def write(self, df: DataFrame, partitions: int | None = None) -> int:
        have = self.versions()
        version = (have[-1] if have else 0) + 1
        (df.repartition(partitions) if partitions else df).write.mode("overwrite").parquet(self.folder(version))
        return version

    def upsert(self, rows: DataFrame, key: str, order: str) -> int:
        """Put rows over the current ones by key; of several of a key the last by ``order``."""
        now = self.read()
        return self.write(upsert(now if now is not None else rows.limit(0), rows, key, order))

    def delete(self, condition: Column) -> int | None:
        now = self.read()
        return None if now is None else self.write(now.where(~F.coalesce(condition, F.lit(False))))

    def replace_document(self, doc_id, rows: DataFrame, column: str = "doc_id") -> int:
        """All rows of one document replaced; rows of another document are refused."""
        if rows.where(~F.col(column).eqNullSafe(F.lit(doc_id))).limit(1).count():
            raise ValueError(f"rows of another {column} than {doc_id}")
        now = self.read()
        return self.write(rows if now is None else now.where(F.col(column) != doc_id).unionByName(rows))

    def compact(self, rows_per_file: int) -> int | None:
        now = self.read()
        return None if now is None else self.write(now, max(1, -(-now.count() // rows_per_file)))

    def restore(self, version: int) -> int:
        old = self.read(version)
        if old is None:
            raise ValueError(f"no version {version}")
        return self.write(old)

    def prune(self, keep: int = 5) -> list[int]:
        """Drop all but the newest ``keep`` versions."""
        gone = self.versions()[: -max(keep, 1)]
        for v in gone:
            self._fs.delete(self._new_path(self.folder(v)), True)
        return gone


def append_ledger(df: DataFrame, path: str, month: Column) -> None:
    """Append JSON lines by month."""
    df.withColumn("month", month).write.mode("append").partitionBy("month").json(path)


def append_runs(df: DataFrame, path: str, key: str) -> None:
    """Append rows whose key isn't there yet: writing a run twice changes nothing."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    df.write.mode("append").parquet(path)


def write_chunk_files(chunks: DataFrame, path: str, doc: str = "doc_id") -> None:
    """JSON lines, a folder per document."""
    chunks.repartition(doc).write.mode("overwrite").partitionBy(doc).json(path)


def staged_name(content: Column, suffix: Column) -> Column:
    """Content-addressed place of a file: its hash's first two digits, then the hash."""
    h = F.sha2(content, 256)
    return F.concat(F.substring(h, 1, 2), F.lit("/"), h, suffix)
