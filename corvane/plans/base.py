"""Registration of queries, and the views that stand for a document corpus on the given tables.

Chunks are a document's lines; lang plays the document type, source the publisher, and the fiscal year is
``2005 + doc_id % 23``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.retrieval import tokenised
from corvane.sources.shared import built_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a query under its function's name, with the DuckDB SQL that it must equal."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("doc_type"), F.col("source").alias("publisher"), (2005 + F.col("doc_id") % 23).cast("int").alias("fiscal_year"), "n_chars")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.col("lang").alias("doc_type"), F.col("source").alias("publisher"), (2005 + F.col("doc_id") % 23).cast("int").alias("fiscal_year"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.where(F.col("text") != "").withColumn("chunk_id", F.format_string("%d-%04d", "doc_id", "pos"))


#: The same views for DuckDB, to be put before a SELECT.
META_SQL = "meta AS (SELECT doc_id, lang AS doc_type, source AS publisher, (2005 + doc_id % 23)::INT AS fiscal_year, n_chars FROM documents)"
CHUNKS_SQL = """chunks AS (
  SELECT doc_id, lang AS doc_type, source AS publisher, (2005 + doc_id % 23)::INT AS fiscal_year, (u.i - 1)::INT AS pos, u.t AS text,
    doc_id::VARCHAR || '-' || lpad((u.i - 1)::VARCHAR, greatest(4, length((u.i - 1)::VARCHAR))::INT, '0') AS chunk_id
  FROM (SELECT *, unnest(list_zip(range(1, len(string_split(text, chr(10))) + 1), string_split(text, chr(10)))) AS z FROM documents), LATERAL (SELECT z[1] AS i, z[2] AS t) u
  WHERE u.t <> ''
)"""


def listed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, tokens, doc_type, fiscal_year`` of all chunks, written once a session for a documents table: the index of the lexical searches."""
    return built_once(tokenised(chunks(spark, sf_dir), more=["doc_type", "fiscal_year"]), "tokens", f"{sf_dir}/documents.parquet")
