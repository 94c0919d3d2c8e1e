"""Readers for ledgers, journals, transcripts and extracted pages. Damaged lines are dropped one at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "type string, text string, text_level int, table_body string, bbox array<double>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines that are objects of ``schema``; blank lines, broken JSON and other values are left out."""
    parsed = spark.read.text(path).where(F.btrim("value").startswith("{")).select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r IS NOT NULL AND r._bad IS NULL").select("r.*").drop("_bad")


def read_json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per file; unreadable files are dropped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, kind, body`` of JSONL transcripts. A file ends at its first malformed line, where an ``_error`` line stands."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "body")).where(F.btrim("body") != "")
    kind = F.get_json_object("body", "$.kind")
    marked = lines.select("file", "line", "body", kind.alias("kind"))
    first_bad = marked.where("kind IS NULL").groupBy("file").agg(F.min("line").alias("stop"))
    kept = marked.join(first_bad, "file", "left").where("stop IS NULL OR line < stop").drop("stop")
    errors = first_bad.select("file", F.col("stop").alias("line"), F.lit(None).cast("string").alias("body"), F.lit("_error").alias("kind"))
    return kept.unionByName(errors).select("file", "line", "kind", "body")


def read_page_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``file, page, pos, kind, level, text`` of page files that hold a list of blocks; unknown block types are dropped."""
    pages = spark.read.schema(f"page int, blocks array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    blocks = pages.select(F.col("_metadata.file_path").alias("file"), "page", F.posexplode("blocks").alias("pos", "b")).where(F.col("b.type").isin("text", "table", "image"))
    kind = F.when((F.col("b.type") == "text") & (F.col("b.text_level") > 0), "heading").when(F.col("b.type") == "text", "paragraph").otherwise(F.col("b.type"))
    return blocks.select("file", "page", "pos", kind.alias("kind"), F.coalesce("b.text_level", F.lit(0)).alias("level"), F.coalesce("b.text", "b.table_body").alias("text"))


def read_content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of files: what a content-addressed cache or a manifest check compares."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def overlay(shipped: DataFrame, added: DataFrame, key: str, valid) -> tuple[DataFrame, DataFrame]:
    """``shipped`` rows with valid ``added`` rows over them by key, and the added rows that aren't valid."""
    good, bad = added.where(valid), added.where(~F.coalesce(valid, F.lit(False)))
    return shipped.join(good.select(key), key, "left_anti").unionByName(good), bad


