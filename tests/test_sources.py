"""Readers and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.sources import readers, sinks


def test_jsonl_skips_damaged_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"user":"a","n":1}\n\n{broken\n[1]\n"x"\n{"user":"b"}\n')
    rows = readers.read_jsonl(spark, str(tmp_path), "user string, n int").collect()
    assert sorted((r.user, r.n) for r in rows) == [("a", 1), ("b", None)]


def test_transcript_stops_at_first_malformed_line(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"kind":"meta"}\n{"kind":"event","i":1}\nnot json\n{"kind":"event","i":2}\n')
    (tmp_path / "u.jsonl").write_text('{"kind":"meta"}\n{"kind":"terminal"}\n')
    rows = readers.read_transcripts(spark, str(tmp_path)).collect()
    kinds = {n: [r.kind for r in sorted(rows, key=lambda r: r.line) if r.file.endswith(n)] for n in ("t.jsonl", "u.jsonl")}
    assert kinds == {"t.jsonl": ["meta", "event", "_error"], "u.jsonl": ["meta", "terminal"]}


def test_page_blocks(spark, tmp_path):
    page = {"page": 3, "blocks": [{"type": "text", "text": "Head", "text_level": 1}, {"type": "text", "text": "body"}, {"type": "table", "table_body": "<t>"}, {"type": "odd", "text": "x"}]}
    (tmp_path / "page-3.json").write_text(json.dumps(page))
    rows = readers.read_page_blocks(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.page, r.kind, r.level, r.text) for r in rows] == [(3, "heading", 1, "Head"), (3, "paragraph", 0, "body"), (3, "table", 0, "<t>")]


def test_overlay(spark):
    shipped = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    added = spark.createDataFrame([(2, "B"), (3, ""), (4, None)], "k int, v string")
    good, bad = readers.overlay(shipped, added, "k", F.col("v") != "")
    assert sorted(map(tuple, good.collect())) == [(1, "a"), (2, "B")]
    assert bad.count() == 2


def test_versioned_table(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None and t.delete(F.lit(True)) is None
    row = lambda *x: spark.createDataFrame(list(x), "doc_id int, v string, pos int")
    t.write(row((1, "a", 0), (2, "b", 0)))
    t.upsert(row((2, "c", 1), (2, "d", 2), (3, "e", 0)), "doc_id", "pos")
    assert sorted((r.doc_id, r.v) for r in t.read().collect()) == [(1, "a"), (2, "d"), (3, "e")]
    t.delete(F.col("doc_id") == 1)
    t.replace_document(3, row((3, "x", 0), (3, "y", 1)))
    assert sorted((r.doc_id, r.v) for r in t.read().collect()) == [(2, "d"), (3, "x"), (3, "y")]
    with pytest.raises(ValueError):
        t.replace_document(3, row((4, "z", 0)))
    t.restore(1)
    assert t.read().count() == 2
    t.compact(10)
    assert t.versions() == [1, 2, 3, 4, 5, 6]
    assert t.prune(2) == [1, 2, 3, 4] and t.versions() == [5, 6]


def test_runs_append_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    for _ in range(2):
        sinks.append_runs(spark.createDataFrame([("r1", 1.0), ("r2", 2.0)], "run string, v double"), path, "run")
    assert spark.read.parquet(path).count() == 2


def test_ledger_and_hashes(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "user string, n int")
    sinks.append_ledger(df, str(tmp_path / "l"), F.lit("2024-01"))
    sinks.append_ledger(df, str(tmp_path / "l"), F.lit("2024-01"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    sinks.write_chunk_files(spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "doc_id int, text string"), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).where("doc_id = 1").count() == 2
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert readers.read_content_hashes(spark, str(tmp_path / "f.bin")).first()["sha256"].startswith("ba7816bf")
