"""Page files to blocks, grids, amounts and chunks; rectangles."""

import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from corvane.operators import pages as P

HTML = """<table><thead><tr><th rowspan=2>Fund</th><th colspan="2">FY 2024 actual</th><th>FY '25</th><th>2026 Request</th><th>Note</th></tr>
<tr><td>a<br>b</td><td> x </td><td>1</td></tr></thead><tr><td colspan=2 rowspan="2">General &amp; other</td><td>$1,234.5</td><td>(7)</td><td>-</td><td>n</td></tr><tr><td>5</td></table>"""


def test_grid_of_spans():
    assert P.grid(P.html_cells(HTML)) == [
        ["Fund", "FY 2024 actual", "FY 2024 actual", "FY '25", "2026 Request", "Note"],
        ["Fund", "a b", "x", "1", "", ""],
        ["General & other", "General & other", "$1,234.5", "(7)", "-", "n"],
        ["General & other", "General & other", "5", "", "", ""],
    ]
    assert P.grid(P.html_cells("")) == [] and P.grid(P.html_cells("<td>lone<td>cells")) == [["lone", "cells"]]
    assert P.grid(P.html_cells("<tr><td rowspan=9 colspan=x>a</td></tr>")) == [["a"]]


def test_years_and_amounts(spark):
    said = ["FY 2024", "fy24 actual", "FY '99", "2031", "Part 20240", "none", "FY 3", None]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(said)], "i int, h string").select("i", P.year_of(F.col("h")).alias("y")).collect()
    assert [r["y"] for r in sorted(rows)] == [2024, 2024, 1999, 2031, None, None, None, None]
    tables = P.grids(P.table_cells(spark.createDataFrame([(1, HTML), (2, None), (3, "<table><tr><td>no years</td></tr><tr><td>9</td></tr></table>")], "id long, html string"), ["id"], "html"), ["id"])
    got = {(r["id"], r["line"], r["label"], r["fiscal_year"], r["amount"]) for r in P.amounts_by_year(tables, ["id"]).collect()}
    assert got == {(1, 1, "Fund", 2025, 1.0), (1, 2, "General & other", 2024, 1234.5), (1, 2, "General & other", 2025, -7.0), (1, 3, "General & other", 2024, 5.0)}


def pages_folder(tmp_path):
    cell = lambda text, page=1, **more: {"kids": [{"content": text, "kids": [{"content": "deep"}] if text == "kid" else []}], "page number": page, **more}
    one = {"page": 1, "blocks": [
        {"type": "paragraph", "content": "before all headings"}, {"type": "heading", "level": "Doctitle", "content": "Book"}, {"type": "heading", "heading level": 2, "content": "Part  one"},
        {"type": "paragraph", "content": "w " * 30}, {"type": "paragraph", "content": "v " * 30}, {"type": "paragraph", "content": "  "}, {"type": "image"},
        {"type": "table", "caption": {"content": "Cap"}, "rows": [{"cells": [cell("Fund"), cell("FY 2024")]}, {"cells": [cell("kid"), cell("1,000", 2)]}]},
    ]}
    two = {"page": 2, "blocks": [{"type": "text", "text": "after the turn", "text_level": 0}, {"type": "text", "text": "Part two", "text_level": 2}, {"type": "text", "text": "end"}, {"type": "table", "table_body": HTML, "table_caption": "Marked up"}]}
    folder = tmp_path / "book"
    folder.mkdir()
    (folder / "page-1.json").write_text(json.dumps(one))
    (folder / "page-2.json").write_text(json.dumps(two))
    (folder / "page-10.json").write_text("{broken")
    (folder / "notes.json").write_text(json.dumps(one))
    return str(tmp_path)


def test_files_to_chunks_and_amounts(spark, tmp_path):
    blocks = P.read_pages(spark, pages_folder(tmp_path)).cache()
    listed = [(r["page"], r["kind"], r["level"]) for r in blocks.orderBy("page", "at").collect()]
    assert listed == [(1, "paragraph", None), (1, "heading", 1), (1, "heading", 2), (1, "paragraph", None), (1, "paragraph", None), (1, "table", None), (2, "paragraph", None), (2, "heading", 2), (2, "paragraph", None), (2, "table", None)]
    chunks = P.build_chunks(blocks, target=20).orderBy("n").collect()
    assert [(r["chunk_id"], r["is_table"], list(r["section"]), r["page"]) for r in chunks] == [
        ("book-0000", True, ["Book", "Part one"], 1), ("book-0001", True, ["Book", "Part two"], 2), ("book-0002", False, [], 1),
        ("book-0003", False, ["Book", "Part one"], 1), ("book-0004", False, ["Book", "Part one"], 1), ("book-0005", False, ["Book", "Part one"], 2), ("book-0006", False, ["Book", "Part two"], 2),
    ]
    assert chunks[0]["text"] == "Book > Part one\nCap\nFund\tFY 2024\nkid deep\t1,000"
    assert len(P.build_chunks(blocks, target=1000).collect()) == 6  # both paragraphs of a section in one
    tables = blocks.where("kind = 'table'").select("doc", "page", "cells")
    amounts = {(r["page"], r["label"], r["fiscal_year"], r["amount"]) for r in P.amounts_by_year(P.grids(tables, ["doc", "page"]), ["doc", "page"]).collect()}
    assert (1, "kid deep", 2024, 1000.0) in amounts and (2, "General & other", 2025, -7.0) in amounts
    turned = tables.where("page = 1").select(*(P.cells_on_page(F.col("cells"), F.lit(p)).alias(f"p{p}") for p in (1, 2, 3))).first()
    assert [(c["row"], c["col"], c["text"]) for c in turned["p2"]] == [(0, 1, "1,000")] and len(turned["p1"]) == 3 and turned["p3"] is None
    blocks.unpersist()


def test_sections_of_deep_headings_in_one_written_table(spark):
    from corvane.sources.shared import shared_folder

    rng = random.Random(5)
    levels = [rng.choice([1, 2, 3, 4, 6, 7, None]) for _ in range(40)]
    rows, heads, want = [], [], {}
    for i, level in enumerate(levels):
        rows += [("d", 1, 2 * i, "heading", level, f"h{i}", None), ("d", 1, 2 * i + 1, "paragraph", None, f"p{i}", None)]
        heads.append((level, f"h{i}"))
        path, now = [heads[-1][1]], level
        for k, title in reversed(heads[:-1]):
            if now is not None and k is not None and k < now and k <= 6:
                path.insert(0, title)
                now = k
        want[f"p{i}"] = path
    tables = Path(shared_folder(spark)[5:] if shared_folder(spark).startswith("file:") else shared_folder(spark)) / "tables"
    before = len(list(tables.glob("*")))
    got = {r["text"]: list(r["section"]) for r in P.build_chunks(spark.createDataFrame(rows, P.BLOCKS)).collect()}
    assert got == want and len(list(tables.glob("*"))) == before + 1  # no table for each round of paths


def test_chunks_are_made_where_blocks_are_dealt(spark, monkeypatch):
    """F6 of round 4: blocks are exchanged once, tables as text, and chunks go on over Arrow batches."""
    plans, save = [], P.saved
    monkeypatch.setattr(P, "saved", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        cells = [{"row": r, "col": c, "row_span": 1, "col_span": 1, "text": f"{r}{c}", "page": 1} for r in range(2) for c in range(2)]
        rows = []
        for d in ("a", "b", None):
            kinds = [("paragraph", None, "x" * 40), ("heading", 1, "H"), *[("paragraph", None, "y" * 40 + str(i)) for i in range(5)], ("paragraph", None, None), ("table", None, "T"), ("paragraph", None, "z" * 400), ("other", None, "o"), ("paragraph", None, "end")]
            rows += [(d, 1 + (i > 9), i, kind, level, text, cells if kind == "table" else None) for i, (kind, level, text) in enumerate(kinds)]
        got = [tuple(r)[1:] for r in P.build_chunks(spark.createDataFrame(rows, P.BLOCKS), target=30).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    y = ["y" * 40 + str(i) for i in range(5)]
    want = [(True, ["H"], 1, "H\nT\n00\t01\n10\t11"), (False, [], 1, "x" * 40), (False, ["H"], 1, f"{y[0]}\n\n{y[1]}\n\n{y[2]}"), (False, ["H"], 1, f"{y[3]}\n\n{y[4]}"), (False, ["H"], 1, "z" * 400), (False, ["H"], 2, "end")]
    assert sorted(map(repr, got)) == sorted(repr((d, n, *w)) for d in ("a", "b", None) for n, w in enumerate(want))
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1
    assert "cells" not in plans[0].split("Exchange hashpartitioning")[0]


def test_no_pages(spark):
    assert P.build_chunks(spark.createDataFrame([], P.BLOCKS)).count() == 0


def test_touching_equals_all_pairs(spark):
    rng = random.Random(3)

    def boxes(n):
        out = []
        for i in range(n):
            x, y = rng.uniform(-300, 900), rng.uniform(-300, 900)
            out.append((rng.randint(0, 1), i, [x, y, x + rng.choice([1.0, 30.0, 350.0]), y + rng.uniform(1, 60)]))
        return out

    left, right = boxes(60), boxes(80)
    df = P.touching(spark.createDataFrame(left, "p int, a int, box array<double>"), spark.createDataFrame(right, "p int, b int, box array<double>"), ["p"])
    assert not any(x in df._jdf.queryExecution().toString() for x in ("NestedLoop", "Cartesian"))
    got = sorted((r["a"], r["b"]) for r in df.collect())
    want = sorted((i, j) for p, i, a in left for q, j, b in right if p == q and a[0] - 8 < b[2] and a[2] + 8 > b[0] and a[1] - 8 < b[3] and a[3] + 8 > b[1])
    assert got == want and len(want) > 20


def test_touching_classes_hold_all_pairs_of_rows(spark, tmp_path):
    """equal rectangles are one class, so pairs don't grow with the square of the copies; classes and members give back all pairs of rows."""
    rng = random.Random(7)
    rows = [(rng.randint(0, 1), i, [x, y, x + 20.0, y + 9.0]) for i in range(300) for x, y in [(rng.choice([0.0, 15.0, 90.0, 250.0]), rng.choice([0.0, 40.0]))]]
    odd = [(0, 400, [5.0, None, 9.0, 9.0]), (None, 401, [0.0, 0.0, 20.0, 9.0]), (1, 402, None), (1, 403, [0.0, 0.0, -30.0, 9.0]), (1, 404, [0.0, 0.0, -30.0, 9.0])]
    out = P.touching_classes(spark.createDataFrame(rows + odd, "page int, id int, box array<double>"), ["page"]).collect()
    members, pairs = {}, [(r["page"], r["a"], r["b"]) for r in out if r["kind"] == "pair"]
    for r in out:
        if r["kind"] == "member":
            members.setdefault((r["page"], r["a"]), []).append(r["b"])
    got = [(min(i, j), max(i, j)) for p, a, b in pairs for i in members[p, a] for j in members[p, b] if (i < j if a == b else True)]
    whole = [r for r in rows + odd[3:]]
    want = sorted((i, j) for p, i, a in whole for q, j, b in whole if p == q and i < j and a[0] - 8 < b[2] and a[2] + 8 > b[0] and a[1] - 8 < b[3] and a[3] + 8 > b[1])
    assert sorted(got) == want and len(want) > 3000 and len(pairs) < 60
    assert sorted(i for m in members.values() for i in m) == [*range(300), 403, 404] and all(a == min(m) for (_, a), m in members.items())

    parts = [(1, i + 900 * c, [float(i * 37 % 900), float(i * 53 % 900), i * 37 % 900 + 5.0 + i % 3, i * 53 % 900 + 7.0 + i % 2]) for i in range(60) for c in range(5)]
    counts = {r["kind"]: r["count"] for r in P.touching_classes(spark.createDataFrame(parts, "page int, id int, box array<double>"), ["page"]).groupBy("kind").count().collect()}
    assert counts["member"] == 300 and counts["pair"] <= 60 * 61 / 2


def test_touching_boxes_are_all_pairs_of_rows(spark, monkeypatch, tmp_path):
    """F7 of round 4: every pair of rows is a row, copies of a rectangle too, also where a class has several lists."""
    from corvane.plans.pages import touching_boxes

    monkeypatch.setattr(P, "LISTED", 2)
    parts = [(i + 900 * c, f"Brand#{i % 2}", 5 + i % 3, "x" * (7 + i % 2)) for i in range(60) for c in range(5)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    boxes = {i: (brand, i * 37 % 900, i * 53 % 900, i * 37 % 900 + w, i * 53 % 900 + len(name)) for i, brand, w, name in parts}
    want = sorted((p[0], i, j) for i, p in boxes.items() for j, q in boxes.items() if i < j and p[0] == q[0] and p[1] - 8 < q[3] and p[3] + 8 > q[1] and p[2] - 8 < q[4] and p[4] + 8 > q[2])
    df = touching_boxes(spark, str(tmp_path))
    assert df.columns == ["page", "a", "b"]
    assert sorted(tuple(r) for r in df.collect()) == want and len(want) >= 60 * 10


def test_boxes_are_cut_and_joined(spark):
    box = lambda b: spark.createDataFrame([(b,)], "b array<double>").select(P.rescaled(F.col("b"), F.lit(600.0), F.lit(800.0)).alias("r")).first()["r"]
    assert box([100.0, 250.0, 1200.0, 500.0]) == [60.0, 200.0, 600.0, 400.0]
    assert box([-50.0, -10.0, -1.0, 500.0]) is None
    items = spark.createDataFrame([(1, [0.0, 10.1, 5.0, 12.0]), (1, [6.0, 9.9, 9.0, 13.0]), (1, [0.0, 20.0, 3.0, 22.0])], "p int, box array<double>")
    assert {(r["line"], tuple(r["box"])) for r in P.line_boxes(items, ["p"]).collect()} == {(10, (0.0, 9.9, 9.0, 13.0)), (20, (0.0, 20.0, 3.0, 22.0))}


def test_plain_markup_is_read_as_the_parser_reads_it(spark):
    """plain tables are read by one expression, others by the parser; a header's years are looked for once."""
    rng = random.Random(4)
    pieces = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", '<td colspan="2">', '<td rowspan="2">', '<td colspan="0" rowspan="3" colspan="2">', "<thead>", "</tbody>", " a  b ", "FY 2020", "x\n", "1 > 0", "&amp;", "<b>", "<br>", "<TD>", "<!-- c -->", "<td colspan=3>"]
    plain = 0
    for _ in range(3000):
        html = "".join(rng.choices(pieces, [6] * 12 + [3] * 3 + [0.3] * 7, k=rng.randint(0, 14)))
        parser = P._Table()
        parser.feed(html)
        parser.close()
        own = P._plain_rows(html)
        plain += own is not None and own != []
        assert own is None or own == parser.rows
        assert P.html_cells(html) == P.placed(parser.rows)
    assert plain > 300
    html = '<table><tr><th>Part</th><th>FY 2020</th><th>FY 21 actual</th></tr><tr><td>a</td><td>$1.50</td><td></td></tr><tr><td>b</td><td colspan="2">7</td></tr></table>'
    rows = spark.createDataFrame([(1, html), (2, "<table></table>"), (3, None)], "k int, html string")
    by_grid = P.table_grids(rows, ["k"], "html")
    assert sorted(map(repr, by_grid.collect())) == sorted(map(repr, P.grids(P.table_cells(rows, ["k"], "html"), ["k"]).collect()))
    df = P.amounts_by_year(by_grid, ["k"])
    assert sorted(tuple(r) for r in df.collect()) == [(1, 1, "a", 2020, 1.5), (1, 2, "b", 2020, 7.0), (1, 2, "b", 2021, 7.0)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 2
