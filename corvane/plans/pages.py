"""Pages and tables: an order is a document with a heading for each year of its lines, a paragraph a line, and a table of amounts by year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import pages as P
from corvane.plans.base import query, table

LAST = 2**31 - 1

_LINES_SQL = """l AS (SELECT l_orderkey AS k, year(l_shipdate) AS y, l_partkey AS p, l_suppkey AS s, l_extendedprice AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem)"""


def _lines(spark, sf_dir: str) -> DataFrame:
    """``k, lines, years``: an order's lines by day of shipment, and the years of these."""
    line = F.struct("l_shipdate", "l_linenumber", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("v"), F.year("l_shipdate").alias("y"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(line)).alias("lines")).withColumn("years", F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["y"]))))


def _markup(lines: DataFrame) -> DataFrame:
    """A table with a column a year: what a line has no amount for is one empty cell that spans the columns before or after."""
    years = F.col("years")
    head = F.concat(F.lit("<table><tr><th>Part</th>"), F.array_join(F.transform(years, lambda y: F.format_string("<th>FY %d actual</th>", y)), ""), F.lit("</tr>"))
    gap = lambda n: F.when(n > 0, F.format_string('<td colspan="%d"></td>', n)).otherwise("")

    def row(x):
        at = F.array_position(years, x["y"]).cast("int")
        return F.concat(F.format_string("<tr><td>part %d</td>", x["p"]), gap(at - 1), F.format_string("<td> $%s </td>", F.format_number(x["v"], 2)), gap(F.size(years) - at), F.lit("</tr>"))

    return lines.select("k", F.concat(head, F.array_join(F.transform("lines", row), ""), F.lit("</table>")).alias("html"))


@query(f"WITH {_LINES_SQL} SELECT k, i::INT AS line, 'part ' || p AS label, y::INT AS fiscal_year, round(v, 2) AS amount FROM l")
def table_amounts(spark, sf_dir: str) -> DataFrame:
    """Tables of markup with spans to grids, their header's years found, their amounts unpivoted."""
    return P.amounts_by_year(P.table_grids(_markup(_lines(spark, sf_dir)), ["k"], "html"), ["k"])


@query(f"""WITH {_LINES_SQL}, years AS (SELECT DISTINCT k, y FROM l), head AS (SELECT k, string_agg('FY ' || y || ' actual', chr(9) ORDER BY y) AS h FROM years GROUP BY k),
cell AS (SELECT l.*, (SELECT count(*) FROM years b WHERE b.k = l.k AND b.y < l.y) AS before, (SELECT count(*) FROM years b WHERE b.k = l.k AND b.y > l.y) AS after FROM l),
body AS (SELECT k, string_agg('part ' || p || chr(9) || CASE WHEN before > 0 THEN chr(9) ELSE '' END || '$' || format('{{:,.2f}}', v) || CASE WHEN after > 0 THEN chr(9) ELSE '' END, chr(10) ORDER BY i) AS t, max(y) AS last FROM cell GROUP BY k),
t AS (SELECT k, 0 AS n, true AS is_table, 'Order ' || k || ' > FY ' || last AS section, 'Order ' || k || ' > FY ' || last || chr(10) || 'Amounts' || chr(10) || 'Part' || chr(9) || h || chr(10) || t AS text FROM body JOIN head USING (k)),
x AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY y) AS n, false AS is_table, 'Order ' || k || ' > FY ' || y AS section, string_agg('Part ' || p || ' of supplier ' || s || '.', chr(10) || chr(10) ORDER BY i) AS text FROM l GROUP BY k, y)
SELECT k || '-' || lpad(n::VARCHAR, 4, '0') AS chunk_id, n, is_table, section, text FROM (SELECT * FROM t UNION ALL SELECT * FROM x)""")
def built_chunks(spark, sf_dir: str) -> DataFrame:
    """Blocks of pages to chunks: tables first, then the text of each section."""
    o = _lines(spark, sf_dir)
    block = lambda kind, level, text: F.struct(F.lit(kind).alias("kind"), F.lit(level).cast("int").alias("level"), text.alias("text"))
    years = F.col("years")
    per_year = F.flatten(F.transform(years, lambda y: F.concat(F.array(block("heading", 2, F.format_string("FY %d", y))), F.transform(F.filter("lines", lambda x: x["y"] == y), lambda x: block("paragraph", None, F.format_string("Part %d of supplier %d.", x["p"], x["s"]))))))
    listed = F.concat(F.array(block("heading", 1, F.format_string("Order %d", "k"))), per_year)
    blocks = o.select(F.col("k").cast("string").alias("doc"), F.posexplode(listed).alias("at", "b")).select("doc", F.lit(1).alias("page"), "at", "b.*", F.lit(None).cast(P.CELLS).alias("cells"))
    # The table comes last, after the order's heading, years and lines.
    table_ = P.table_cells(_markup(o).withColumn("at", F.lit(LAST)), ["k", "at"], "html")
    table_ = table_.select(F.col("k").cast("string").alias("doc"), F.lit(1).alias("page"), "at", F.lit("table").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit("Amounts").alias("text"), "cells")
    chunks = P.build_chunks(blocks.unionByName(table_))
    return chunks.select("chunk_id", F.col("n").cast("long").alias("n"), "is_table", F.array_join("section", " > ").alias("section"), "text")


@query("""WITH r AS (SELECT p_partkey AS id, p_brand AS page, (p_partkey * 37 % 900)::DOUBLE AS x, (p_partkey * 53 % 900)::DOUBLE AS y, p_size::DOUBLE AS w, length(p_name)::DOUBLE AS h FROM part)
SELECT a.page, a.id AS a, b.id AS b FROM r a JOIN r b ON a.page = b.page AND a.id < b.id WHERE a.x - 8 < b.x + b.w AND a.x + a.w + 8 > b.x AND a.y - 8 < b.y + b.h AND a.y + a.h + 8 > b.y""")
def touching_boxes(spark, sf_dir: str) -> DataFrame:
    """Rectangles of a page (parts of a brand, laid out by key) that overlap within a slack, through a grid: all pairs of rows, met by classes of equal rectangles."""
    x, y = (F.pmod(F.col("p_partkey") * n, F.lit(900)).cast("double") for n in (37, 53))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("id"), F.array(x, y, x + F.col("p_size"), y + F.length("p_name")).alias("box"))
    return P.touching_rows(rows, ["page"])
