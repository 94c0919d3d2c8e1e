"""Figures of answers: an order's lines are the sources, its answer states prices, sums and changes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import figures as G
from corvane.plans.base import query, table
from corvane.sources.shared import dealt

_LINES_SQL = """o AS (SELECT l_orderkey AS k, list(l_extendedprice ORDER BY l_linenumber, l_extendedprice, l_suppkey) AS p, list(l_suppkey ORDER BY l_linenumber, l_extendedprice, l_suppkey) AS s FROM lineitem GROUP BY l_orderkey),
v AS (SELECT k, unnest(range(1, len(p) + 1))::INT AS i, unnest(p) AS v, unnest(s) AS doc_id FROM o)"""
#: Every way to the targets t (k, n, goal, tol) by the values of w (k, i, v), the first by rank.
_DERIVED_SQL = """c AS (SELECT t.k, t.n, 1 AS step, 'sum' AS operation, [a.i] AS inputs, a.i AS x, 0 AS y, 0 AS z FROM t JOIN w a USING (k) WHERE abs(a.v - goal) <= tol
  UNION ALL SELECT t.k, t.n, 2, 'sum', [a.i, b.i], a.i, b.i, 0 FROM t JOIN w a USING (k) JOIN w b USING (k) WHERE a.i < b.i AND abs(a.v + b.v - goal) <= tol
  UNION ALL SELECT t.k, t.n, 3, 'sum', [a.i, b.i, c.i], a.i, b.i, c.i FROM t JOIN w a USING (k) JOIN w b USING (k) JOIN w c USING (k) WHERE a.i < b.i AND b.i < c.i AND abs(a.v + b.v + c.v - goal) <= tol
  UNION ALL SELECT t.k, t.n, 4, 'difference', [a.i, b.i], a.i, b.i, 0 FROM t JOIN w a USING (k) JOIN w b USING (k) WHERE a.i < b.i AND abs(abs(a.v - b.v) - abs(goal)) <= tol
  UNION ALL SELECT t.k, t.n, 4, 'percent_change', [a.i, b.i], least(a.i, b.i), greatest(a.i, b.i), CASE WHEN a.i < b.i THEN 1 ELSE 2 END FROM t JOIN w a USING (k) JOIN w b USING (k) WHERE a.i <> b.i AND a.v <> 0 AND abs((b.v - a.v) / a.v * 100 - goal) <= tol),
d AS (SELECT k, n, operation, inputs FROM (SELECT *, row_number() OVER (PARTITION BY k, n ORDER BY step, x, y, z) AS first FROM c) WHERE first = 1)"""


def _orders(spark, sf_dir: str) -> DataFrame:
    """``k, lines``: an order's lines (price ``p``, supplier ``s``) in order."""
    line = F.struct("l_linenumber", F.col("l_extendedprice").alias("p"), F.col("l_suppkey").alias("s"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(line)).alias("lines"))


@query(f"""WITH {_LINES_SQL}, w AS (SELECT * FROM v), t AS (SELECT k, n, goal, tol FROM (SELECT k, unnest([1, 2, 3, 4, 5, 6]) AS n,
  unnest([round(p[1] / 1000, 1) * 1000, p[1] + p[2], p[1] + p[2] + p[3], abs(p[1] - p[2]), (p[2] - p[1]) / p[1] * 100, o_totalprice]) AS goal, unnest([50.0, 0.5, 0.5, 0.5, 0.5, 500.0]) AS tol FROM o JOIN orders ON o_orderkey = k) WHERE goal IS NOT NULL),
{_DERIVED_SQL} SELECT k, n, operation, array_to_string(inputs, ',') AS inputs FROM d""")
def reconciled_orders(spark, sf_dir: str) -> DataFrame:
    """Figures of an order as one line, sums of two or three, a difference or a change in percent, in that order, within the written precision."""
    o = _orders(spark, sf_dir)
    p = [F.get("lines", F.lit(i))["p"] for i in range(3)]
    goals = [(F.round(p[0] / 1000, 1) * 1000, 50.0), (p[0] + p[1], 0.5), (p[0] + p[1] + p[2], 0.5), (F.abs(p[0] - p[1]), 0.5), ((p[1] - p[0]) / p[0] * 100, 0.5), (F.col("o_totalprice"), 500.0)]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), g.alias("goal"), F.lit(t).alias("tolerance")) for n, (g, t) in enumerate(goals, 1)))).alias("_t")
    targets = o.join(dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")), "k").select("k", each).select("k", "_t.*").where("goal IS NOT NULL")
    values = o.select("k", F.posexplode("lines").alias("i", "l")).select("k", (F.col("i") + 1).alias("i"), F.col("l.p").alias("v"))
    return G.reconcile(targets, values, ["k"], ["n"]).select("k", "n", "operation", F.array_join(F.transform("inputs", lambda x: x.cast("string")), ",").alias("inputs"))


_NUMBER = lambda x: f"replace({x}, ',', '')::DOUBLE"


@query(f"""WITH {_LINES_SQL}, a AS (SELECT k, p, format('{{:,.2f}}', p[1]) AS p1, format('{{:,.2f}}', p[2]) AS p2, format('{{:,.2f}}', p[1] + p[2]) AS p3, format('{{:,.2f}}', abs(p[1] - p[2])) AS p4, format('{{:,.2f}}', abs((p[2] - p[1]) / p[1] * 100)) AS p5, (p[2] < p[1]) AS less, format('{{:,.1f}}', o_totalprice / 1000) AS p6
  FROM o JOIN orders ON o_orderkey = k WHERE len(p) > 1),
f AS (SELECT k, 1 AS n, '$' || p1 AS text, {_NUMBER("p1")} AS goal, 0.5::DOUBLE AS half, [1] AS tags FROM a UNION ALL SELECT k, 2, '$' || p2, {_NUMBER("p2")}, 0.5, []::INT[] FROM a
  UNION ALL SELECT k, 3, '$' || p3, {_NUMBER("p3")}, 0.5, [9] FROM a UNION ALL SELECT k, 4, '$' || p4, {_NUMBER("p4")}, 0.5, []::INT[] FROM a
  UNION ALL SELECT k, 5, CASE WHEN less THEN '$(' || p5 || ')' ELSE '$' || p5 END, CASE WHEN less THEN -{_NUMBER("p5")} ELSE {_NUMBER("p5")} END, 0.5, []::INT[] FROM a
  UNION ALL SELECT k, 6, '$' || p6 || 'K', {_NUMBER("p6")} * 1000, 50.0, [1, 2] FROM a),
g AS (SELECT *, length(trim(regexp_replace(text, '[^0-9]', '', 'g'), '0')) AS digits FROM f),
y AS (SELECT v.*, {_NUMBER("format('{:,.2f}', v)")} * b AS held, b AS by, format('{{:,.2f}}', v) AS token FROM v, (VALUES (1), (1000), (1000000), (1000000000)) s(b)),
h AS (SELECT g.k, n, i, doc_id, tags, digits, any_value(token) AS token FROM g JOIN y USING (k) WHERE digits >= 2 AND abs(held - goal) <= greatest(half, 0.5) GROUP BY ALL),
ta AS (SELECT k, n, arg_min(i, (list_position(tags, i), i)) AS i, arg_min(token, (list_position(tags, i), i)) AS token, count(*) AS sources, 'tag' AS basis FROM h WHERE list_contains(tags, i) GROUP BY k, n),
fr AS (SELECT k, n, min(i) AS i, arg_min(token, i) AS token, count(*) AS sources, count(DISTINCT doc_id) AS docs FROM h WHERE digits >= 4 AND NOT EXISTS (SELECT 1 FROM ta WHERE ta.k = h.k AND ta.n = h.n) GROUP BY k, n),
li AS (SELECT * FROM ta UNION ALL SELECT k, n, i, token, sources, 'unambiguous' FROM fr WHERE docs = 1),
w AS (SELECT k, n AS i, goal AS v FROM g JOIN li USING (k, n)), t AS (SELECT k, n, goal, greatest(half, 0.5) AS tol FROM g WHERE NOT EXISTS (SELECT 1 FROM li WHERE li.k = g.k AND li.n = g.n)),
{_DERIVED_SQL},
r AS (SELECT g.*, li.i, li.token, li.sources, li.basis, d.operation, d.inputs, CASE WHEN fr.docs > 1 THEN fr.docs END AS ambiguity, CASE WHEN basis IS NOT NULL THEN 'linked' WHEN operation IS NOT NULL THEN 'derived' ELSE 'unverified' END AS verdict
  FROM g LEFT JOIN li USING (k, n) LEFT JOIN fr ON fr.k = g.k AND fr.n = g.n LEFT JOIN d ON d.k = g.k AND d.n = g.n),
z AS (SELECT *, CASE WHEN verdict <> 'unverified' THEN sum((verdict <> 'unverified')::INT) OVER (PARTITION BY k ORDER BY n) END AS number FROM r),
nm AS (SELECT z.k, z.n, arg_min(held, (abs(held - goal) / goal, y.i, y.by)) AS near_miss FROM z JOIN y ON y.k = z.k JOIN o ON o.k = z.k WHERE verdict = 'unverified' AND ambiguity IS NULL AND goal > 0 AND abs(held - goal) / goal <= 0.05
  AND CASE WHEN len(list_filter(tags, lambda x: x <= len(o.p))) > 0 THEN list_contains(tags, y.i) ELSE true END GROUP BY z.k, z.n)
SELECT z.k, z.n, z.text, z.verdict, z.basis, z.number::INT AS number, z.operation, (SELECT string_agg(q.number::INT::VARCHAR, ',' ORDER BY list_position(z.inputs, q.n)) FROM z q WHERE q.k = z.k AND list_contains(z.inputs, q.n)) AS derived_from,
  z.ambiguity::INT AS ambiguity, z.k || '-' || z.i AS chunk_id, z.token AS source_text, z.sources, round(near_miss, 2) AS near_miss FROM z LEFT JOIN nm ON nm.k = z.k AND nm.n = z.n""")
def annotated_answers(spark, sf_dir: str) -> DataFrame:
    """Every figure of an answer linked to its sources, derived from linked ones, or unverified; citations numbered."""
    o = _orders(spark, sf_dir).join(dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")), "k").where(F.size("lines") > 1)
    p1, p2 = (F.get("lines", F.lit(i))["p"] for i in range(2))
    two, change = lambda c: F.format_number(c, 2), (p2 - p1) / p1 * 100
    signed = F.when(p2 < p1, F.concat(F.lit("$("), two(F.abs(change)), F.lit(")"))).otherwise(F.concat(F.lit("$"), two(F.abs(change))))
    pieces = ["The first line cost $", two(p1), " [[c1]] and the second $", two(p2), ". Together $", two(p1 + p2), " [[c9]], apart $", two(F.abs(p1 - p2)), ", a change of ", signed, " in a hundred, or $", two(change), "%. The order of 1999 came to $", F.format_number(F.col("o_totalprice") / 1000, 1), "K [[c1, c2]]."]
    answers = o.select("k", F.concat(*(F.lit(x) if isinstance(x, str) else x for x in pieces)).alias("answer"))
    lines = o.select("k", F.posexplode("lines").alias("at", "l")).withColumn("place", F.col("at") + 1)
    body = F.format_string("Line %d of supplier %d: %s", "place", "l.s", two(F.col("l.p")))
    chunks = lines.select("k", "place", F.format_string("c%d", "place").alias("alias"), F.format_string("%d-%d", "k", "place").alias("chunk_id"), F.col("l.s").alias("doc_id"), body.alias("text"), F.lit(True).alias("recent"))
    out = G.annotate(answers, chunks, "k", "answer").drop("start", "end")
    return out.withColumn("derived_from", F.array_join(F.transform("derived_from", lambda x: x.cast("string")), ",")).withColumn("near_miss", F.round("near_miss", 2))
