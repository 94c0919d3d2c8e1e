"""Structuring queries on documents' lines, pages and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import structure as S
from corvane.operators.retrieval import verbatim
from corvane.plans.base import CHUNKS_SQL, chunks, query, table

# Order keys and line numbers repeat: the order of an order's lines.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, doc_id, pos, length(text) AS n, greatest(1, length(text) // 4) AS tokens FROM chunks")
def chunk_builder(spark, sf_dir: str) -> DataFrame:
    """Documents to numbered chunks."""
    return chunks(spark, sf_dir).select("chunk_id", "doc_id", "pos", F.length("text").cast("long").alias("n"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("tokens"))


@query(f"""WITH {CHUNKS_SQL}, h AS (SELECT doc_id, pos, length(text) < 120 AS heading FROM chunks) SELECT doc_id, section::BIGINT AS section, count(*) AS n, min(pos) AS first FROM (
SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h) GROUP BY ALL""")
def sections(spark, sf_dir: str) -> DataFrame:
    """Short lines begin sections."""
    s = S.sections(chunks(spark, sf_dir).select("doc_id", "pos", "text"), "doc_id", "pos", F.length("text") < 120)
    return s.groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query(f"""WITH {CHUNKS_SQL}, l AS (SELECT doc_id, pos, CASE WHEN length(text) < 100 THEN 1 WHEN length(text) < 400 THEN 2 WHEN length(text) < 800 THEN 3 ELSE 4 END AS level FROM chunks)
SELECT a.doc_id, a.pos, a.level, (SELECT max(b.pos) FROM l b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND b.level < a.level) AS parent FROM l a""")
def outline_parents(spark, sf_dir: str) -> DataFrame:
    """Each line's nearest ancestor by level."""
    n = F.length("text")
    level = F.when(n < 100, 1).when(n < 400, 2).when(n < 800, 3).otherwise(4)
    rows = chunks(spark, sf_dir).select("doc_id", "pos", level.alias("level"))
    return S.nearest_ancestors(rows, "doc_id", "pos", F.col("level"), 4)


_TERM_SQL = "array_to_string(string_split(lower(text), ' ')[1:4], ' ')"


@query(f"""WITH RECURSIVE {CHUNKS_SQL}, l AS (SELECT doc_id, pos, text, CASE WHEN length(text) < 100 THEN 1 WHEN length(text) < 400 THEN 2 WHEN length(text) < 800 THEN 3 ELSE 4 END AS level FROM chunks),
o AS (SELECT *, (SELECT max(b.pos) FROM l b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND b.level < a.level) AS parent FROM l a),
p AS (SELECT doc_id, pos, text, [pos] AS path FROM o WHERE parent IS NULL UNION ALL SELECT o.doc_id, o.pos, o.text, list_append(p.path, o.pos) FROM p JOIN o ON o.doc_id = p.doc_id AND o.parent = p.pos),
q AS (SELECT item_id, {_TERM_SQL} AS term FROM benchmark), h AS (SELECT item_id, doc_id, path, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY len(path) DESC, pos) AS n FROM p JOIN q ON contains(lower(text), term))
SELECT item_id, doc_id, array_to_string(path, '-') AS path FROM h WHERE n = 1""")
def outline_search(spark, sf_dir: str) -> DataFrame:
    """M2: for each item's first four words and each document, the path to the deepest line of its outline that holds them."""
    n = F.length("text")
    level = F.when(n < 100, 1).when(n < 400, 2).when(n < 800, 3).otherwise(4)
    lines = chunks(spark, sf_dir).select("chunk_id", "doc_id", "pos", F.lower("text").alias("text"), level.alias("level"))
    parents = S.nearest_ancestors(lines.select("doc_id", "pos", "level"), "doc_id", "pos", F.col("level"), 4)
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split(F.lower("text"), " "), 1, 4), " ").alias("item"))
    hits = verbatim(lines.select("chunk_id", "doc_id", "pos", "text"), terms).select(F.col("query_id").alias("item_id"), "doc_id", "pos")
    found = S.deepest_matches(S.outline_paths(parents, "doc_id", "pos", "parent"), hits, "doc_id", "pos", "item_id")
    return found.select("item_id", "doc_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


@query(f"""WITH RECURSIVE {CHUNKS_SQL}, t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, pos, greatest(1, length(text) // 4) AS n FROM chunks),
p AS (SELECT doc_id, i, pos, n, 0::BIGINT AS bin, n AS used FROM t WHERE i = 1 UNION ALL SELECT t.doc_id, t.i, t.pos, t.n, CASE WHEN p.used + t.n > 512 THEN p.bin + 1 ELSE p.bin END, CASE WHEN p.used + t.n > 512 THEN t.n ELSE p.used + t.n END FROM p JOIN t ON t.doc_id = p.doc_id AND t.i = p.i + 1)
SELECT doc_id, pos, n AS tokens, bin FROM p""")
def narrative_packing(spark, sf_dir: str) -> DataFrame:
    """paragraphs packed in order up to 512 tokens."""
    rows = chunks(spark, sf_dir).select("doc_id", "pos", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("tokens"))
    return S.greedy_pack(rows, "doc_id", "pos", "tokens", 512)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS agency, l_partkey, l_suppkey, l_extendedprice FROM lineitem), f AS (SELECT *, last_value(agency IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS owner FROM l)
SELECT l_orderkey, l_linenumber, owner FROM f WHERE owner IS NOT NULL""")
def forward_filled(spark, sf_dir: str) -> DataFrame:
    """F8: rows inherit the last heading's owner; those before the first are dropped."""
    rows = table(spark, sf_dir, "lineitem").withColumn("agency", F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")))
    return S.forward_fill(rows, "l_orderkey", LINE_ORDER, F.col("agency"), "owner").where("owner IS NOT NULL").select("l_orderkey", "l_linenumber", "owner")


@query("""WITH s AS (SELECT *, CASE WHEN l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER w THEN 1 ELSE 0 END AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)), n AS (SELECT *, sum(b) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS t FROM s)
SELECT l_orderkey, t::BIGINT AS merged, any_value(l_returnflag) AS header, count(*) AS rows, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines FROM n GROUP BY l_orderkey, t""")
def merged_tables(spark, sf_dir: str) -> DataFrame:
    """Neighbours of equal header become one table."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", *LINE_ORDER)
    rows = rows.withColumn("b", (~F.col("l_returnflag").eqNullSafe(F.lag("l_returnflag").over(w)) | (F.row_number().over(w) == 1)).cast("int")).withColumn("merged", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = rows.groupBy("l_orderkey", "merged").agg(F.any_value("l_returnflag").alias("header"), F.count("*").alias("rows"), F.array_sort(F.collect_list("l_linenumber")).alias("l"))
    return g.select("l_orderkey", "merged", "header", "rows", F.array_join("l", ",").alias("lines"))


@query(f"""WITH {CHUNKS_SQL}, b AS (SELECT doc_id, pos, pos * 10 AS y0, pos * 10 + 8 AS y1, length(text) AS x1 FROM chunks) SELECT doc_id, min(y0) AS top, max(y1) AS bottom, max(x1) AS "right" FROM b GROUP BY doc_id""")
def box_union(spark, sf_dir: str) -> DataFrame:
    """Union of the members' boxes."""
    return chunks(spark, sf_dir).groupBy("doc_id").agg((F.min("pos") * 10).alias("top"), (F.max("pos") * 10 + 8).alias("bottom"), F.max(F.length("text")).cast("long").alias("right"))
