"""Entity and figure queries: nations and part words are the catalogs, the sales tables hold the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import citations as C
from corvane.operators import entities as E
from corvane.operators import figures as G
from corvane.operators.retrieval import verbatim
from corvane.plans.base import CHUNKS_SQL, chunks, query, table


# Catalog of names: first word pairs of the benchmark items.
NAMES_SQL = r"names AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:2], ' ') AS name FROM benchmark WHERE len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 1)"


def _names(spark, sf_dir: str) -> DataFrame:
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return table(spark, sf_dir, "benchmark").where(F.size(w) > 1).select(F.array_join(F.slice(w, 1, 2), " ").alias("name")).distinct()


@query(rf"""WITH {CHUNKS_SQL}, {NAMES_SQL}, w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM chunks),
h AS (SELECT chunk_id, i - 1 AS start, w[i] || ' ' || w[i + 1] AS name FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w)),
m AS (SELECT h.* FROM h JOIN names USING (name)),
r AS (SELECT *, start - row_number() OVER (PARTITION BY chunk_id ORDER BY start) AS run FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, run ORDER BY start) AS n FROM r)
SELECT chunk_id, name, start::INT AS start, (start + 2)::INT AS "end" FROM k WHERE n % 2 = 1""")
def phrase_scan(spark, sf_dir: str) -> DataFrame:
    """Catalog phrases in every chunk, without overlaps."""
    return E.phrase_spans(chunks(spark, sf_dir), "chunk_id", "text", _names(spark, sf_dir), "name")


@query(rf"""WITH {CHUNKS_SQL}, {NAMES_SQL}, w AS (SELECT doc_id, pos, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM chunks),
h AS (SELECT doc_id, pos, i, w[i] || ' ' || w[i + 1] AS name FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w)), m AS (SELECT h.* FROM h JOIN names USING (name))
SELECT doc_id, arg_min(name, (pos, i)) AS "primary", count(DISTINCT name) AS mentions FROM m GROUP BY doc_id""")
def primary_stamp(spark, sf_dir: str) -> DataFrame:
    """A document's first mention is its primary name, the rest are mentions."""
    pairs = chunks(spark, sf_dir).select("doc_id", "pos", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w")).where(F.size("w") > 1)
    pairs = pairs.select("doc_id", "pos", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).alias("i", "name"))
    hits = pairs.join(_names(spark, sf_dir), "name")
    return hits.groupBy("doc_id").agg(F.min_by("name", F.struct("pos", "i")).alias("primary"), F.countDistinct("name").alias("mentions"))


@query(r"""WITH l AS (SELECT s_suppkey AS id, list_sort(list_distinct(regexp_extract_all(lower(s_name || ' ' || (s_suppkey % 7)), '[a-z0-9]+'))) AS w FROM supplier),
r AS (SELECT c_custkey AS id, list_sort(list_distinct(regexp_extract_all(lower('supplier ' || c_mktsegment || ' ' || (c_custkey % 7)), '[a-z0-9]+'))) AS w FROM customer),
lc AS (SELECT w, min(id) AS class_id FROM l GROUP BY w), rc AS (SELECT w, min(id) AS class_id FROM r GROUP BY w),
p AS (SELECT lc.class_id AS a, rc.class_id AS b, round(len(list_intersect(lc.w, rc.w))::DOUBLE / len(list_distinct(lc.w || rc.w)), 6) AS score FROM lc, rc)
SELECT 'pair' AS kind, a, b, score FROM p WHERE score >= 0.4 UNION ALL SELECT 'left', class_id, id, NULL FROM l JOIN lc USING (w) UNION ALL SELECT 'right', class_id, id, NULL FROM r JOIN rc USING (w)""")
def fuzzy_name_join(spark, sf_dir: str) -> DataFrame:
    """Names by overlap of their words: pairs of classes of equal names, and the members of the classes of both sides."""
    left = E.name_classes(table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws(" ", "s_name", (F.col("s_suppkey") % 7).cast("string")).alias("n")), "s_suppkey", "n")
    right = E.name_classes(table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", F.lit("supplier"), "c_mktsegment", (F.col("c_custkey") % 7).cast("string")).alias("n")), "c_custkey", "n")
    pairs = E.fuzzy_classes(left, right, 0.4).select(F.lit("pair").alias("kind"), F.col("left_class").alias("a"), F.col("right_class").alias("b"), "score")
    members = [side.select(F.lit(name).alias("kind"), F.col("class_id").alias("a"), F.col("id").alias("b"), F.lit(None).cast("double").alias("score")) for name, side in (("left", left), ("right", right))]
    return pairs.unionByName(members[0]).unionByName(members[1])


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE a.n_name = b.n_name OR (greatest(length(a.n_name), length(b.n_name)) >= 8 AND levenshtein(a.n_name, b.n_name) <= 2) OR (greatest(length(a.n_name), length(b.n_name)) >= 5 AND levenshtein(a.n_name, b.n_name) <= 1)""")
def typo_tolerant_names(spark, sf_dir: str) -> DataFrame:
    """Catalog names that nearly collide (the nation table is the catalog: a fixed dimension)."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    a, b = (n.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(f"{k}_name")) for k in "ab")
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).where(E.near_word(F.col("a_name"), F.col("b_name"))).select("a", "b")


@query("""WITH t AS (SELECT o_orderkey, round(o_totalprice / 10.0::DOUBLE, 0) AS target, 5.0::DOUBLE AS width FROM orders), s AS (SELECT l_orderkey AS o_orderkey, l_linenumber, round(l_extendedprice / 10.0::DOUBLE, 2) AS v FROM lineitem),
h AS (SELECT t.*, s.l_linenumber, s.v, row_number() OVER (PARTITION BY t.o_orderkey ORDER BY l_linenumber) AS n FROM t JOIN s USING (o_orderkey) WHERE abs(v - target) <= greatest(width, 0.5)) SELECT o_orderkey, target, width, l_linenumber, v FROM h WHERE n = 1""")
def tolerance_join(spark, sf_dir: str) -> DataFrame:
    """Written totals against line amounts within half the last place."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 10, 0).alias("target"), F.lit(5.0).alias("width"))
    cents = F.round(F.col("l_extendedprice") / 10 * 100, 0) / 100  # as the SQL rounds: by the product, not by the written decimals
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", cents.alias("v"))
    return E.tolerance_join(t, s, "o_orderkey", "target", "v", "width", "l_linenumber", each=["o_orderkey"])


@query("""WITH d AS (SELECT o_orderkey, l_linenumber, abs(l_extendedprice - o_totalprice) / o_totalprice AS dist FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 0)
SELECT o_orderkey, arg_min(l_linenumber, (dist, l_linenumber)) AS l_linenumber, round(min(dist), 6) AS dist FROM d GROUP BY o_orderkey HAVING min(dist) <= 0.05""")
def nearest_value(spark, sf_dir: str) -> DataFrame:
    """The nearest amount, if within five percent."""
    o, l = table(spark, sf_dir, "orders").where("o_totalprice > 0"), table(spark, sf_dir, "lineitem")  # noqa: E741
    dist = F.abs(F.col("l_extendedprice") - F.col("o_totalprice")) / F.col("o_totalprice")
    d = o.join(l, o["o_orderkey"] == l["l_orderkey"]).select("o_orderkey", "l_linenumber", dist.alias("d"))
    return d.groupBy("o_orderkey").agg(F.min_by("l_linenumber", F.struct("d", "l_linenumber")).alias("l_linenumber"), F.min("d").alias("d")).where("d <= 0.05").select("o_orderkey", "l_linenumber", F.round("d", 6).alias("dist"))


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity::INT AS q FROM lineitem), t AS (SELECT k, max(q) AS target FROM l GROUP BY k),
c AS (SELECT k, 2 AS op, a.i, b.i AS j, 0 AS m FROM l a JOIN l b USING (k) JOIN t USING (k) WHERE a.i < b.i AND a.q + b.q = target
 UNION ALL SELECT k, 3, a.i, b.i, c.i FROM l a JOIN l b USING (k) JOIN l c USING (k) JOIN t USING (k) WHERE a.i < b.i AND b.i < c.i AND a.q + b.q + c.q = target
 UNION ALL SELECT k, 4, a.i, b.i, 0 FROM l a JOIN l b USING (k) JOIN t USING (k) WHERE a.i < b.i AND abs(a.q - b.q) = target),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY op, i, j, m) AS n FROM c) SELECT k, op, i, j, m FROM r WHERE n = 1""")
def reconcile_sums(spark, sf_dir: str) -> DataFrame:
    """A target as the sum of two or three figures of its order, or their difference; the first in that order.

    Summands are looked up by what is missing to the target (see ``figures``), so no order's lines are joined three times.
    """
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_quantity").cast("double").alias("v"))  # noqa: E741
    t = l.groupBy("k").agg(F.max("v").alias("goal"))
    half = t.withColumn("tolerance", F.lit(0.25))  # quantities are whole numbers
    two = G.pair_sums(half, l, ["k"]).select("k", F.lit(2).alias("op"), "i", "j", F.lit(0).alias("m"))
    three = G.triple_sums(half, l, ["k"]).select("k", F.lit(3).alias("op"), "i", "j", "m")
    apart = G.near_values(half.join(l, "k"), l.withColumnsRenamed({"i": "j", "v": "w"}), ["k"], F.col("v") - F.col("goal"), F.col("tolerance"), "w").where("i <> j")
    differences = apart.select("k", F.lit(4).alias("op"), F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.lit(0).alias("m"))
    best = two.unionByName(three).unionByName(differences).groupBy("k").agg(F.min(F.struct("op", "i", "j", "m")).alias("_b"))
    return best.select("k", "_b.*")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag <> 'N' AS cited FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN cited THEN (sum(cited::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber))::BIGINT END AS number FROM f""")
def citation_numbers(spark, sf_dir: str) -> DataFrame:
    """Cited figures numbered in reading order, the others not."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    cited = F.col("l_returnflag") != "N"
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(cited, F.sum(cited.cast("int")).over(w)).alias("number"))


@query(f"""WITH {CHUNKS_SQL}, q AS (SELECT item_id, text AS quote FROM benchmark), h AS (SELECT item_id, doc_id, min(position(quote IN text)) AS at FROM q, chunks WHERE contains(text, quote) GROUP BY ALL),
n AS (SELECT item_id, count(*) AS n, min(doc_id) AS doc_id FROM h GROUP BY item_id)
SELECT q.item_id, coalesce(n.n, 0) AS found, n.doc_id, CASE WHEN n.n IS NULL THEN 'absent' WHEN n.n = 1 THEN 'verbatim' ELSE 'ambiguous' END AS verdict FROM q LEFT JOIN n USING (item_id)""")
def quote_validation(spark, sf_dir: str) -> DataFrame:
    """Each quote verbatim in one document, in several or in none (the stated quotes against all chunks)."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    hits = verbatim(chunks(spark, sf_dir).select("chunk_id", "doc_id", "text"), q.select(F.col("item_id").alias("query_id"), F.col("quote").alias("item"))).select(F.col("query_id").alias("item_id"), "doc_id").distinct()
    n = hits.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    verdict = F.when(F.col("n").isNull(), "absent").when(F.col("n") == 1, "verbatim").otherwise("ambiguous")
    return q.join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("found"), "doc_id", verdict.alias("verdict"))


@query()
def citation_validation(spark, sf_dir: str) -> DataFrame:
    """A quote of every document, as it stands or with other formatting, too short or altered, found again with its span.

    The quotes are made from each document's middle, so that one in four must be found verbatim, one in four by its folded form.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    half, kind = F.floor(F.length("text") / 2).cast("int"), F.pmod("doc_id", F.lit(4))
    middle = F.substring("text", half, F.lit(60))
    quote = F.when(kind == 0, middle).when(kind == 1, F.concat(F.lit("**"), F.regexp_replace(F.upper(middle), "[ \\n]+", "  "), F.lit("**"))).when(kind == 2, F.substring("text", half, F.lit(1))).otherwise(F.concat(middle, F.lit(" never said")))
    return C.validate_citations(docs.select("doc_id", quote.alias("quote")), docs, "doc_id", "doc_id", "quote", "text")
