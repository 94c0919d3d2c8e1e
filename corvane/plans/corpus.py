"""Corpus queries on documents, chunks, labels and the sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import corpus as C
from corvane.operators.retrieval import filter_predicate
from corvane.plans.base import CHUNKS_SQL, META_SQL, chunks, document_meta, query, table


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', count(*) FROM labels")
def table_counts(spark, sf_dir: str) -> DataFrame:
    """A3: rows of each corpus table."""
    parts = [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("documents", "pages", "labels")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT d.doc_id, d.lang, d.n_chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def point_lookup(spark, sf_dir: str) -> DataFrame:
    """A2: rows by a list of ids, unknown ones absent."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query(f"WITH {META_SQL} SELECT m.doc_id, m.publisher, m.fiscal_year, l.quality, coalesce(l.toxic, 0) AS toxic FROM meta m LEFT JOIN labels l USING (doc_id)")
def hits_with_metadata(spark, sf_dir: str) -> DataFrame:
    """Left join with a side table, missing values defaulted."""
    return document_meta(spark, sf_dir).select("doc_id", "publisher", "fiscal_year").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("toxic", F.coalesce("toxic", F.lit(0)))


@query(f"WITH {META_SQL} SELECT doc_id, publisher FROM meta WHERE doc_id IN (SELECT doc_id FROM labels)")
def listing_semi_join(spark, sf_dir: str) -> DataFrame:
    """Documents that have a row in another table."""
    return document_meta(spark, sf_dir).select("doc_id", "publisher").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query(f"WITH {META_SQL}, known AS (SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE n_chars < 500) SELECT doc_id, n_chars FROM meta WHERE doc_id NOT IN (SELECT doc_id FROM known)")
def fresh_rows(spark, sf_dir: str) -> DataFrame:
    """Rows in neither of two known sets."""
    known = table(spark, sf_dir, "labels").select("doc_id").unionByName(table(spark, sf_dir, "documents").where("n_chars < 500").select("doc_id"))
    return document_meta(spark, sf_dir).select("doc_id", "n_chars").join(known, "doc_id", "left_anti")


@query(f"""WITH {META_SQL}, e AS (SELECT DISTINCT doc_type, publisher, fiscal_year FROM meta), top AS (SELECT max(fiscal_year) AS m FROM meta),
want AS (SELECT DISTINCT doc_type, publisher, y::INT AS fiscal_year FROM e, (SELECT unnest(range(2005, (SELECT m FROM top) + 3)) AS y)) SELECT doc_type, publisher, fiscal_year FROM want EXCEPT SELECT doc_type, publisher, fiscal_year FROM e""")
def missing_editions(spark, sf_dir: str) -> DataFrame:
    """Editions of a document type that a publisher lacks, two years ahead included (anti join with generated years)."""
    meta = document_meta(spark, sf_dir)
    have = meta.select("doc_type", "publisher", "fiscal_year").distinct()
    last = F.broadcast(meta.agg(F.max("fiscal_year").alias("m")))  # one row
    want = have.select("doc_type", "publisher").distinct().crossJoin(last).select("doc_type", "publisher", F.explode(F.sequence(F.lit(2005), F.col("m") + 2)).alias("fiscal_year"))
    return want.join(have, ["doc_type", "publisher", "fiscal_year"], "left_anti")


@query(f"""WITH {CHUNKS_SQL}, per AS (SELECT publisher, doc_id, count(*) AS n FROM chunks GROUP BY ALL) SELECT publisher, sum(n)::BIGINT AS n_chunks, arg_min(doc_id, (-n, doc_id)) AS sample_doc FROM per GROUP BY publisher""")
def values_by_chunk(spark, sf_dir: str) -> DataFrame:
    """Chunks per value and the modal document."""
    return C.values_by_chunk(chunks(spark, sf_dir), "publisher")


@query(f"WITH {META_SQL} SELECT doc_type, count(DISTINCT doc_id) AS n_docs, min(publisher) AS sample FROM meta GROUP BY doc_type")
def values_by_document(spark, sf_dir: str) -> DataFrame:
    """Distinct documents per value."""
    return document_meta(spark, sf_dir).groupBy("doc_type").agg(F.countDistinct("doc_id").alias("n_docs"), F.min("publisher").alias("sample"))


@query(f"""WITH {META_SQL}, g AS (SELECT publisher, doc_type, count(*) AS n, list_sort(list_distinct(list(fiscal_year))) AS y FROM meta GROUP BY ALL)
SELECT publisher, doc_type, n, array_to_string(y, ',') AS years, array_to_string(list_filter(range(list_min(y), list_max(y) + 1), lambda v: NOT list_contains(y, v)), ',') AS gaps FROM g""")
def corpus_inventory(spark, sf_dir: str) -> DataFrame:
    """Documents per label, their years and the gaps between them."""
    g = document_meta(spark, sf_dir).groupBy("publisher", "doc_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("fiscal_year")).alias("y"))
    return g.select("publisher", "doc_type", "n", F.array_join("y", ",").alias("years"), F.array_join(C.year_gaps(F.col("y")), ",").alias("gaps"))


@query(f"""WITH {CHUNKS_SQL}, s AS (SELECT doc_id, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / nullif(length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')), 0) AS share FROM chunks WHERE length(text) >= 50)
SELECT doc_id, count(*) AS judged, round(avg(CASE WHEN share < 0.8 THEN 1.0::DOUBLE ELSE 0 END), 6) AS fraction, CASE WHEN count(*) < 3 THEN 'unjudged' WHEN avg(CASE WHEN share < 0.8 THEN 1.0::DOUBLE ELSE 0 END) > 0.2 THEN 'over' WHEN avg(CASE WHEN share < 0.8 THEN 1.0::DOUBLE ELSE 0 END) >= 0.05 THEN 'near' ELSE 'ok' END AS verdict FROM s GROUP BY doc_id""")
def structural_quality(spark, sf_dir: str) -> DataFrame:
    """Share of a document's passages that hold few letters."""
    judged = chunks(spark, sf_dir).where(F.length("text") >= 50).select("doc_id", (C.letter_share(F.col("text")) < 0.8).cast("double").alias("bad"))
    g = judged.groupBy("doc_id").agg(F.count("*").alias("judged"), F.avg("bad").alias("f"))
    verdict = F.when(F.col("judged") < 3, "unjudged").when(F.col("f") > 0.2, "over").when(F.col("f") >= 0.05, "near").otherwise("ok")
    return g.select("doc_id", "judged", F.round("f", 6).alias("fraction"), verdict.alias("verdict"))


@query(f"""WITH {CHUNKS_SQL}, c AS (SELECT doc_id, sum(length(text)) AS n FROM chunks GROUP BY doc_id) SELECT d.doc_id, round(coalesce(c.n, 0)::DOUBLE / nullif(d.n_chars, 0), 6) AS coverage, coalesce(coalesce(c.n, 0)::DOUBLE / nullif(d.n_chars, 0) < 0.98, true) AS low FROM documents d LEFT JOIN c USING (doc_id)""")
def coverage_ratio(spark, sf_dir: str) -> DataFrame:
    """Characters of the chunks against those of the source."""
    c = chunks(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"))
    ratio = F.coalesce("n", F.lit(0)) / F.nullif(F.col("n_chars"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(c, "doc_id", "left").select("doc_id", F.round(ratio, 6).alias("coverage"), F.coalesce(ratio < 0.98, F.lit(True)).alias("low"))


@query(f"""WITH {CHUNKS_SQL}, t AS (SELECT doc_id, chunk_id, pos, greatest(1, length(text) // 4) AS n FROM chunks), g AS (SELECT doc_id, list_sort(list(n)) AS l, list(chunk_id ORDER BY pos) AS ids, count(*) FILTER (n < 3) AS tiny FROM t GROUP BY doc_id)
SELECT doc_id, len(l) AS n, l[1] AS low, l[len(l)] AS high, l[floor((len(l) - 1) * 0.5)::INT + 1] AS median, CASE WHEN len(l) >= 20 THEN l[floor(len(l) * 0.95)::INT + 1] ELSE l[len(l)] END AS p95, tiny, array_to_string(ids[1:3], ',') AS samples FROM g""")
def chunk_audit(spark, sf_dir: str) -> DataFrame:
    """Token counts of each document's chunks, tiny ones and three samples."""
    t = chunks(spark, sf_dir).select("doc_id", "chunk_id", "pos", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("n"))
    g = t.groupBy("doc_id").agg(F.array_sort(F.collect_list("n")).alias("l"), F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))).alias("ids"), F.count_if(F.col("n") < 3).alias("tiny"))
    size = F.size("l")
    return g.select(
        "doc_id", size.cast("long").alias("n"), F.get("l", F.lit(0)).alias("low"), F.get("l", size - 1).alias("high"), C.ranked_percentile(F.col("l"), 0.5).alias("median"),
        F.when(size >= 20, F.get("l", F.floor(size * 0.95).cast("int"))).otherwise(F.get("l", size - 1)).alias("p95"), "tiny", F.array_join(F.slice("ids.chunk_id", 1, 3), ",").alias("samples"),
    )


@query("""WITH t AS (SELECT source, octet_length(encode(text)) AS b FROM documents) SELECT source, count(*) AS n, round(avg(b), 4) AS mean, max(b) AS high, list_sort(list(b))[floor((count(*) - 1) * 0.5)::INT + 1] AS median, sum(b)::BIGINT AS total FROM t GROUP BY source""")
def payload_sizes(spark, sf_dir: str) -> DataFrame:
    """Bytes of the texts by group; the lower median."""
    b = table(spark, sf_dir, "documents").select("source", F.octet_length("text").cast("long").alias("b"))
    sums = b.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("b"), 4).alias("mean"), F.max("b").alias("high"), F.sum("b").alias("total"))
    return sums.join(C.lower_percentile(b, "source", "b", 0.5, "median"), "source").select("source", "n", "mean", "high", "median", "total")


@query("""WITH l AS (SELECT d.source, l.quality, CASE WHEN d.n_chars < 300 THEN 1 ELSE 0 END AS miss FROM labels l JOIN documents d USING (doc_id)) SELECT coalesce(source, 'all') AS source, count(*) AS labelled, sum(miss)::BIGINT AS missing, round(sum(miss)::DOUBLE / count(*), 6) AS rate FROM l WHERE quality = 1 GROUP BY GROUPING SETS ((source), ())""")
def label_error_rate(spark, sf_dir: str) -> DataFrame:
    """Labelled documents that contradict a check, per group and over all."""
    rows = table(spark, sf_dir, "labels").where("quality = 1").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    g = rows.rollup("source").agg(F.count("*").alias("labelled"), F.sum((F.col("n_chars") < 300).cast("long")).alias("missing"))
    return g.select(F.coalesce("source", F.lit("all")).alias("source"), "labelled", "missing", F.round(F.col("missing") / F.col("labelled"), 6).alias("rate"))


@query("""SELECT count(*) FILTER (text = '') AS empty, count(*) FILTER (lang IS NULL) AS no_lang, count(*) FILTER (n_chars <> length(text)) AS wrong_size, count(*) FILTER (starts_with(text, ' ')) AS padded, count(*) FILTER (contains(text, chr(10))) AS many_lines, count(*) FILTER (copies > 1) AS duplicates FROM (SELECT *, count(*) OVER (PARTITION BY text) AS copies FROM documents)""")
def identity_check(spark, sf_dir: str) -> DataFrame:
    """Findings counted in one pass; duplicates by a hash of the text, so the text isn't shuffled."""
    docs = table(spark, sf_dir, "documents")
    first = docs.agg(F.count_if(F.col("text") == "").alias("empty"), F.count_if(F.col("lang").isNull()).alias("no_lang"), F.count_if(F.col("n_chars") != F.length("text")).alias("wrong_size"), F.count_if(F.startswith("text", F.lit(" "))).alias("padded"), F.count_if(F.contains("text", F.lit("\n"))).alias("many_lines"))
    copies = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))
    return first.crossJoin(copies)  # two single rows


@query("""WITH f AS (SELECT source, upper(trim(lang)) AS slug, lang AS name, doc_id FROM documents), g AS (SELECT slug, arg_min(name, doc_id) AS name, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(*) AS n FROM f GROUP BY slug) SELECT * FROM g""")
def catalog_build(spark, sf_dir: str) -> DataFrame:
    """A catalog by slug: first spelling, distinct sources in order."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.upper(F.trim("lang")).alias("slug")).agg(F.min_by("lang", "doc_id").alias("name"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, extract(year FROM o_orderdate)::INT AS y, (o_totalprice * 100)::BIGINT AS c FROM orders) SELECT a.o_custkey, a.y AS y1, b.y AS y2, a.n AS n1, b.n AS n2 FROM (SELECT o_custkey, y, count(*) AS n FROM o GROUP BY ALL) a JOIN (SELECT o_custkey, y, count(*) AS n FROM o GROUP BY ALL) b ON a.o_custkey = b.o_custkey AND b.y = a.y + 1""")
def year_over_year(spark, sf_dir: str) -> DataFrame:
    """Groups of consecutive years side by side (a self join on the group, already aggregated)."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    a, b = g.select("o_custkey", F.col("y").alias("y1"), F.col("n").alias("n1")), g.select("o_custkey", F.col("y").alias("y2"), F.col("n").alias("n2"))
    return a.withColumn("_next", F.col("y1") + 1).join(b.withColumnRenamed("y2", "_y"), (F.col("_next") == F.col("_y")) & (a["o_custkey"] == b["o_custkey"])).select(a["o_custkey"], "y1", F.col("_y").alias("y2"), "n1", "n2")


@query(f"""WITH {META_SQL}, p AS (SELECT DISTINCT publisher, fiscal_year FROM meta), o AS (SELECT a.publisher AS a, b.publisher AS b, count(*) AS shared FROM p a JOIN p b ON a.fiscal_year = b.fiscal_year AND a.publisher < b.publisher GROUP BY ALL) SELECT * FROM o""")
def co_occurrence(spark, sf_dir: str) -> DataFrame:
    """Years that two ids share; a merge of them is safe where none is shared."""
    p = document_meta(spark, sf_dir).select("publisher", "fiscal_year").distinct()
    a, b = p.withColumnRenamed("publisher", "a"), p.withColumnRenamed("publisher", "b")
    return a.join(b, "fiscal_year").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


@query("""WITH old AS (SELECT doc_id, quality AS v FROM labels), new AS (SELECT doc_id, toxic AS v FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 1000000, quality FROM labels WHERE doc_id % 50 = 0)
SELECT doc_id, v FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT doc_id, v FROM new""")
def upserted_table(spark, sf_dir: str) -> DataFrame:
    """B1, S3: new rows over old ones by key."""
    labels = table(spark, sf_dir, "labels")
    new = labels.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("v")).unionByName(labels.where("doc_id % 50 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.col("quality").alias("v")))
    return C.upsert(labels.select("doc_id", F.col("quality").alias("v")), new, "doc_id", "v")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def deleted_documents(spark, sf_dir: str) -> DataFrame:
    """B2: all rows of the given documents removed."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, quality AS before, toxic AS after FROM labels WHERE quality IS DISTINCT FROM toxic")
def change_set(spark, sf_dir: str) -> DataFrame:
    """H3, L4: rows whose recomputed value differs, with both values for the reversal."""
    labels = table(spark, sf_dir, "labels")
    return C.change_set(labels.select("doc_id", F.col("quality").alias("v")), labels.select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


@query("(SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)")
def integrity_difference(spark, sf_dir: str) -> DataFrame:
    """H4: what either side has more (multiset difference both ways)."""
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return a.exceptAll(b).unionByName(b.exceptAll(a))


@query("SELECT doc_id FROM labels WHERE toxic = 0 INTERSECT SELECT doc_id + 1 FROM labels WHERE toxic = 1")
def id_collisions(spark, sf_dir: str) -> DataFrame:
    """H6: new ids that exist already."""
    labels = table(spark, sf_dir, "labels")
    return labels.where("toxic = 0").select("doc_id").intersect(labels.where("toxic = 1").select((F.col("doc_id") + 1).alias("doc_id")))


@query("SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(url, '^https?://', '')) ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def url_dedupe(spark, sf_dir: str) -> DataFrame:
    """One page per address, whatever its case and scheme, the first wins."""
    w = Window.partitionBy(F.lower(F.regexp_replace("url", "^https?://", ""))).orderBy("page_id")
    return table(spark, sf_dir, "pages").select("page_id", "url").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


@query("""WITH a AS (SELECT doc_id, md5(lang) AS v FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN source ELSE lang END) AS v FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.v IS NULL THEN 'orphan' WHEN b.v IS NULL THEN 'missing' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def manifest_check(spark, sf_dir: str) -> DataFrame:
    """Declared hashes against found ones (full outer join)."""
    docs = table(spark, sf_dir, "documents")
    a = docs.where("doc_id % 7 <> 0").select("doc_id", F.md5("lang").alias("v"))
    b = docs.where("doc_id % 11 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(F.col("lang"))).alias("v"))
    return C.full_comparison(a, b, "doc_id", "v")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS cov, l_discount AS un, 0.75::DOUBLE * max(l_quantity) OVER (PARTITION BY l_orderkey) AS lim FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (cov >= lim) DESC, CASE WHEN cov >= lim THEN un END ASC NULLS LAST, cov DESC, l_linenumber) AS n FROM a) SELECT l_orderkey, l_linenumber FROM r WHERE n = 1""")
def best_attempt(spark, sf_dir: str) -> DataFrame:
    """The best of several attempts."""
    return C.best_attempt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), "l_orderkey", "l_quantity", "l_discount", "l_linenumber").select("l_orderkey", "l_linenumber")


@query(f"WITH {META_SQL} SELECT doc_id, publisher FROM (SELECT doc_id, publisher, row_number() OVER (PARTITION BY publisher ORDER BY md5(doc_id::VARCHAR)) AS turn FROM meta) ORDER BY turn, publisher LIMIT 50")
def stratified_sample(spark, sf_dir: str) -> DataFrame:
    """A sample that takes from each publisher in turn (a sampling operator: the limit is its feature)."""
    return C.stratified_sample(document_meta(spark, sf_dir).select("doc_id", "publisher"), "publisher", "doc_id", 50)


@query("""SELECT metric, max(v) FILTER (lang = 'de') AS de, max(v) FILTER (lang = 'en') AS en, max(v) FILTER (lang = 'es') AS es, max(v) FILTER (lang = 'fr') AS fr FROM (
SELECT lang, 'docs' AS metric, count(*) AS v FROM documents GROUP BY lang UNION ALL SELECT lang, 'chars', sum(n_chars)::BIGINT FROM documents GROUP BY lang) GROUP BY metric""")
def metric_pivot(spark, sf_dir: str) -> DataFrame:
    """Metrics in rows, groups in columns."""
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return g.unpivot("lang", ["docs", "chars"], "metric", "v").groupBy("metric").pivot("lang", ["de", "en", "es", "fr"]).agg(F.max("v"))


@query("SELECT p_partkey, attribute, amount FROM (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) UNPIVOT (amount FOR attribute IN (size, price))")
def amounts_unpivot(spark, sf_dir: str) -> DataFrame:
    """columns to rows."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return part.unpivot("p_partkey", ["size", "price"], "attribute", "amount")


@query("SELECT doc_id, publisher, doc_type, fiscal_year, row_number() OVER (ORDER BY fiscal_year DESC, publisher, doc_type, doc_id) AS place FROM (SELECT doc_id, source AS publisher, lang AS doc_type, (2005 + doc_id % 23)::INT AS fiscal_year FROM documents) ORDER BY place LIMIT 100")
def browse_order(spark, sf_dir: str) -> DataFrame:
    """The first hundred of the listing (a top-k report)."""
    order = [F.desc("fiscal_year"), "publisher", "doc_type", "doc_id"]
    top = document_meta(spark, sf_dir).drop("n_chars").orderBy(*order).limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("doc_id", "publisher", "doc_type", "fiscal_year", F.col("place").cast("long").alias("place"))


@query("WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n) AS m FROM n WHERE n <= 50 AND event_type = 'purchase') WHERE m = 1")
def newest_live(spark, sf_dir: str) -> DataFrame:
    """The newest row of a state among the newest fifty (the limit comes before the filter)."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    recent = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n <= 50 AND event_type = 'purchase'")
    return recent.groupBy("user_id").agg(F.min_by("event_id", "n").alias("event_id"))


@query("SELECT doc_id FROM documents WHERE (lang = 'fr' OR lang IS NULL) AND source IN ('src1', 'src2') AND (n_chars > 1000) IS TRUE")
def facet_filter(spark, sf_dir: str) -> DataFrame:
    """Null passes one dimension, membership another."""
    rows = filter_predicate(table(spark, sf_dir, "documents"), source=["src1", "src2"])
    return rows.where((F.col("lang").isNull() | (F.col("lang") == "fr")) & (F.col("n_chars") > 1000)).select("doc_id")


@query("WITH t AS (SELECT 'the' AS w UNION ALL SELECT 'and') SELECT d.doc_id FROM documents d WHERE (SELECT bool_and(contains(lower(d.text), t.w) OR d.source = t.w OR d.lang = t.w) FROM t)")
def every_token_filter(spark, sf_dir: str) -> DataFrame:
    """Every word of the query must match text, source or language."""
    words = F.split(F.lit("the and"), r"\s+")
    hit = lambda w: F.contains(F.lower("text"), w) | (F.col("source") == w) | (F.col("lang") == w)
    return table(spark, sf_dir, "documents").where(F.forall(words, hit)).select("doc_id")


@query("""SELECT c_custkey, CASE WHEN c_name ~ '^Customer#0+1' THEN 'prefix' WHEN contains(lower(c_mktsegment), 'build') THEN 'title' ELSE 'other' END AS how FROM customer""")
def id_or_title_match(spark, sf_dir: str) -> DataFrame:
    """C11: an id prefix, else a substring of the title."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_name").rlike("^Customer#0+1"), "prefix").when(F.contains(F.lower("c_mktsegment"), F.lit("build")), "title").otherwise("other").alias("how"))


@query("""SELECT s.s_suppkey, n.n_name AS agency, r.r_name AS family, count(*) OVER (PARTITION BY r.r_name) AS in_family FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def group_expansion(spark, sf_dir: str) -> DataFrame:
    """Id to name to logical group, and the group's size (dimension tables are broadcast by size)."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("s_suppkey", F.col("n_name").alias("agency"), F.col("r_name").alias("family"))
    return rows.withColumn("in_family", F.count("*").over(Window.partitionBy("family")))
