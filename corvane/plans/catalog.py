"""Catalogs, job records, filters and orderings: the sales tables play jobs and attempts, pages and documents the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import catalog as C
from corvane.operators.retrieval import vector_search
from corvane.plans.base import document_meta, query, table
from corvane.sources.shared import saved, small


@query("""WITH families AS (SELECT r_regionkey AS request, n_nationkey AS slug FROM region JOIN nation ON n_regionkey = r_regionkey OR n_regionkey = (r_regionkey + 1) % 5),
years AS (SELECT r_regionkey AS request, y FROM region, (SELECT unnest([0, 1]) AS k), LATERAL (SELECT CASE WHEN k = 0 THEN CASE WHEN r_regionkey = 4 THEN 0 ELSE 1994 + r_regionkey END ELSE 0 END AS y) WHERE y <> 0)
SELECT f.request, count(*) AS orders FROM (SELECT DISTINCT request, slug FROM families) f JOIN customer ON c_nationkey = slug JOIN orders ON o_custkey = c_custkey
WHERE f.request NOT IN (SELECT request FROM years) OR EXISTS (SELECT 1 FROM years y WHERE y.request = f.request AND y.y = year(o_orderdate)) GROUP BY f.request""")
def filter_translation(spark, sf_dir: str) -> DataFrame:
    """Families of types expand to distinct slugs, year 0 is dropped, and no year left is no filter."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    key = F.col("r_regionkey").cast("int")
    asked = region.select(F.col("r_regionkey").alias("request"), F.array(key, (key + 1) % 5).alias("families"), F.array(F.when(key == 4, 0).otherwise(1994 + key), F.lit(0)).alias("years"))
    members = nation.select(F.col("n_regionkey").cast("int").alias("family"), F.col("n_nationkey").alias("slug"))
    translated = C.translated_filters(asked, members)
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("slug")), "o_custkey").select("slug", F.year("o_orderdate").alias("year"))
    counts = orders.groupBy("slug", "year").agg(F.count("*").alias("n"))
    wanted = translated.withColumn("slug", F.explode("slugs")).join(counts, "slug").where((F.size("years") == 0) | F.array_contains("years", F.col("year")))
    return wanted.groupBy("request").agg(F.sum("n").alias("orders"))


ATTEMPTS_SQL = """a AS (SELECT l_orderkey AS job, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity, l_extendedprice) AS i, l_returnflag AS extractor, l_discount * 3 AS unlabelled, l_quantity AS coverage FROM lineitem),
k AS (SELECT job, count(*) AS n, arg_min(extractor, i) AS first, arg_max(extractor, (coverage, -i)) AS kept FROM a GROUP BY job),
j AS (SELECT o_orderkey AS job, o_orderstatus AS state, o_custkey % 5 = 0 AS held FROM orders)"""


@query(f"""WITH {ATTEMPTS_SQL}, l AS (SELECT a.job, arg_max(unlabelled, i) AS share FROM a JOIN k ON a.job = k.job AND a.extractor = k.kept GROUP BY a.job)
SELECT job, 'held_out' AS reason FROM j WHERE state = 'F' AND held UNION ALL SELECT job, 'swapped' FROM j JOIN k USING (job) WHERE state = 'O' AND n >= 2 AND first <> kept
UNION ALL SELECT job, 'degraded' FROM j JOIN l USING (job) WHERE state = 'O' AND share > 0.2""")
def needs_attention(spark, sf_dir: str) -> DataFrame:
    """Jobs held out, with a swapped extractor, or whose kept attempt left too much unlabelled."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("state"), (F.col("o_custkey") % 5 == 0).alias("held_out"))
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice"))
    attempts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), number.alias("i"), F.col("l_returnflag").alias("extractor"), (F.col("l_discount") * 3).alias("unlabelled"), F.col("l_quantity").alias("coverage"))
    return C.attention_reasons(jobs, attempts, failed="F", live="O", limit=0.2)


@query("""WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS h, lang = 'en' AS live FROM documents), p AS (SELECT a.doc_id, b.doc_id AS other, b.live, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.live DESC, b.doc_id) AS n FROM d a JOIN d b ON a.h = b.h AND a.doc_id <> b.doc_id)
SELECT doc_id, other AS duplicate_of, CASE WHEN live THEN 'live' ELSE 'pending' END AS kind FROM p WHERE n = 1""")
def duplicate_probe(spark, sf_dir: str) -> DataFrame:
    """C14: another document of the same content hash, a live one before a pending one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("hash"), (F.col("lang") == "en").alias("live"))
    return C.duplicate_probe(docs, "doc_id", "hash", "live").select("doc_id", "duplicate_of", F.when(F.col("live"), "live").otherwise("pending").alias("kind"))


@query(r"""WITH p AS (SELECT page_id, lower(regexp_replace(url, '[?#].*$', '')) AS u, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, regexp_extract(html, '<title>([^<]*)</title>', 1) AS better FROM pages),
t AS (SELECT u, arg_min(better, page_id) AS better FROM p WHERE better <> '' GROUP BY u)
SELECT page_id, coalesce(t.better, p.title) AS title, (t.better IS NOT NULL AND t.better <> p.title) AS changed, t.u IS NOT NULL AS matched FROM p LEFT JOIN t USING (u)""")
def title_repair(spark, sf_dir: str) -> DataFrame:
    """Titles mended by lower-case address; what has no better title stays."""
    p = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_replace("url", "[?#].*$", "")).alias("u"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("better"))
    better = p.where("better <> ''").groupBy("u").agg(F.min_by("better", "page_id").alias("new"))
    fixed = p.join(better, "u", "left")
    return fixed.select("page_id", F.coalesce("new", "title").alias("title"), F.coalesce(F.col("new") != F.col("title"), F.lit(False)).alias("changed"), F.col("new").isNotNull().alias("matched"))


@query(r"""WITH u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS call, length(text) AS n FROM conversations WHERE role = 'user'),
k AS (SELECT *, CASE WHEN n < 150 THEN 5 WHEN n < 400 THEN 12 WHEN n < 800 THEN 18 ELSE 15 END AS k FROM u)
SELECT conv_id, turn, (CASE WHEN call = 1 AND NOT contains(lower(text), 'deep') THEN least(k, 5) ELSE k END)::INT AS top_k FROM k""")
def adaptive_top_k(spark, sf_dir: str) -> DataFrame:
    """Results by intent (told by the question's length here); the first call of a conversation is capped unless it asks for depth."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    n = F.length("text")
    by_intent = F.when(n < 150, 5).when(n < 400, 12).when(n < 800, 18).otherwise(15)
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    capped = first & ~F.contains(F.lower("text"), F.lit("deep"))
    return asked.select("conv_id", "turn", F.when(capped, F.least(by_intent, F.lit(5))).otherwise(by_intent).cast("int").alias("top_k"))


@query(r"""WITH b AS (SELECT p_partkey, p_type, regexp_extract(p_brand, '\d+', 0)::INT AS no, p_name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY no, p_partkey) AS a, row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) AS t, count(*) OVER (PARTITION BY p_type) AS n FROM b)
SELECT p_partkey, a::INT AS by_number, (n + 1 - a)::INT AS by_number_desc, t::INT AS by_title, (n + 1 - t)::INT AS by_title_desc FROM r""")
def bill_sorts(spark, sf_dir: str) -> DataFrame:
    """Places by number and by title within a type; descending is the exact reverse."""
    b = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.regexp_extract("p_brand", r"\d+", 0).cast("int").alias("no"), "p_name")
    w = Window.partitionBy("p_type")
    number, title = (F.row_number().over(w.orderBy(c, "p_partkey")) for c in ("no", "p_name"))
    placed = b.select("p_partkey", number.alias("by_number"), title.alias("by_title"), F.count("*").over(w).alias("n"))
    return placed.select("p_partkey", "by_number", (F.col("n") + 1 - F.col("by_number")).cast("int").alias("by_number_desc"), "by_title", (F.col("n") + 1 - F.col("by_title")).cast("int").alias("by_title_desc"))


@query("""SELECT user_id, event_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error') DESC, ts DESC, event_id DESC) AS place FROM events) WHERE place <= 50""")
def reading_order(spark, sf_dir: str) -> DataFrame:
    """Open issues first, then the newest; fifty a reader (the feature's own limit)."""
    w = Window.partitionBy("user_id").orderBy(F.desc(F.col("event_type") == "error"), F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("place", F.row_number().over(w)).where("place <= 50").select("user_id", "event_id", "place")


@query("""SELECT event_id, k, n_name AS recommended FROM (SELECT event_id, (props->>'k')::INT AS k FROM events) LEFT JOIN nation ON n_nationkey = k WHERE k % 4 <> 0""")
def catalog_overlay(spark, sf_dir: str) -> DataFrame:
    """Entries of a JSON catalog that support what is asked for, with what a curated list says of them."""
    entries = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).where("k % 4 <> 0")
    curated = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_name").alias("recommended"))
    return entries.join(curated, "k", "left").select("event_id", "k", "recommended")


@query("""SELECT event_id, key AS doc_id, (j->key->>'k')::INT AS k FROM (SELECT event_id, json('{"' || user_id || '": ' || props || ', "extra": {"k": ' || event_id % 5 || '}}') AS j FROM events), LATERAL (SELECT unnest(json_keys(j)) AS key)""")
def document_sidecar(spark, sf_dir: str) -> DataFrame:
    """A4: a JSON object by document id, opened to one row a document."""
    text = F.concat(F.lit('{"'), "user_id", F.lit('": '), "props", F.lit(', "extra": {"k": '), F.col("event_id") % 5, F.lit("}}"))
    opened = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json(text, "map<string, struct<k: int>>")).alias("doc_id", "meta"))
    return opened.select("event_id", "doc_id", "meta.k")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, q.label = v.label AS same, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6) AS cosine, q.e AS qe, v.e AS ve FROM e q, e v WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS r FROM p)
SELECT query_id, chunk_id, round(0.8::DOUBLE * list_dot_product(list_transform(qe, lambda x: round(x * 127)), list_transform(ve, lambda x: round(x * 127))) / 16129.0::DOUBLE + CASE WHEN same THEN 0.15::DOUBLE ELSE 0 END + greatest(-0.45::DOUBLE, 0.003::DOUBLE * least(chunk_id - query_id, 0)), 6) AS score FROM t WHERE r <= 10""")
def score_blend(spark, sf_dir: str) -> DataFrame:
    """R2: a pool's vectors compared as small integers, with a bonus for the label and a bounded penalty for age."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"), F.col("label").alias("ql"))
    pool = vector_search(v.select(F.col("vec_id").alias("chunk_id"), "embedding"), q.select("query_id", F.col("qe").alias("embedding")), 10).select("query_id", "chunk_id")
    both = v.withColumnRenamed("vec_id", "chunk_id").join(small(saved(pool)), "chunk_id").join(q, "query_id")
    score = 0.8 * C.quantised_dot(F.col("qe"), F.col("embedding")) + F.when(F.col("ql") == F.col("label"), 0.15).otherwise(0.0) + F.greatest(F.lit(-0.45), 0.003 * F.least(F.col("chunk_id") - F.col("query_id"), F.lit(0)))
    return both.select("query_id", "chunk_id", F.round(score, 6).alias("score"))


@query("""WITH c AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN lower(text) ELSE text END) AS stored FROM documents WHERE doc_id % 5 <> 0) SELECT d.doc_id, CASE WHEN c.doc_id IS NULL THEN 'missing' WHEN c.stored IS DISTINCT FROM md5(d.text) THEN 'stale' ELSE 'hit' END AS state, md5(d.text) AS current FROM documents d LEFT JOIN c USING (doc_id)""")
def discovery_cache(spark, sf_dir: str) -> DataFrame:
    """Cached results are valid only while the source has the stored hash; the rest is derived again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 5 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.lower("text")).otherwise(F.col("text"))).alias("stored"))
    return C.cache_states(docs.select("doc_id", F.md5("text").alias("current")), cache, "doc_id")


@query("""WITH i AS (SELECT p_brand, p_partkey, unnest([{'kind': 'index', 'name': p_brand}, {'kind': 'toc', 'name': p_type}] || list_transform(string_split(p_name, ' '), lambda w: {'kind': 'section', 'name': w})) AS item FROM part) SELECT p_partkey, item.kind AS kind, item.name AS name, count(*) AS n FROM i GROUP BY ALL""")
def work_items(spark, sf_dir: str) -> DataFrame:
    """An edition's index, contents and sections as one list of work items."""
    item = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    listed = F.concat(F.array(item("index", F.col("p_brand")), item("toc", F.col("p_type"))), F.transform(F.split("p_name", " "), lambda w: item("section", w)))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(listed).alias("i")).groupBy("p_partkey", "i.kind", "i.name").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT l_orderkey AS job, count(*) AS pages FROM lineitem WHERE l_quantity > 10 GROUP BY 1)
SELECT o_orderkey AS job, CASE WHEN o_totalprice < 20000 THEN 'preflight' WHEN o_orderstatus = 'P' THEN 'staged' WHEN pages > 0 THEN 'pages' ELSE 'error' END AS outcome, coalesce(pages, 0) AS pages FROM orders LEFT JOIN o ON job = o_orderkey""")
def batch_outcomes(spark, sf_dir: str) -> DataFrame:
    """Every input has exactly one outcome: failed before, staged, pages, or the error."""
    inputs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.when(F.col("o_totalprice") < 20000, "preflight").when(F.col("o_orderstatus") == "P", "staged").alias("known"))
    outputs = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("job"))
    return C.batch_outcomes(inputs, outputs, "job", "known")


@query("""SELECT o_orderstatus <> 'O' AS archived, o_orderstatus AS state, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) FILTER (o_orderdate < DATE '1996-01-01') AS old FROM orders GROUP BY ALL""")
def job_archive(spark, sf_dir: str) -> DataFrame:
    """Job records kept by state, terminal ones swept into the archive; a queue view with counts from both."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("state"), "o_orderdate")
    kept = C.swept(jobs, F.col("state") != "O")
    return kept.groupBy("archived", "state").agg(F.count("*").alias("n"), F.min("job").alias("first"), F.max("job").alias("last"), F.count_if(F.col("o_orderdate") < F.to_date(F.lit("1996-01-01"))).alias("old"))


@query(r"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR || '-fy' || (2005 + doc_id % 23) || '-report' ELSE doc_id::VARCHAR END AS chunk_id, CASE WHEN doc_id % 3 = 1 THEN 2005 + doc_id % 23 END AS fy FROM documents)
SELECT doc_id, coalesce(fy, nullif(regexp_extract(chunk_id, '-fy(\d{4})', 1), '')::INT)::INT AS fiscal_year FROM c""")
def year_fallback(spark, sf_dir: str) -> DataFrame:
    """The fiscal year, or else the one in the id."""
    meta = document_meta(spark, sf_dir)
    tagged = F.concat(F.col("doc_id").cast("string"), F.lit("-fy"), F.col("fiscal_year").cast("string"), F.lit("-report"))
    c = meta.select("doc_id", F.when(F.col("doc_id") % 3 == 0, tagged).otherwise(F.col("doc_id").cast("string")).alias("chunk_id"), F.when(F.col("doc_id") % 3 == 1, F.col("fiscal_year")).alias("fy"))
    return c.select("doc_id", C.year_of(F.col("fy"), F.col("chunk_id")).alias("fiscal_year"))
