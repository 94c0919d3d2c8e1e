"""Overlays, selections, retries and derived sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.entities import containment_groups
from corvane.plans.base import CHUNKS_SQL, chunks, query, table
from corvane.sources.sinks import staged_name


@query(r"""WITH RECURSIVE t AS (SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), ' ') AS x FROM conversations),
e AS (SELECT a.conv_id, a.turn AS a, b.turn AS b FROM t a JOIN t b ON a.conv_id = b.conv_id WHERE a.turn = b.turn OR (a.x <> '' AND b.x <> '' AND (contains(' ' || a.x || ' ', ' ' || b.x || ' ') OR contains(' ' || b.x || ' ', ' ' || a.x || ' ')))),
r(conv_id, a, b) AS (SELECT conv_id, a, b FROM e UNION SELECT r.conv_id, r.a, e.b FROM r JOIN e ON e.conv_id = r.conv_id AND e.a = r.b) SELECT conv_id, a AS turn, min(b) AS "group" FROM r GROUP BY conv_id, a""")
def retry_groups(spark, sf_dir: str) -> DataFrame:
    """Messages that equal or hold each other, whole and word by word, closed transitively within a conversation."""
    return containment_groups(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""WITH a AS (SELECT DISTINCT p_brand || ' ' || p_name AS alias FROM part WHERE p_size <= 25), b AS (SELECT DISTINCT p_brand || ' ' || p_name AS alias FROM part WHERE p_size > 20) SELECT alias, 'added' AS change FROM b WHERE alias NOT IN (SELECT alias FROM a) UNION ALL SELECT alias, 'disabled' FROM a WHERE alias NOT IN (SELECT alias FROM b)""")
def alias_differences(spark, sf_dir: str) -> DataFrame:
    """H5: what an overlay adds and disables (names of a brand's large parts over those of its small ones)."""
    part = table(spark, sf_dir, "part")
    a, b = (part.where(c).select(F.concat_ws(" ", "p_brand", "p_name").alias("alias")).distinct() for c in ("p_size <= 25", "p_size > 20"))
    return b.join(a, "alias", "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, "alias", "left_anti").withColumn("change", F.lit("disabled")))


@query(r"""WITH p AS (SELECT p_brand, p_partkey, list_aggregate(list_transform(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+'), lambda w: w[1]), 'string_agg', '') AS acronym FROM part),
o AS (SELECT acronym, count(DISTINCT p_brand) AS owners FROM p GROUP BY acronym), f AS (SELECT p_brand, acronym, min(p_partkey) AS first FROM p JOIN o USING (acronym) WHERE owners = 1 AND length(acronym) >= 3 GROUP BY ALL)
SELECT p_brand, acronym, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY first) AS place FROM f) WHERE place <= 3""")
def acronym_candidates(spark, sf_dir: str) -> DataFrame:
    """Initials owned by one group only, three a group (the feature's own limit)."""
    letters = F.transform(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z]+"), F.lit(0)), lambda w: F.substring(w, 1, 1))
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.array_join(letters, "").alias("acronym"))
    owners = p.groupBy("acronym").agg(F.countDistinct("p_brand").alias("owners")).where("owners = 1")
    f = p.join(owners, "acronym").where(F.length("acronym") >= 3).groupBy("p_brand", "acronym").agg(F.min("p_partkey").alias("first"))
    return f.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy("first"))).where("place <= 3").select("p_brand", "acronym", "place")


@query(rf"""WITH {CHUNKS_SQL}, h AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ (?:of|the|and) [a-z]+')) AS hit FROM chunks), c AS (SELECT doc_id, hit, lower(regexp_extract(hit, '^\S+ \S+')) AS cluster FROM h)
SELECT cluster, count(*) AS hits, count(DISTINCT doc_id) AS docs, array_to_string(list_sort(list_distinct(list(hit)))[1:5], ',') AS aliases FROM c GROUP BY cluster""")
def candidate_sweep(spark, sf_dir: str) -> DataFrame:
    """Pattern hits clustered by their first words, with up to five spellings."""
    h = chunks(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ (?:of|the|and) [a-z]+"), F.lit(0))).alias("hit"))
    c = h.withColumn("cluster", F.lower(F.regexp_extract("hit", r"^\S+ \S+", 0)))
    return c.groupBy("cluster").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"), F.array_join(F.slice(F.array_sort(F.collect_set("hit")), 1, 5), ",").alias("aliases"))


@query("SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE n_chars < 100")
def weak_selection(spark, sf_dir: str) -> DataFrame:
    """Distinct ids that any of several signs marks."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return labels.where("quality = 0 OR toxic = 1").select("doc_id").unionByName(docs.where("n_chars < 100").select("doc_id")).distinct()


@query(r"""WITH q AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(url, '\d+', '', 'g'), '/+$', '')) AS proxy FROM pages) SELECT page_id, proxy FROM q WHERE proxy <> url""")
def derived_queries(spark, sf_dir: str) -> DataFrame:
    """Numbers stripped; what doesn't change is dropped."""
    proxy = F.btrim(F.regexp_replace(F.regexp_replace("url", r"\d+", ""), "/+$", ""))
    return table(spark, sf_dir, "pages").select("page_id", "url", proxy.alias("proxy")).where("proxy <> url").select("page_id", "proxy")


@query("SELECT item_id, rep::INT AS rep, item_id % 3 AS set_id FROM benchmark, (SELECT unnest(range(1, 4)) AS rep) WHERE item_id % 3 IN (0, 2)")
def run_worklist(spark, sf_dir: str) -> DataFrame:
    """Selected sets crossed with their repeats."""
    return table(spark, sf_dir, "benchmark").where("item_id % 3 IN (0, 2)").select("item_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rep"), (F.col("item_id") % 3).alias("set_id"))


@query("SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous FROM events")
def previous_run(spark, sf_dir: str) -> DataFrame:
    """The run before of the same kind."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.lag("event_id").over(w).alias("previous"))


@query("SELECT p_partkey, link, v FROM (SELECT p_partkey, p_name AS name, p_type AS kind FROM part) UNPIVOT (v FOR link IN (name, kind)) WHERE NOT contains(v, (p_partkey % 10)::VARCHAR)")
def mismatch_report(spark, sf_dir: str) -> DataFrame:
    """Columns unpivoted, and those that don't name the row's own number kept."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    return part.unpivot("p_partkey", ["name", "kind"], "link", "v").where(~F.contains("v", (F.col("p_partkey") % 10).cast("string")))


@query("""SELECT event_id, CASE WHEN event_type = 'refund' THEN 'provider' WHEN value > 95 THEN 'dead model' WHEN props IS NULL THEN 'empty' ELSE 'none' END AS error, CASE WHEN value > 95 THEN least(30, pow(2, event_id % 4))::INT ELSE 0 END AS wait FROM events""")
def error_classes(spark, sf_dir: str) -> DataFrame:
    """Kinds of errors, and the wait of each retry."""
    kind = F.when(F.col("event_type") == "refund", "provider").when(F.col("value") > 95, "dead model").when(F.col("props").isNull(), "empty").otherwise("none")
    wait = F.when(F.col("value") > 95, F.least(F.lit(30.0), F.pow(F.lit(2.0), F.col("event_id") % 4)).cast("int")).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", kind.alias("error"), wait.alias("wait"))


@query("""WITH a AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, CASE WHEN used <= 500 THEN text ELSE '[' || length(text) || ' characters]' END AS body FROM a""")
def stubbed_payloads(spark, sf_dir: str) -> DataFrame:
    """Newest replies whole while they fit together, older ones as stubs."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("used", F.sum(F.length("text")).over(w))
    return rows.select("conv_id", "turn", F.when(F.col("used") <= 500, F.col("text")).otherwise(F.concat(F.lit("["), F.length("text").cast("string"), F.lit(" characters]"))).alias("body"))


@query(f"""WITH {CHUNKS_SQL} SELECT chunk_id, '{{"doc":' || doc_id || ',"pos":' || pos || CASE WHEN doc_type = 'en' THEN ',"kind":"en"' ELSE '' END || '}}' AS anchor FROM chunks""")
def chunk_rows(spark, sf_dir: str) -> DataFrame:
    """Anchors as JSON of the fields that aren't null."""
    kind = F.when(F.col("doc_type") == "en", F.col("doc_type"))
    return chunks(spark, sf_dir).select("chunk_id", F.to_json(F.struct(F.col("doc_id").alias("doc"), "pos", kind.alias("kind"))).alias("anchor"))


@query("""SELECT c_custkey, array_to_string(list_sort(list_distinct(list_transform([c_nationkey, c_nationkey % 5, c_nationkey % 3], lambda x: CASE WHEN x = 1 THEN 0 ELSE x END))), ',') AS labels FROM customer""", name="merged_labels")
def merged_labels(spark, sf_dir: str) -> DataFrame:
    """H2, L4: ids mapped, then the first of each kept in order (compared as sorted lists)."""
    n = F.col("c_nationkey")
    mapped = F.transform(F.array(n, n % 5, n % 3), lambda x: F.when(x == 1, 0).otherwise(x))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(F.array_distinct(mapped)), ",").alias("labels"))


@query("""SELECT o_orderkey, round(o_totalprice / 1e6::DOUBLE, 8) AS per_million, least(greatest(round(o_totalprice / 3000.0::DOUBLE, 2), 0), 100) AS percent FROM orders""")
def cost_helpers(spark, sf_dir: str) -> DataFrame:
    """Prices per million and clipped percentages."""
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(p / 1e6, 8).alias("per_million"), F.least(F.greatest(F.round(p / 3000, 2), F.lit(0.0)), F.lit(100.0)).alias("percent"))


@query("""SELECT doc_id, substr(h, 1, 2) || '/' || h || '.txt' AS place FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)""")
def staged_files(spark, sf_dir: str) -> DataFrame:
    """Where each upload is staged: by the hash of its content."""
    return table(spark, sf_dir, "documents").select("doc_id", staged_name(F.coalesce("text", F.lit("")).cast("binary"), F.lit(".txt")).alias("place"))
