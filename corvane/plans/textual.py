"""Text and number functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans.base import query, table


@query(r"""SELECT page_id, trim(regexp_replace(translate(url, '''"()[]{}^~:/\?*', '               '), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS q FROM pages""")
def sanitized_queries(spark, sf_dir: str) -> DataFrame:
    """Special characters to spaces."""
    return table(spark, sf_dir, "pages").select("page_id", T.sanitize_query(F.col("url")).alias("q"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s\-]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents""")
def match_normalized(spark, sf_dir: str) -> DataFrame:
    """The matcher's normal form."""
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_for_match(F.col("text")).alias("t"))


@query(r"""SELECT p_partkey, regexp_replace(p_brand || ', ' || p_type, '^([^,]*), *(.+)$', '\2 \1') AS name, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ('of', 'the')))), ' ') AS key FROM part""")
def part_names(spark, sf_dir: str) -> DataFrame:
    """Comma forms, slugs and token keys."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", T.invert_comma(F.concat_ws(", ", "p_brand", "p_type")).alias("name"), T.slugify(F.concat_ws(" ", "p_name", "p_type")).alias("slug"), T.token_key(F.col("p_name"), ["of", "the"]).alias("key"))


@query(r"""WITH f AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '\(?\$?\d[\d,]*(?:\.\d+)?(?: ?(?:billion|million|thousand|B|M|K))?\)?%?'), lambda x: NOT ends_with(x, '%'))) AS fig FROM documents)
SELECT doc_id, count(*) AS n, count(DISTINCT fig) AS kinds, max(length(fig)) AS longest FROM f GROUP BY doc_id""")
def figure_extraction(spark, sf_dir: str) -> DataFrame:
    """Amounts written in the texts."""
    f = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.figures(F.col("text"))).alias("fig"))
    return f.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("fig").alias("kinds"), F.max(F.length("fig")).cast("long").alias("longest"))


@query(r"""WITH v AS (SELECT o_orderkey, round(o_totalprice, 2) AS p, CASE o_orderkey % 3 WHEN 0 THEN printf('$%.1fK', round(o_totalprice / 1000, 1)) WHEN 1 THEN printf('(%.0f)', floor(o_totalprice)) ELSE printf('$%.2f', o_totalprice) END AS fig FROM orders),
s AS (SELECT *, CASE WHEN regexp_matches(fig, '(thousand|K)\)?$') THEN 1e3::DOUBLE ELSE 1.0::DOUBLE END AS sc, regexp_replace(fig, '[^0-9.]', '', 'g')::DOUBLE AS num FROM v)
SELECT o_orderkey, fig, round((CASE WHEN regexp_matches(fig, '^\(.*\)$') THEN -num ELSE num END) * sc, 4) AS value, round(0.5::DOUBLE * pow(10.0, -length(regexp_extract(fig, '\.(\d+)', 1))) * sc, 6) AS half FROM s""")
def figure_values(spark, sf_dir: str) -> DataFrame:
    """Written amounts to values and half widths."""
    p = F.col("o_totalprice")
    fig = F.when(F.col("o_orderkey") % 3 == 0, F.format_string("$%.1fK", F.round(p / 1000, 1))).when(F.col("o_orderkey") % 3 == 1, F.format_string("(%.0f)", F.floor(p).cast("double"))).otherwise(F.format_string("$%.2f", p))
    out = table(spark, sf_dir, "orders").select("o_orderkey", fig.alias("fig"))
    return out.select("o_orderkey", "fig", F.round(T.value_of(F.col("fig")), 4).alias("value"), F.round(T.halfwidth_of(F.col("fig")), 6).alias("half"))


@query(r"""WITH y AS (SELECT page_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(html, '\b\d{4}\b'), lambda v: v::INT), lambda v: v BETWEEN 1000 AND 9999))) AS y FROM pages)
SELECT page_id, array_to_string(y, ',') AS years, array_to_string(list_sort(list_distinct(flatten(list_transform(y, lambda v: [v - 1, v, v + 1])))), ',') AS wide FROM y WHERE len(y) > 0""")
def year_parsing(spark, sf_dir: str) -> DataFrame:
    """Years named in a text, and the years beside them."""
    y = table(spark, sf_dir, "pages").select("page_id", T.years_in(F.regexp_replace("html", "FY", ""), 1000, 9999).alias("y")).where(F.size("y") > 0)
    return y.select("page_id", F.array_join("y", ",").alias("years"), F.array_join(T.widened(F.col("y")), ",").alias("wide"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, nullif(regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1), '') AS lang, nullif(regexp_extract(url, '/(\d+)', 1), '')::BIGINT AS num, contains(url, '?') AS has_query FROM pages""")
def url_parts(spark, sf_dir: str) -> DataFrame:
    """What an address tells."""
    pages = table(spark, sf_dir, "pages")
    part = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return pages.select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), part(r"^https?://[^/]+/([a-z]{2})/").alias("lang"), part(r"/(\d+)").cast("long").alias("num"), F.contains("url", F.lit("?")).alias("has_query"))


@query(r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS href, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS label FROM pages),
e AS (SELECT page_id, unnest(range(1, len(href) + 1)) AS i, unnest(href) AS href, trim(regexp_replace(unnest(label), '\s+', ' ', 'g')) AS label FROM a)
SELECT page_id, href, label, i::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY i) AS n FROM e) WHERE n = 1""")
def link_scraper(spark, sf_dir: str) -> DataFrame:
    """Links of each page with their labels, the first of each address."""
    pattern = F.lit(r'<a href="([^"]*)">([^<]*)</a>')
    a = table(spark, sf_dir, "pages").select("page_id", F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("href"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("label")).alias("z"))
    e = a.select("page_id", F.posexplode("z").alias("i", "z"))
    first = e.groupBy("page_id", "z.href").agg(F.min(F.struct("i", "z.label")).alias("m"))
    return first.select("page_id", "href", F.btrim(F.regexp_replace("m.label", r"\s+", " ")).alias("label"), (F.col("m.i") + 1).alias("place"))


@query(r"""WITH n AS (SELECT doc_id, string_split(text, chr(10))[1] AS raw FROM documents) SELECT doc_id, CASE WHEN trim(raw) = '' THEN 'empty' WHEN regexp_matches(trim(raw), '\.{3,}') THEN 'dot leaders' WHEN regexp_matches(trim(raw), '\s\d+$') THEN 'page number' WHEN contains(trim(raw), '  ') THEN 'double space' WHEN length(trim(raw)) > 90 THEN 'too long' END AS reason FROM n""")
def name_validation(spark, sf_dir: str) -> DataFrame:
    """First lines as names, and why they aren't."""
    return table(spark, sf_dir, "documents").select("doc_id", T.name_reason(F.split("text", "\n")[0]).alias("reason"))


@query(r"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents), s AS (SELECT doc_id, len(t) AS n, list_filter(t, lambda x: length(x) >= 12) AS long FROM w) SELECT doc_id, n, len(long) AS n_long, list_sort(long)[1] AS sample FROM s""")
def query_terms(spark, sf_dir: str) -> DataFrame:
    """Distinct words and the distinctive ones."""
    t = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).withColumn("long", F.filter("t", lambda x: F.length(x) >= 12))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.size("long").cast("long").alias("n_long"), F.get(F.array_sort("long"), F.lit(0)).alias("sample"))


@query(r"""SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, CASE WHEN json_valid(props) THEN 'ok' ELSE 'bad' END AS state, sha256(coalesce(props, '')) AS hash FROM events""")
def json_records(spark, sf_dir: str) -> DataFrame:
    """JSON decoded defensively, content hashed."""
    k = F.from_json("props", "k bigint").getField("k")
    state = F.when(F.get_json_object("props", "$").isNotNull(), "ok").otherwise("bad")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), state.alias("state"), F.sha2(F.coalesce("props", F.lit("")), 256).alias("hash"))


@query(r"""SELECT c_custkey, c_custkey::VARCHAR || CASE WHEN c_custkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN c_custkey % 10 = 1 THEN 'st' WHEN c_custkey % 10 = 2 THEN 'nd' WHEN c_custkey % 10 = 3 THEN 'rd' ELSE 'th' END AS place,
printf('cust-%s-fy%04d', lower(c_mktsegment), 2005 + c_custkey % 23) AS made_id FROM customer""")
def made_ids(spark, sf_dir: str) -> DataFrame:
    """Ordinals and ids made from parts."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", T.ordinal(F.col("c_custkey")).alias("place"), F.format_string("cust-%s-fy%04d", F.lower("c_mktsegment"), 2005 + F.col("c_custkey") % 23).alias("made_id"))


@query(r"""WITH h AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bytes=' || (event_id % 900) || '-' || (event_id % 900 + 50) WHEN 1 THEN 'bytes=' || (event_id % 1200) || '-' WHEN 2 THEN 'bytes=-' || (event_id % 300 + 1) ELSE 'bytes=x-1' END AS h FROM events),
p AS (SELECT event_id, h, nullif(regexp_extract(h, '^bytes=(\d*)-(\d*)$', 1), '')::BIGINT AS a, nullif(regexp_extract(h, '^bytes=(\d*)-(\d*)$', 2), '')::BIGINT AS b FROM h),
r AS (SELECT event_id, h, CASE WHEN a IS NULL THEN greatest(1000 - b, 0) ELSE a END AS s, CASE WHEN a IS NULL OR b IS NULL THEN 999 ELSE least(b, 999) END AS e FROM p)
SELECT event_id, CASE WHEN regexp_matches(h, '^bytes=(\d+-\d*|-\d+)$') AND s <= e AND s < 1000 THEN s END AS start, CASE WHEN regexp_matches(h, '^bytes=(\d+-\d*|-\d+)$') AND s <= e AND s < 1000 THEN e END AS stop FROM r""")
def byte_ranges(spark, sf_dir: str) -> DataFrame:
    """I32: range headers."""
    i = F.col("event_id")
    h = F.when(i % 4 == 0, F.concat(F.lit("bytes="), (i % 900).cast("string"), F.lit("-"), (i % 900 + 50).cast("string"))).when(i % 4 == 1, F.concat(F.lit("bytes="), (i % 1200).cast("string"), F.lit("-"))).when(i % 4 == 2, F.concat(F.lit("bytes=-"), (i % 300 + 1).cast("string"))).otherwise("bytes=x-1")
    r = table(spark, sf_dir, "events").select("event_id", T.byte_range(h, F.lit(1000).cast("long")).alias("r"))
    return r.select("event_id", F.col("r.start").alias("start"), F.col("r.end").alias("stop"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\s*\[\[[^\]]*\]\]', '', 'g'), '[*_`]+', '', 'g') AS clean FROM documents) SELECT doc_id, length(clean) AS n, md5(clean) AS hash FROM t""")
def marker_stripping(spark, sf_dir: str) -> DataFrame:
    """Markers and emphasis removed."""
    clean = F.regexp_replace(F.regexp_replace("text", r"\s*\[\[[^\]]*\]\]", ""), "[*_`]+", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(clean).cast("long").alias("n"), F.md5(clean).alias("hash"))


@query(r"""WITH r AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\b\d{3}-\d{4}\b')) AS refs FROM documents) SELECT doc_id, len(refs) AS n, array_to_string(list_sort(refs), ',') AS refs FROM r WHERE len(refs) > 0""")
def section_references(spark, sf_dir: str) -> DataFrame:
    """I16: distinct hyphenated references of a text."""
    refs = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b\d{3}-\d{4}\b"), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", refs.alias("r")).where(F.size("r") > 0).select("doc_id", F.size("r").cast("long").alias("n"), F.array_join(F.array_sort("r"), ",").alias("refs"))


@query(r"""WITH m AS (SELECT doc_id, regexp_extract_all(lower(text), 'apache license|mit license|gnu general public license|cc by-nc|all rights reserved|license') AS hits FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(hits)), ',') AS types, len(list_filter(hits, lambda h: h = 'license')) = 0 AS exact FROM m WHERE len(hits) > 0""")
def type_phrases(spark, sf_dir: str) -> DataFrame:
    """Phrases longest first; a text is filterable if none of its matches is the weak one."""
    hits = F.regexp_extract_all(F.lower("text"), F.lit("apache license|mit license|gnu general public license|cc by-nc|all rights reserved|license"), F.lit(0))
    m = table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits")).where(F.size("hits") > 0)
    return m.select("doc_id", F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("types"), (~F.array_contains("hits", "license")).alias("exact"))


@query(r"""WITH l AS (SELECT doc_id, i, t, regexp_matches(t, '^\S+ \| ') AS listed FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS t FROM documents))
SELECT doc_id, count(*) AS lines, count(*) FILTER (listed) AS listed, min(i) FILTER (listed) AS first FROM l GROUP BY doc_id""")
def heading_split(spark, sf_dir: str) -> DataFrame:
    """Lines of a text by kind."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).withColumn("listed", F.col("t").rlike(r"^\S+ \| "))  # noqa: E741
    return l.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("listed").alias("listed"), (F.min(F.when(F.col("listed"), F.col("i"))) + 1).cast("long").alias("first"))


@query(r"""SELECT o_orderkey, printf('$%.2f %.2f ($%.2f)', o_totalprice, o_totalprice, o_totalprice) AS forms FROM orders""")
def locate_candidates(spark, sf_dir: str) -> DataFrame:
    """The ways in which an amount may be written (joined in order of the list)."""
    forms = F.array(*[F.format_string(p, "o_totalprice") for p in ("$%.2f", "%.2f", "($%.2f)")])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_distinct(forms), " ").alias("forms"))


@query(r"""WITH t AS (SELECT page_id, regexp_extract(url, '([^/?#.]+)(?:[.?#][^/]*)?$', 1) AS tail FROM pages) SELECT page_id, tail, regexp_matches(tail, '^([a-z]{1,3}\d+|\d+)$') AS is_section FROM t""")
def id_tails(spark, sf_dir: str) -> DataFrame:
    """An id's tail, and whether it names a section."""
    tail = F.regexp_extract("url", r"([^/?#.]+)(?:[.?#][^/]*)?$", 1)
    return table(spark, sf_dir, "pages").select("page_id", tail.alias("tail")).withColumn("is_section", F.col("tail").rlike(r"^([a-z]{1,3}\d+|\d+)$"))
