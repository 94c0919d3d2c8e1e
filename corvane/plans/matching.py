"""Names in queries and text: the catalog's bodies are the benchmark items, each named by its first words.

An item whose first word has more than four letters is recorded twice, as catalogs do: with its name turned round at a comma and without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import entities as E
from corvane.operators import matching as M
from corvane.operators.retrieval import tokens
from corvane.plans.base import CHUNKS_SQL, chunks, query, table
from corvane.sources.shared import saved

AMBIGUOUS = ["the", "and", "of"]
CURATED = ["that", "the thnt"]
SUPPRESSED = ["is", "or"]
SWITCHED_OFF = ["it", "in"]
SECOND = 1000  # ids of second records


def _bodies(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), M.words_of(F.col("text")).alias("w")).where(F.size("w") > 8)


def _catalog(spark, sf_dir: str) -> DataFrame:
    w = F.col("w")
    turned = F.concat(F.array_join(F.slice(w, 3, 2), " "), F.lit(", "), F.array_join(F.slice(w, 1, 2), " "))
    b = _bodies(spark, sf_dir)
    return b.select("id", turned.alias("name")).unionByName(b.where(F.length(w[0]) > 4).select((F.col("id") + SECOND).alias("id"), F.array_join(F.slice(w, 1, 4), " ").alias("name")))


def _meanings(spark, sf_dir: str) -> DataFrame:
    b = _bodies(spark, sf_dir)
    aliases = b.select("id", F.explode(F.array(F.col("w")[0], F.array_join(F.slice("w", 5, 2), " "))).alias("alias"))
    overlay = b.select("id", F.array_join(F.slice("w", 7, 2), " ").alias("alias"))
    off = spark.createDataFrame([(a,) for a in SWITCHED_OFF], "alias string")
    return M.phrase_meanings(_catalog(spark, sf_dir), aliases, overlay, AMBIGUOUS, CURATED, SUPPRESSED, off)


def _list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_WORD = r"'[\p{L}\p{N}]+'"
_BODIES_SQL = f"b AS (SELECT item_id AS id, regexp_extract_all(lower(text), {_WORD}) AS w FROM benchmark WHERE len(regexp_extract_all(lower(text), {_WORD})) > 8)"
_USABLE_SQL = f"length(phrase) >= 5 AND len(list_filter(string_split(phrase, ' '), lambda x: x NOT IN {_list(M.ORGANISATION_WORDS + M.FUNCTION_WORDS)})) > 0"
#: Greedy choice among the hits of a text: the list so far, and one more that overlaps with none of it.
_MEANINGS_SQL = f"""{_BODIES_SQL}, two AS (SELECT id, w FROM b UNION ALL SELECT id + {SECOND}, w FROM b WHERE length(w[1]) > 4),
gr AS (SELECT id, array_to_string(list_sort(list_filter(w[1:4], lambda x: x NOT IN {_list(M.GROUP_STOP_WORDS)})), ' ') AS grp FROM two),
nm AS (SELECT id, unnest([array_to_string(w[3:4], ' ') || ' ' || array_to_string(w[1:2], ' '), array_to_string(w[1:4], ' '), array_to_string(w[3:4], ' ')]) AS phrase FROM b
  UNION ALL SELECT id + {SECOND}, array_to_string(w[1:4], ' ') FROM b WHERE length(w[1]) > 4),
ba AS (SELECT DISTINCT * FROM (SELECT 1 AS tier, phrase, id FROM nm WHERE {_USABLE_SQL}
  UNION ALL SELECT 2, phrase, id FROM (SELECT unnest([w[1], array_to_string(w[5:6], ' ')]) AS phrase, id FROM b) WHERE phrase NOT IN {_list(SUPPRESSED + SWITCHED_OFF)}
  UNION ALL SELECT 3, phrase, id FROM (SELECT array_to_string(w[7:8], ' ') AS phrase, id FROM b) WHERE phrase NOT IN {_list(SWITCHED_OFF)})),
tl AS (SELECT tier, phrase, tier < 3 AND (phrase IN {_list(CURATED)} OR (count(DISTINCT grp) = 1 AND phrase NOT IN {_list(AMBIGUOUS)} AND (tier = 1 OR length(phrase) >= 3))) AS exact FROM ba JOIN gr USING (id) GROUP BY tier, phrase),
me AS (SELECT DISTINCT tier, phrase, g2.id, exact FROM ba JOIN tl USING (tier, phrase) JOIN gr g1 ON g1.id = ba.id JOIN gr g2 ON g2.grp = g1.grp AND (exact OR tier = 3 OR g2.id = g1.id))"""


@query(rf"""WITH {CHUNKS_SQL}, {_MEANINGS_SQL}, w AS (SELECT chunk_id, regexp_extract_all(lower(text), {_WORD}) AS w FROM chunks), p AS (SELECT chunk_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
ph AS (SELECT DISTINCT tier, phrase, len(string_split(phrase, ' ')) AS n FROM me),
h AS (SELECT chunk_id, tier, phrase, i AS s, i + n AS e FROM (SELECT p.chunk_id, p.i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM p, (SELECT DISTINCT n FROM ph) WHERE i + n - 1 <= len(w)) JOIN ph USING (phrase, n)),
l AS (SELECT chunk_id, list({{'tier': tier, 'phrase': phrase, 's': s, 'e': e}} ORDER BY tier, length(phrase) DESC, s, phrase) AS l FROM h GROUP BY chunk_id),
k AS (SELECT chunk_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS u FROM l),
f AS (SELECT chunk_id, me.id, me.tier, k.u.s - 1 AS start, me.phrase, exact, row_number() OVER (PARTITION BY chunk_id, me.id ORDER BY me.tier, k.u.s) AS z FROM k JOIN me ON me.tier = k.u.tier AND me.phrase = k.u.phrase)
SELECT chunk_id, id, tier, phrase, start, CASE WHEN exact AND id <> 3 THEN 'EXACT' ELSE 'WEAK' END AS confidence FROM f WHERE z = 1""")
def agency_parsing(spark, sf_dir: str) -> DataFrame:
    """The bodies that each chunk names, by names, then aliases, then an overlay; what a tier claims is hidden from the next; EXACT widens to the body's ids."""
    return M.parse_names(chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id", "text", _meanings(spark, sf_dir), weak_ids=[3])


@query()
def agency_fallback(spark, sf_dir: str) -> DataFrame:
    """Questions without an exact match by the tiers are told by the widest window that resembles a name (token set ratio 85); tested against a plain search."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), F.coalesce("text", F.lit("")).alias("text"))
    told = M.claimed_spans(turns, "turn_id", "text", _meanings(spark, sf_dir).where("exact").select("tier", "phrase").distinct())
    return M.fuzzy_windows(turns.join(told.select("turn_id").distinct(), "turn_id", "left_anti"), "turn_id", "text", _catalog(spark, sf_dir))


def _titles(spark, sf_dir: str) -> DataFrame:
    """A document's title: the first five words of its first line with words; titles of up to 100 letters."""
    first = F.regexp_extract("text", r"(?md)^[^\n]*?[\p{L}\p{N}][^\n]*", 0)
    name = F.array_join(F.slice(M.words_of(first), 1, 5), " ")
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).where((F.length("name") > 0) & (F.length("name") <= 100))


def _lcs_sql(a: str, b: str) -> str:
    """Letters of the longest common subsequence of two strings of up to 120, by the bits of a HUGEINT."""
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    masks = f"list_transform(string_split({b}, ''), lambda c: list_reduce(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN {a}[i] = c THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END), lambda x, y: x + y))"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"


_TITLES_SQL = f"""t AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(lower(x), {_WORD})) > 0)[1]), {_WORD})[1:5], ' ') AS name FROM documents),
n AS (SELECT DISTINCT name, string_split(name, ' ') AS w FROM t WHERE length(name) BETWEEN 1 AND 100)"""


@query(f"""WITH {_TITLES_SQL}, p AS (SELECT a.name AS "left", b.name AS "right", list_sort(list_distinct(a.w)) AS x, list_sort(list_distinct(b.w)) AS y, array_to_string(list_sort(a.w), ' ') AS s, array_to_string(list_sort(b.w), ' ') AS t FROM n a JOIN n b ON a.name < b.name),
q AS (SELECT *, array_to_string(list_filter(x, lambda v: list_contains(y, v)), ' ') AS i, array_to_string(list_filter(x, lambda v: NOT list_contains(y, v)), ' ') AS l, array_to_string(list_filter(y, lambda v: NOT list_contains(x, v)), ' ') AS r FROM p),
u AS (SELECT *, trim(i || ' ' || l) AS il, trim(i || ' ' || r) AS ir FROM q),
v AS (SELECT *, CASE WHEN 200.0::DOUBLE * least(length(s), length(t)) >= 85 * (length(s) + length(t)) THEN 200.0::DOUBLE * {_lcs_sql("s", "t")} / (length(s) + length(t)) ELSE 0 END AS sorted,
  CASE WHEN i <> '' AND (l = '' OR r = '') THEN 100.0::DOUBLE ELSE greatest(CASE WHEN 200.0::DOUBLE * least(length(il), length(ir)) >= 85 * (length(il) + length(ir)) THEN 200.0::DOUBLE * {_lcs_sql("il", "ir")} / (length(il) + length(ir)) ELSE 0 END,
    CASE WHEN i = '' THEN 0 ELSE 200.0::DOUBLE * length(i) / (length(i) + length(il)) END, CASE WHEN i = '' THEN 0 ELSE 200.0::DOUBLE * length(i) / (length(i) + length(ir)) END) END AS in_set FROM u)
SELECT 'sort' AS kind, "left", "right", round(sorted, 4) AS score FROM v WHERE sorted >= 85 - 1e-9 UNION ALL SELECT 'set', "left", "right", round(in_set, 4) FROM v WHERE in_set >= 85 - 1e-9""")
def fuzzy_title_pairs(spark, sf_dir: str) -> DataFrame:
    """All pairs of titles whose token sort or token set ratio is 85 or more."""
    names = saved(_titles(spark, sf_dir).select("name").distinct())
    pairs = [M.ratio_pairs(names, names, kind, ordered=True).select(F.lit(kind).alias("kind"), "left", "right", F.round("score", 4).alias("score")) for kind in ("sort", "set")]
    return pairs[0].unionByName(pairs[1])


_N = "array_to_string(regexp_extract_all(lower(%s), '[a-z0-9]+'), ' ')"


@query(f"""WITH c AS (SELECT DISTINCT conv_id * 100 + turn AS id, {_N % "array_to_string(string_split(text, ' ')[1:7], ' ')"} AS name FROM conversations), k AS (SELECT DISTINCT id, {_N % "name"} AS name FROM (SELECT item_id AS id, array_to_string(string_split(text, ' ')[1:4], ' ') AS name FROM benchmark UNION ALL SELECT 1000 + item_id, array_to_string(string_split(text, ' ')[1:2], ' ') FROM benchmark)),
x AS (SELECT id AS key, name FROM c WHERE name <> ''), e AS (SELECT id, name FROM k WHERE name <> ''), u AS (SELECT name, min(id) AS id FROM e GROUP BY name),
w AS (SELECT key, x.name AS cand, e.id, e.name, list_distinct(string_split(x.name, ' ')) AS p, list_distinct(string_split(e.name, ' ')) AS q FROM x, e),
r AS (SELECT key, 1 AS rung, id, name, 0.0::DOUBLE AS o, 0 AS o2 FROM x JOIN u USING (name)
  UNION ALL SELECT key, 2, id, name, -round(len(list_intersect(p, q))::DOUBLE / len(list_distinct(p || q)), 6), 0 FROM w WHERE round(len(list_intersect(p, q))::DOUBLE / len(list_distinct(p || q)), 6) >= 0.4
  UNION ALL SELECT key, 3, u.id, u.name, -length(u.name), position(' ' || u.name || ' ' IN ' ' || x.name || ' ') FROM x, u WHERE length(u.name) >= 6 AND contains(' ' || x.name || ' ', ' ' || u.name || ' ')
  UNION ALL SELECT key, 4, u.id, u.name, levenshtein(x.name, u.name), 0 FROM x, u WHERE levenshtein(x.name, u.name) <= CASE WHEN greatest(length(x.name), length(u.name)) >= 8 THEN 2 WHEN greatest(length(x.name), length(u.name)) >= 5 THEN 1 ELSE 0 END)
SELECT key, arg_min(rung, (rung, o, o2, id)) AS rung, arg_min(id, (rung, o, o2, id)) AS id, arg_min(name, (rung, o, o2, id)) AS name FROM r GROUP BY key""")
def match_ladder(spark, sf_dir: str) -> DataFrame:
    """A turn's first seven words as a candidate for the bodies' names: equal, by shared words, holding one, or a few edits apart."""
    first = lambda n: F.array_join(F.slice(F.split("text", " "), 1, n), " ")
    items = table(spark, sf_dir, "benchmark")
    catalog = items.select(F.col("item_id").alias("id"), first(4).alias("name")).unionByName(items.select((F.col("item_id") + 1000).alias("id"), first(2).alias("name")))
    candidates = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("key"), first(7).alias("name"))
    return E.match_ladder(candidates, "key", catalog).select("key", "rung", "id", "name")


_TOKENS = "regexp_extract_all(lower(text), '[a-z][a-z0-9]+')"


@query(f"""WITH a AS (SELECT DISTINCT unnest({_TOKENS}) AS w FROM benchmark), b AS (SELECT DISTINCT unnest({_TOKENS}) AS w FROM conversations),
p AS (SELECT a.w AS "left", b.w AS "right", levenshtein(a.w, b.w) AS distance, greatest(length(a.w), length(b.w)) AS n FROM a JOIN b ON abs(length(a.w) - length(b.w)) <= 2)
SELECT "left", "right", distance FROM p WHERE distance <= CASE WHEN n >= 8 THEN 2 WHEN n >= 5 THEN 1 ELSE 0 END""")
def typo_tolerant_words(spark, sf_dir: str) -> DataFrame:
    """Words of the items with words of the conversations that are the same but for one or two letters."""
    words = lambda name: table(spark, sf_dir, name).select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    return M.near_words(words("benchmark"), words("conversations"))


_LINES_SQL = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')[1:10]"""


@query(rf"""WITH {_BODIES_SQL}, sl AS (SELECT min(id) AS id, slug FROM (SELECT id, unnest(w) AS slug FROM b) WHERE length(slug) >= 3 GROUP BY slug),
nm AS (SELECT id, array_to_string(w[3:4], ' ') || ' ' || array_to_string(w[1:2], ' ') AS name FROM b),
ps AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^https?://([^/?#]+)', 1), '.'), lambda x: x NOT IN ('www', 'm', 'blog'))[1] AS slug FROM pages),
r1 AS (SELECT page_id, 1 AS rung, sl.id, slug AS evidence FROM ps JOIN sl USING (slug)),
r2 AS (SELECT page_id, 2 AS rung, arg_max(sl.id, length(sl.slug)) AS id, arg_max(sl.slug, length(sl.slug)) AS evidence FROM ps JOIN sl ON starts_with(ps.slug, sl.slug) GROUP BY page_id),
c AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS i, l FROM (SELECT page_id, {_LINES_SQL} AS l FROM pages)), k AS (SELECT page_id, i, array_to_string(regexp_extract_all(lower(l[i]), {_WORD}), ' ') AS name FROM c),
r3 AS (SELECT page_id, 3 AS rung, arg_min(nm.id, (i, nm.id)) AS id, arg_min(name, (i, nm.id)) AS evidence FROM k JOIN nm USING (name) GROUP BY page_id),
a AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)
SELECT page_id, arg_min(rung, rung) AS rung, arg_min(id, rung) AS id, arg_min(evidence, rung) AS evidence FROM a GROUP BY page_id""")
def stamping_ladder(spark, sf_dir: str) -> DataFrame:
    """L1: the body that a page is of: its host as a slug, the longest slug that the host begins with, a name among its first ten lines, turned round, or alike.

    On these tables the ladder's fuzzy rung has nothing to add (no line resembles a name), so SQL has the others; tests have rows for every rung.
    """
    slugs = _bodies(spark, sf_dir).select("id", F.explode("w").alias("slug")).where(F.length("slug") >= 3).groupBy("slug").agg(F.min("id").alias("id"))
    names = _bodies(spark, sf_dir).select("id", F.concat(F.array_join(F.slice("w", 3, 2), " "), F.lit(", "), F.array_join(F.slice("w", 1, 2), " ")).alias("name"))
    host = F.split(F.regexp_extract("url", "^https?://([^/?#]+)", 1), "\\.")
    slug = F.get(F.filter(host, lambda x: ~x.isin("www", "m", "blog")), F.lit(0))
    bare = F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), "<[^>]*>", "\n")
    lines = F.slice(F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))), lambda x: x != ""), 1, 10)
    pages = table(spark, sf_dir, "pages").select("page_id", slug.alias("slug"), lines.alias("lines"))
    return M.stamped(pages, "page_id", slugs, names).select("page_id", "rung", "id", "evidence")
