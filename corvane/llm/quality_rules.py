"""Operator 9: quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed; a line is over its limit on a host when more than ``min_documents`` distinct documents of
that host hold it, however large the host. Documents are distinct by the hash of all their normalised lines, so that exact
copies of a document don't make its own lines frequent; documents of one line alone are distinct by id. Lines over the limit are
removed, and a document that keeps fewer than ``min_left`` words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import read_table, saved

# White space that parts words, and the symbols that are counted.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
BLANK_RUN = "[ \\t\\n\\x0B\\f\\r]+"
WINDOW = 8
MIN_DOCUMENTS = 20
MIN_LEFT = 10
BROADCAST_LINES = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def worded_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def normal_form(line: Column) -> Column:
    return F.translate(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), BLANK_RUN, " "), UPPER, LOWER)


def line_words(normal: Column) -> Column:
    return F.length(normal) - F.length(F.translate(normal, " ", "")) + 1


def text_statistics(df: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``_text`` (with ``_lines``, its worded lines)."""
    df = df.withColumn("_words", words_of(F.col("_text")))
    n = F.size("_words")
    df = df.withColumn("_windows", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    # Only texts in which a window is found again: windows by hash, then the places of those with an equal neighbour.
    df = df.withColumn("_sorted", F.when(F.col("_repeats"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    last = F.size("_sorted") - 1

    def has_twin(k: Column) -> Column:
        own = F.col("_sorted")[k]["h"]
        return ((k > 0) & (own == F.get("_sorted", k - 1)["h"])) | ((k < last) & (own == F.get("_sorted", k + 1)["h"]))

    df = df.withColumn("_places", F.when(F.col("_repeats"), F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), last), has_twin), lambda k: F.get("_sorted", k)["i"]))))
    end = F.size("_places") - 1
    covered = F.aggregate(F.sequence(F.lit(0), end), F.lit(0).cast("long"), lambda total, k: total + F.when(k == end, WINDOW).otherwise(F.least(F.lit(WINDOW), F.get("_places", k + 1) - F.get("_places", k))))
    return df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate("_text", BLANKS, "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("_repeats"), covered).otherwise(F.lit(0)).cast("long"),
        }
    ).drop("_words", "_windows", "_repeats", "_sorted", "_places")


def frequent_lines(lines: DataFrame, min_documents: int) -> DataFrame:
    """``_host, _h``: the hashes of each host's lines over the limit; ``lines``: _host, _h, _document."""
    # Counted in two steps: (host, line, document) spreads a hot line over all tasks.
    return lines.groupBy("_host", "_h").agg(F.countDistinct("_document").alias("_n")).where(F.col("_n") > min_documents).select("_host", "_h")


def small(df: DataFrame, rows: int) -> DataFrame:
    """A written table, marked for a broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def quality_rules(df: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", min_documents: int = MIN_DOCUMENTS, min_left: int = MIN_LEFT, clean: bool = True) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left_words, kept and (if ``clean``) clean_text.

    clean_text is the text without the lines over the limit (lines without a word go too). base_failed: fewer than 20
    words, or more than 30 % of them in windows of eight words found twice. kept: not base_failed, and at least
    ``min_left`` words are left. A null text counts as empty (it fails); rows of null host form one host. Repeated
    rows count as one document and get the same verdict; documents of one and the same line count by ``key`` (null keys as
    one). Whole texts are read, however long: a text's words are held at once by the task that reads it. Columns of the added
    names are replaced, all others kept, whatever their names. An empty table gives an empty one.

    Texts are read once: their statistics and line hashes (with the text only if ``clean``) go to a table that the
    second pass reads.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left_words", "kept", *(["clean_text"] if clean else [])]
    passed = [c for c in df.columns if c not in added and (clean or c != text)]
    # The caller's columns travel in one struct, apart from the columns of this function.
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in passed]).alias("_row") if passed else F.lit(None).alias("_row"), F.coalesce(F.col(host), F.lit("")).alias("_host"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(key).alias("_key"))
    base = base.withColumn("_lines", worded_lines(F.col("_text")))
    base = base.withColumn("_normal", F.transform("_lines", normal_form))
    document = F.when(F.size(F.array_distinct("_normal")) > 1, F.xxhash64("_normal")).otherwise(F.xxhash64(F.lit("id"), F.col("_key")))
    parsed = text_statistics(base).withColumns({"_document": document, "_hashes": F.transform("_normal", lambda x: F.xxhash64(x)), "_sizes": F.transform("_normal", line_words), "_no": F.monotonically_increasing_id()})
    # Written, not only planned: row numbers stay, and a filter on the results would copy these expressions into their lambdas.
    parsed = saved(parsed.drop("_normal", "_lines", "_text", "_key"))
    lines = parsed.select("_no", "_host", "_document", F.explode(F.array_distinct("_hashes")).alias("_h"))
    over = small(saved(frequent_lines(lines, min_documents)), BROADCAST_LINES)
    # A document's list holds some of its own lines.
    hits = small(saved(lines.join(over, ["_host", "_h"]).groupBy("_no").agg(F.collect_list("_h").alias("_over"))), BROADCAST_LINES // 5)
    joined = parsed.join(hits, "_no", "left").withColumn("_over", F.coalesce("_over", F.array().cast("array<bigint>")))
    left = F.zip_with("_hashes", "_sizes", lambda h, n: F.when(F.array_contains("_over", h), 0).otherwise(n))
    joined = joined.withColumn("n_left_words", F.aggregate(left, F.lit(0).cast("long"), lambda total, n: total + n))
    if clean:
        kept_lines = F.filter(F.arrays_zip(worded_lines(F.coalesce(F.col("_row")[text], F.lit(""))).alias("line"), F.col("_hashes").alias("h")), lambda x: ~F.array_contains("_over", x["h"]))
        joined = joined.withColumn("clean_text", F.array_join(F.transform(kept_lines, lambda x: x["line"]), "\n"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    joined = joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("n_left_words") >= min_left))
    return joined.select(*[F.col("_row")[c].alias(c) for c in passed], *added)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs, clean=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left_words", "kept")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
), win AS (
  SELECT rid, i, array_to_string(words[i:i+7], ' ') AS k
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), twice AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 8)) AS j) GROUP BY rid
), parts AS (
  SELECT *, list_transform(lines, lambda x: translate(regexp_replace(trim(x, e' \t\n\x0b\f\r'), '[\x20\x09-\x0D]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS normals
  FROM (SELECT rid, doc_id, host, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d)
), sized AS (
  SELECT rid, host, document, line, normal, length(normal) - length(replace(normal, ' ', '')) + 1 AS words
  FROM (SELECT rid, host, CASE WHEN len(list_distinct(normals)) > 1 THEN 'text ' || array_to_string(normals, chr(10)) ELSE 'id ' || coalesce(doc_id::VARCHAR, '') END AS document, unnest(lines) AS line, unnest(normals) AS normal FROM parts)
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM sized GROUP BY rid
), by_line AS (
  SELECT host, normal, count(DISTINCT document) AS n FROM sized GROUP BY host, normal
), over AS (
  SELECT host, normal FROM by_line WHERE n > 20
), kept_words AS (
  SELECT s.rid, sum(CASE WHEN o.normal IS NULL THEN s.words ELSE 0 END) AS n FROM sized s LEFT JOIN over o ON s.host = o.host AND s.normal = o.normal GROUP BY s.rid
), stats AS (
  SELECT d.doc_id, len(w.words) AS n_words, length(array_to_string(w.words, '')) AS word_chars,
    length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(k.n, 0) AS n_left_words
  FROM d JOIN w USING (rid) LEFT JOIN dup l USING (rid) LEFT JOIN covered c USING (rid) LEFT JOIN kept_words k USING (rid)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, n_left_words::BIGINT AS n_left_words,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_left_words >= 10 AS kept
FROM stats
"""
