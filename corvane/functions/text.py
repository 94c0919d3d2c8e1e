"""Text expressions: normalising, figures, years, slugs and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that a full-text query must not hold.
QUERY_SPECIALS = "'\"()[]{}^~:/\\?*"


def sanitize_query(q: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(q, QUERY_SPECIALS, " " * len(QUERY_SPECIALS)), "[ \\t\\n\\x0B\\f\\r]+", " "))


def normalize_for_match(s: Column) -> Column:
    """Lower case, punctuation but the hyphen to spaces, white space collapsed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_\s\-]", " "), r"\s+", " "))


def invert_comma(s: Column) -> Column:
    """``X, Dept of`` to ``Dept of X``."""
    return F.regexp_replace(s, r"^([^,]*), *(.+)$", "$2 $1")


def slugify(s: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), F.lit("-"))


def token_key(s: Column, stop: list[str]) -> Column:
    """Sorted words without stop words: an identity key for names."""
    words = F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(stop))
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def figures(text: Column) -> Column:
    """Amounts as they are written in the text (percentages are left out)."""
    found = F.regexp_extract_all(text, F.lit(r"(\(?\$?\d[\d,]*(?:\.\d+)?(?: ?(?:billion|million|thousand|B|M|K))?\)?%?)"), F.lit(1))
    return F.filter(found, lambda x: ~F.endswith(x, F.lit("%")))


def scale_of(figure: Column) -> Column:
    return F.when(figure.rlike("(billion|B)\\)?$"), 1e9).when(figure.rlike("(million|M)\\)?$"), 1e6).when(figure.rlike("(thousand|K)\\)?$"), 1e3).otherwise(1.0)


def value_of(figure: Column) -> Column:
    number = F.regexp_replace(figure, "[^0-9.]", "").cast("double")
    return F.when(figure.rlike(r"^\(.*\)$"), -number).otherwise(number) * scale_of(figure)


def halfwidth_of(figure: Column) -> Column:
    """Half of the last written place, scaled."""
    decimals = F.length(F.regexp_extract(figure, r"\.(\d+)", 1))
    return F.lit(0.5) * F.pow(F.lit(10.0), -decimals) * scale_of(figure)


def years_in(text: Column, first: int = 1984, last: int = 2035) -> Column:
    """Distinct four-digit years in range, sorted, and two-digit ones after FY."""
    full = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{4})\b"), F.lit(1)), lambda y: y.cast("int"))
    short = F.transform(F.regexp_extract_all(text, F.lit(r"\bFY ?'?(\d{2})\b"), F.lit(1)), lambda y: F.when(y.cast("int") >= 80, 1900 + y.cast("int")).otherwise(2000 + y.cast("int")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(full, short), lambda y: y.between(first, last))))


def widened(years: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(years, lambda y: F.sequence(y - 1, y + 1)))))


def ordinal(n: Column) -> Column:
    tail = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


def byte_range(header: Column, size: Column) -> Column:
    """``bytes=a-b``, open or suffix ranges as a struct; null if invalid."""
    a, b = (F.nullif(F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", i), F.lit("")).cast("long") for i in (1, 2))
    start = F.when(a.isNull(), F.greatest(size - b, F.lit(0))).otherwise(a)
    end = F.when(a.isNull() | b.isNull(), size - 1).otherwise(F.least(b, size - 1))
    return F.when(header.rlike(r"^bytes=(\d+-\d*|-\d+)$") & (start <= end) & (start < size), F.struct(start.alias("start"), end.alias("end")))


def name_reason(raw: Column) -> Column:
    """Why a name isn't one (null: it is)."""
    name = F.btrim(raw)
    return F.when(name == "", "empty").when(name.rlike(r"\.{3,}"), "dot leaders").when(name.rlike(r"\s\d+$"), "page number").when(F.contains(name, F.lit("  ")), "double space").when(F.length(name) > 90, "too long")
