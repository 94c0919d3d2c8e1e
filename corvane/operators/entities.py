"""Matching names in text, fuzzy matching and figure reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.matching import claimed_spans, first_rung, near_words
from corvane.sources.shared import saved


def phrase_spans(rows: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """``key, name, start, end``: longest-first, non-overlapping occurrences of catalog names in the texts, word by word.

    Of overlapping hits that of more words, then the earlier, is kept (see ``claimed_spans``).
    """
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    catalog = names.select(F.lit(1).alias("tier"), F.col(name).alias("phrase"))
    return claimed_spans(rows, key, text, catalog, split, by_letters=False).select(key, F.col("phrase").alias("name"), "start", "end")


def token_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def name_classes(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``words, class_id, id``: rows by their distinct lower-case words, sorted; class_id is the smallest id with the same words."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.col(name)), F.lit("[a-z0-9]+"), F.lit(0))))
    listed = rows.select(F.col(key).alias("id"), words.alias("words")).where(F.size("words") > 0)
    return listed.join(listed.groupBy("words").agg(F.min("id").alias("class_id")), "words").select("words", "class_id", "id")


def fuzzy_classes(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """``left_class, right_class, score``: classes of names (see ``name_classes``) whose words overlap by ``floor`` or more (Jaccard).

    Of a name's words, rarest first, only so many are joined on that a pair of the floor must share one of them: a word that
    every name holds is hardly ever among them.
    """
    a, b = (x.select("class_id", "words").distinct() for x in (left, right))
    spread = a.unionByName(b).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def keys(side: DataFrame, name: str) -> DataFrame:
        ordered = side.select("class_id", "words", F.explode("words").alias("word")).join(spread, "word").groupBy("class_id", "words").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("o"))
        first = F.size("words") - F.ceil(F.lit(floor) * F.size("words") - 1e-9) + 1
        return ordered.select(F.col("class_id").alias(f"{name}_class"), F.col("words").alias(name), F.explode(F.slice("o", F.lit(1), first.cast("int"))).alias("k")).withColumn("k", F.col("k.word"))

    pairs = keys(a, "left").join(keys(b, "right"), "k").drop("k").distinct()
    return pairs.select("left_class", "right_class", F.round(token_jaccard(F.col("left"), F.col("right")), 6).alias("score")).where(F.col("score") >= floor)


def near_word(a: Column, b: Column) -> Column:
    """Equal, or of 5 letters and one edit apart, or of 8 and two."""
    longest = F.greatest(F.length(a), F.length(b))
    return (a == b) | ((longest >= 8) & (F.levenshtein(a, b) <= 2)) | ((longest >= 5) & (F.levenshtein(a, b) <= 1))


def tolerance_join(targets: DataFrame, sources: DataFrame, by: str, target: str, value: str, width: str, source_key: str, each: list[str] | None = None) -> DataFrame:
    """Targets with the first source of the same ``by`` whose value is within ``greatest(width, 0.5)``, by ``source_key`` and value; ``each``: what one is kept for (all columns of the targets).

    Values are dealt to buckets of the largest width, and a target looks into its own and the two beside it: an equi-join.
    """
    size = F.broadcast(targets.agg(F.greatest(F.max(F.greatest(F.col(width), F.lit(0.5))), F.lit(0.5)).alias("_size")))  # one row
    t = targets.crossJoin(size).withColumn("_bucket", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.floor(F.col(target) / F.col("_size")) + i)))
    s = sources.crossJoin(size).select(by, value, source_key, F.floor(F.col(value) / F.col("_size")).alias("_bucket"))
    hit = t.join(s, [by, "_bucket"]).where(F.abs(F.col(value) - F.col(target)) <= F.greatest(F.col(width), F.lit(0.5)))
    w = Window.partitionBy(*(each or targets.columns)).orderBy(source_key, value)
    return hit.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*targets.columns, source_key, value)


def groups_of_edges(edges: DataFrame, by: list[str]) -> DataFrame:
    """``*by, node, group``: the smallest node that each node of the edges ``*by, a, b`` reaches, within its ``by``.

    Every round a node takes the smallest label around it and that label's own; chains shorten by more than half each time.
    """
    both = saved(edges.select(*by, "a", "b").unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy(*by, F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("group")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias("node")).agg(F.min("group").alias("near"))
        hop = labels.select(*by, F.col("node").alias("group"), F.col("group").alias("far"))
        new = labels.join(around, [*by, "node"]).join(hop, [*by, "group"], "left")
        new = saved(new.select(*by, "node", F.least("group", "near", F.coalesce("far", "group")).alias("new"), F.col("group").alias("old")))
        labels = new.select(*by, "node", F.col("new").alias("group"))
        if new.where("new <> old").isEmpty():
            return labels


def containment_groups(df: DataFrame, by: str, key: str, text: str) -> DataFrame:
    """``by, key, group``: within ``by``, rows whose texts are equal or of which one holds the other, word by word, are tied.

    Texts are compared by their lower-case words in order; one without words is tied to none. group is the smallest key reached.
    Equal texts are one node; a text is looked for only where its rarest word is (an equi-join), so neither a
    large ``by`` nor a hot text is ever in one task.
    """
    joined = F.array_join(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)), " ")
    rows = saved(df.select(by, key, joined.alias("_t")))
    nodes = saved(rows.where("_t <> ''").groupBy(by, "_t").agg(F.min(key).alias("_first")))
    words = nodes.select(by, "_first", F.explode(F.array_distinct(F.split("_t", " "))).alias("_w"))
    spread = words.groupBy(by, "_w").agg(F.count("*").alias("_n"))
    rarest = words.join(spread, [by, "_w"]).groupBy(by, "_first").agg(F.min_by("_w", F.struct("_n", "_w")).alias("_w"))
    met = rarest.select(by, "_w", F.col("_first").alias("a")).join(words.select(by, "_w", F.col("_first").alias("b")), [by, "_w"]).where("a <> b").select(by, "a", "b").distinct()
    padded = F.concat(F.lit(" "), "_t", F.lit(" "))
    inner, outer = (nodes.select(by, F.col("_first").alias(k), padded.alias(t)) for k, t in (("a", "_inner"), ("b", "_outer")))
    edges = met.join(inner, [by, "a"]).join(outer, [by, "b"]).where(F.contains("_outer", "_inner")).select(by, "a", "b")
    tied = groups_of_edges(edges, [by])
    named = nodes.join(tied.withColumnRenamed("node", "_first"), [by, "_first"], "left").select(by, "_t", F.coalesce("group", "_first").alias("group"))
    return rows.join(named, [by, "_t"], "left").select(by, key, F.coalesce("group", key).alias("group"))


def match_ladder(candidates: DataFrame, key: str, catalog: DataFrame, floor: float = 0.4, least: int = 6) -> DataFrame:
    """``key, rung, id, name``: the catalog entry (``id, name``) that each candidate (``key, name``) is, by the first rung that tells.

    1 equal words in order, 2 the largest overlap of words of ``floor`` or more, 3 an entry of ``least`` letters held by the candidate, the longest and first, 4 a
    few edits apart (see ``near_words``). Of equals the smallest id. Each rung is an equi-join.
    """
    normal = F.array_join(F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), F.lit(0)), " ")
    asked, known = (saved(df.select(k, normal.alias("name")).where("name <> ''").distinct()) for df, k in ((candidates, key), (catalog, "id")))
    entry = known.groupBy("name").agg(F.min("id").alias("id"))
    one = lambda met, rank: met.groupBy(key).agg(F.min_by(F.struct("id", "entry"), rank).alias("_b")).select(key, "_b.id", F.col("_b.entry").alias("name"))
    equal = asked.join(entry, "name").select(key, "id", "name")
    sides = [name_classes(df, k, "name") for df, k in ((asked, key), (known, "id"))]
    met = fuzzy_classes(*sides, floor).join(sides[0].select(F.col("class_id").alias("left_class"), F.col("id").alias(key)), "left_class")
    met = met.join(sides[1].select(F.col("class_id").alias("right_class"), "id"), "right_class").join(known.withColumnRenamed("name", "entry"), "id")
    shared = one(met, F.struct(-F.col("score"), "id"))
    spans = claimed_spans(asked, key, "name", entry.where(F.length("name") >= least).select(F.lit(1).alias("tier"), F.col("name").alias("phrase")))
    held = one(spans.join(entry.withColumnRenamed("name", "phrase"), "phrase").withColumn("entry", F.col("phrase")), F.struct(-F.length("phrase"), "start"))
    close = near_words(asked, known, "name").join(entry.withColumnRenamed("name", "right"), "right").withColumn("entry", F.col("right"))
    near = one(asked.join(close, asked["name"] == close["left"]).select(key, "distance", "id", "entry"), F.struct("distance", "id"))
    return first_rung([equal, shared, held, near], [key])
