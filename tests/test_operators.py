"""Operators on hand-made rows: ties, nulls, empty tables and boundaries."""

import random

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import citations, corpus, entities, ledger, retrieval, structure


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_fusion_ties_go_by_id(spark):
    leg = lambda *x: spark.createDataFrame(list(x), "query_id int, chunk_id string, rank int")
    got = retrieval.fuse([leg((1, "b", 1), (1, "a", 2)), leg((1, "a", 1), (1, "c", 2))])
    assert rows(got, "rank", "chunk_id") == [(1, "a"), (2, "b"), (3, "c")]
    assert retrieval.fuse([leg((1, "a", 1)).limit(0), leg((1, "a", 1)).limit(0)]).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, None), (3, ["b"])], "id int, tags array<string>")
    assert rows(retrieval.filter_predicate(df, tags=["a", "c"]), "id") == [(1,)]
    assert retrieval.filter_predicate(df, tags=None, id=[]).count() == 3


def test_recency_and_match(spark):
    df = spark.createDataFrame([(1, "a", 2020, 1.0), (1, "b", None, 1.0), (1, "c", 2018, 1.0), (2, "d", None, 1.0)], "query_id int, chunk_id string, fiscal_year int, score double")
    got = {r.chunk_id: r.score for r in retrieval.recency_penalty(df).collect()}
    assert got == {"a": 1.0, "b": 1.0 - 1.7, "c": 1.0 - 1.7, "d": 1.0}
    assert {r.score for r in retrieval.match_penalty(df, F.lit(None).cast("boolean")).collect()} == {-1.0}


def test_upsert_and_changes(spark):
    df = lambda *x: spark.createDataFrame(list(x), "k int, v string, pos int")
    assert rows(corpus.upsert(df((1, "a", 0), (2, "b", 0)), df((2, "x", 1), (2, "y", 2)), "k", "pos"), "k", "v") == [(1, "a"), (2, "y")]
    assert rows(corpus.change_set(df((1, None, 0), (2, "b", 0)), df((1, None, 0), (2, "c", 0)), "k", "v"), "k", "before", "after") == [(2, "b", "c")]
    assert rows(corpus.full_comparison(df((1, "a", 0), (2, "b", 0)), df((2, "c", 0), (3, "d", 0)), "k", "v"), "k", "state") == [(1, "missing"), (2, "changed"), (3, "orphan")]


def test_islands_and_ranges(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "a", None, None, "b"])], "u int, i int, s string")
    assert [r.segment for r in ledger.islands(df, ["u"], ["i"], F.col("s")).orderBy("i").collect()] == [0, 0, 1, 1, 2]
    days = spark.createDataFrame([(1, d) for d in (1, 2, 2, 5, 6, 9)], "u int, d int")
    assert rows(ledger.contiguous_ranges(days, "u", "d"), "start", "end") == [(1, 2), (5, 6), (9, 9)]


def test_phrases_longest_first(spark):
    docs = spark.createDataFrame([(1, "The New York City council of New York"), (2, None), (3, "newyork")], "id int, text string")
    names = spark.createDataFrame([("New York",), ("New York City",), ("City council",)], "name string")
    assert rows(entities.phrase_spans(docs, "id", "text", names, "name"), "id", "name", "start", "end") == [(1, "New York", 6, 8), (1, "New York City", 1, 4)]


def test_tolerance_across_buckets(spark):
    t = spark.createDataFrame([(1, 10.0, 0.2), (1, 11.99, 0.2), (2, 10.0, 3.0)], "k int, target double, width double")
    s = spark.createDataFrame([(1, 10.4, 1), (1, 12.1, 2), (2, 12.9, 3), (2, 13.1, 4)], "k int, v double, pos int")
    assert rows(entities.tolerance_join(t, s, "k", "target", "v", "width", "pos"), "k", "target", "pos") == [(1, 10.0, 1), (1, 11.99, 2), (2, 10.0, 3)]


def test_tolerance_join_rounds_as_its_sql(spark, tmp_path):
    """amounts of which a tenth is half a cent go up or down as the SQL says; an order has one row."""
    import duckdb

    from corvane.plans import registry

    prices = [99330.95, 74006.45, 1822.05, 103601.75, 43805.25] + [n / 100 for n in range(100005, 104000, 10)]
    orders = [(i, float(round(p))) for i, p in enumerate(prices)] + [(0, 99340.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, 1, p) for i, p in enumerate(prices)], "l_orderkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = {r[0]: (r[3], r[4]) for r in con.sql(registry.ORACLES["tolerance_join"]).fetchall()}
    got = registry.QUERIES["tolerance_join"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) == len(prices) and {r["o_orderkey"]: (r["l_linenumber"], r["v"]) for r in got} == want


def test_outline_and_packing(spark):
    df = spark.createDataFrame([(1, i, level) for i, level in enumerate([1, 2, 3, 2, 3, 1, 3])], "d int, pos int, level int")
    got = structure.nearest_ancestors(df, "d", "pos", F.col("level"), 3).orderBy("pos").collect()
    assert [r.parent for r in got] == [None, 0, 1, 0, 3, None, 5]
    sizes = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 5, 1, 12, 3, 7])], "d int, pos int, n long")
    assert [r.bin for r in structure.greedy_pack(sizes, "d", "pos", "n", 10).orderBy("pos").collect()] == [0, 0, 1, 2, 3, 3]


def test_text_functions(spark):
    df = spark.createDataFrame([("(1,234.5)", "bytes=5-"), ("$2.5 million", "bytes=-10"), ("12", "bytes=9-3"), (None, None)], "f string, h string")
    got = df.select(T.value_of(F.col("f")).alias("v"), T.halfwidth_of(F.col("f")).alias("w"), T.byte_range(F.col("h"), F.lit(100).cast("long")).alias("r")).collect()
    assert [r.v for r in got] == [-1234.5, 2500000.0, 12.0, None]
    assert [r.w for r in got][:3] == [0.05, 50000.0, 0.5]
    assert [tuple(r.r) if r.r else None for r in got] == [(5, 99), (90, 99), None, None]
    years = spark.createDataFrame([("in 2021, FY19 and 1066 or 2021",)], "t string").select(T.years_in(F.col("t")).alias("y")).first().y
    assert years == [2019, 2021]


def test_containment_groups(spark):
    df = spark.createDataFrame([(1, 1, "A b, c"), (1, 2, "b"), (1, 3, "x"), (1, 4, "x  b"), (1, 7, "bc"), (2, 5, "b"), (2, 6, None), (2, 8, "?!"), (2, 9, "B")], "c int, k int, t string")
    assert rows(entities.containment_groups(df, "c", "k", "t"), "k", "group") == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6), (7, 7), (8, 8), (9, 5)]
    assert entities.containment_groups(df.limit(0), "c", "k", "t").count() == 0


def test_groups_of_a_chain(spark):
    edges = spark.createDataFrame([(c, i + 1, i) for c in (1, 2) for i in range(c, 40)], "c int, a int, b int")
    assert rows(entities.groups_of_edges(edges, ["c"]), "c", "node", "group") == [(c, i, c) for c in (1, 2) for i in range(c, 41)]


def test_fuzzy_classes_equal_brute_force(spark):
    rng = random.Random(3)
    names = [" ".join(rng.choices("alpha beta gamma delta supplier of the north".split(), k=rng.randint(1, 5))) for _ in range(120)] + ["supplier"] * 5 + [None, "??"]
    left, right = (entities.name_classes(spark.createDataFrame([(i, n) for i, n in enumerate(part)], "id int, n string"), "id", "n") for part in (names[:60], names[60:]))
    classes = [{tuple(r.words): r.class_id for r in x.collect()} for x in (left, right)]
    for floor in (0.4, 0.5, 1.0):
        want = sorted((i, j, round(len(set(a) & set(b)) / len(set(a) | set(b)), 6)) for a, i in classes[0].items() for b, j in classes[1].items() if set(a) & set(b) and round(len(set(a) & set(b)) / len(set(a) | set(b)), 6) >= floor)
        assert rows(entities.fuzzy_classes(left, right, floor), "left_class", "right_class", "score") == want


def test_verbatim_equals_contains(spark):
    rng = random.Random(7)
    words = "red Green blue-ish x 12 to a9 it".split()
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(200)]
    items = ["ed Gre", "x", "red Green blue-ish", "blue-ish x 12 t", "12", "reen blue"] + [" ".join(rng.choices(words, k=4)) for _ in range(20)]
    chunks = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "chunk_id int, text string, item string").drop("item")
    got = rows(retrieval.verbatim(chunks, spark.createDataFrame(list(enumerate(items)), "query_id int, item string")), "query_id", "chunk_id")
    assert got == sorted((q, c) for q, x in enumerate(items) for c, t in enumerate(texts) if x in t) and len(got) > 50


def test_vector_search_in_blocks(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(90)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, label int")
    q = v.where("chunk_id % 4 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", "label")
    for same in (None, "label"):
        whole = retrieval.vector_search(v, q, 5, same)
        blocks = retrieval.vector_search(v, q, 5, same, block=5, part=20)
        assert "Broadcast" not in blocks._jdf.queryExecution().executedPlan().toString()
        assert blocks.count() == 23 * 5 and sorted(map(tuple, blocks.collect())) == sorted(map(tuple, whole.collect()))


def test_folded_text_and_its_places():
    text = "The **ﬁrst** “Item” — see [the\tplan](http://x/y) | costs $(1,234) or ($99) \\$5 `code` a_b İx"
    plain, origin = citations.folded(text)
    assert plain == "the first \"item\" - see the plan costs $1,234 or $99 $5 code ab i\u0307x"
    assert len(origin) == len(plain) and (origin[1:] >= origin[:-1]).all()
    for word, there in (("first", "ﬁrst"), ("plan", "plan"), ("1,234", "1,234"), ("code", "code"), ("$5", "$5")):
        at = plain.index(word)
        assert text[origin[at] : origin[at + len(word) - 1] + 1] == there
    assert citations.folded("")[0] == citations.folded("** __")[0].strip() == ""


def test_citations_equal_brute_force(spark):
    """Every span or position is where the folded quote begins when it is looked for at each place of the text."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab *_“”-—|\n$(1)", k=rng.randint(0, 60))) for _ in range(150)] + [None]
    rows = []
    for i, t in enumerate(texts):
        a = rng.randrange(max(len(t or ""), 1))
        rows.append((i, i, rng.choice([(t or "")[a : a + 8], (t or "")[a : a + 5].upper(), "b", None, "**", "zz"])))
    cites = spark.createDataFrame([*rows, (999, 5000, "a")], "id int, doc int, quote string")
    got = {r.id: r for r in citations.validate_citations(cites, spark.createDataFrame(list(enumerate(texts)), "doc int, text string"), "id", "doc", "quote", "text").collect()}
    seen = set()
    for i, _, q in rows:
        t, r = texts[i] or "", got[i]
        places = [k for k in range(len(t)) if q and t.startswith(q, k)]
        want = "verbatim" if len(places) == 1 else "ambiguous" if places else None
        if not places:
            plain, origin = citations.folded(t)
            needle = citations.folded(q or "")[0].strip(citations.OUTER)
            places = [int(origin[k]) for k in range(len(plain)) if needle and plain.startswith(needle, k)]
            want = "absent" if not places else "normalised" if len(places) == 1 else "ambiguous"
        seen.add(want)
        assert (r.verdict, r.positions, r.more) == (want, places[:3], len(places) > 3)
        if want in ("verbatim", "normalised"):
            assert r.start == places[0] and citations.folded(t[r.start : r.end])[0].strip(citations.OUTER) == citations.folded(q)[0].strip(citations.OUTER)
    assert seen == {"verbatim", "normalised", "ambiguous", "absent"} and got[999].verdict == "absent"


def test_citation_query(spark):
    from corvane.plans import registry

    rows_ = registry.QUERIES["citation_validation"](spark, "/root/testdata/sf0.001").collect()
    kinds = {k: [r.verdict for r in rows_ if r.doc_id % 4 == k] for k in range(4)}
    assert len(rows_) == 200 and kinds[0].count("verbatim") > 40 and kinds[1].count("normalised") > 35 and kinds[2].count("ambiguous") > 40 and set(kinds[3]) <= {"absent"}
