"""Searches whose pairs stay in their tasks: the index, TF-IDF, shares of words, and years of results."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from corvane.operators import evaluation as E
from corvane.operators import retrieval as R
from corvane.plans import evaluation as P


def _texts(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "the", "rare"] + [f"w{i}" for i in range(40)]
    return [(f"{i:03d}", " ".join(rng.choices(words, [9, 7, 5, 3, 30, 1] + [1] * 40, k=rng.randint(0, 25)))) for i in range(n)]


def test_postings_are_counted_without_an_exchange(spark):
    """F27."""
    texts = _texts(60, 1)
    df = R.postings(R.tokenised(spark.createDataFrame(texts, "chunk_id string, text string")))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    want = {(t, c, len(text.split()), n) for c, text in texts for t, n in Counter(text.split()).items()}
    got = [(r["term"], r["chunk_id"], r["dl"], r["tf"]) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want


def test_cosines_of_common_and_rare_terms(spark, monkeypatch):
    """terms beyond those that are broadcast are met by exchange, products in blocks; scores are those of a plain version."""
    texts, asked = _texts(80, 2), [(i, t + " alpha unknown") for i, (_, t) in enumerate(_texts(7, 3))]
    tf = {c: Counter(t.split()) for c, t in texts}
    df = Counter(t for own in tf.values() for t in own)
    idf = {t: math.log((len(texts) + 1) / (n + 1)) + 1 for t, n in df.items()}
    vector = lambda own: {t: (1 + math.log(n)) * idf[t] for t, n in own.items() if t in idf}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = set()
    for q, t in asked:
        a = vector(Counter(t.split()))
        scores = {c: sum(a[t] * b[t] for t in a if t in b) / (size(a) * size(b)) for c, b in ((c, vector(own)) for c, own in tf.items() if own)}
        best = sorted(((-round(s, 6), c) for c, s in scores.items() if s > 0))[:5]
        want |= {(q, c, -s, n) for n, (s, c) in enumerate(best, 1)}
    listed, queries = R.tokenised(spark.createDataFrame(texts, "chunk_id string, text string")), spark.createDataFrame(asked, "query_id long, text string")
    for most in (200_000, 5):
        monkeypatch.setattr(R, "COMMON_BROADCAST", most)
        assert {(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in R.tfidf_cosine(listed, queries, 5).collect()} == want


def test_best_shares_are_the_best_of_all(spark):
    """with ``k`` a query's pairs don't leave their tasks but the best, which are those of all pairs."""
    docs = spark.createDataFrame([(i, t, t[: i % 30]) for i, (_, t) in enumerate(_texts(90, 4))], "id long, hay string, title string")
    words = spark.createDataFrame([(1, ["alpha", "eta", "rare"]), (2, ["the"]), (3, ["nowhere", "w12"]), (4, ["absent"])], "query_id long, qw array<string>")
    every, best = (R.word_shares(docs, "id", {"hay": 0.6, "title": 0.4}, words, least=6, **more) for more in ({}, {"k": 5}))
    top = lambda df: sorted(map(tuple, R.top_k(df, "query_id", "score", "id", 5).collect()))
    assert top(best) == top(every) and len(top(best)) == 20
    assert best.count() < every.count()


def test_chronology_reads_years_from_the_index(spark, monkeypatch):
    """the years of results come from a written table; texts aren't split again for each step."""
    plans = []
    concordance = E.concordance
    monkeypatch.setattr(E, "concordance", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or concordance(df))
    df = P.chronology(spark, "/root/testdata/sf0.001")
    assert df.where(F.col("adjacent").isNotNull()).count() > 0
    assert "split(" not in plans[0] and "Join" not in plans[0]
