"""Rewriting nested ids, and paths of outlines, against plain recursions."""

import json
import random

from pyspark.sql import functions as F

from corvane.operators import rewrite as R
from corvane.operators import structure as S


def some_value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 4 else 3)
    if kind == 0:
        return rng.choice(["a-1", "b:2", "c.3", "A-1", "a-1 and b:2", "", "é"])
    if kind == 1:
        return rng.choice([1, 2.5, True, None])
    if kind in (2, 3):
        return rng.choice(["a-1", "b:2"])
    if kind in (4, 5):
        return [some_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if kind == 6:
        return json.dumps(some_value(rng, depth + 1))
    return {rng.choice(["a-1", "k", "doc_id"]): some_value(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def plain(value, ids):
    if isinstance(value, str):
        if value in ids:
            return ids[value]
        if value.strip().startswith(("{", "[")):
            return json.dumps(plain(json.loads(value), ids), ensure_ascii=False)
        return value
    if isinstance(value, list):
        return [plain(v, ids) for v in value]
    if isinstance(value, dict):
        return {k: plain(v, ids) for k, v in value.items()}
    return value


def flat(value):
    """As it is, with the JSON in strings read."""
    if isinstance(value, str) and value.strip().startswith(("{", "[")):
        return flat(json.loads(value))
    if isinstance(value, list):
        return [flat(v) for v in value]
    if isinstance(value, dict):
        return {k: flat(v) for k, v in value.items()}
    return value


def test_ids_of_any_depth(spark):
    rng = random.Random(4)
    ids = {"a-1": "new/1", "b:2": "a-1"}  # a new id that is another's old one isn't rewritten again
    values = [some_value(rng) for _ in range(200)] + [{"a-1": {"a-1": ["a-1", '{"x": "[\\"b:2\\"]"}']}}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, "not json a-1"), (901, None), (902, '{"open": "a-1"')]
    df = R.rewrite_ids(spark.createDataFrame(rows, "k long, p string"), ["k"], "p", spark.createDataFrame(list(ids.items()), "old string, new string"))
    got = {r["k"]: r for r in df.select("k", F.to_json("payload").alias("p"), "rewrites", "damaged").collect()}
    for i, v in enumerate(values):
        assert flat(json.loads(got[i]["p"])) == flat(plain(v, ids))
        count = sum(json.dumps(flat(v), ensure_ascii=False).count(f'"{x}"') for x in ids) - sum(json.dumps(flat(v)).count(f'"{x}":') for x in ids)
        assert got[i]["rewrites"] == count and not got[i]["damaged"]
    assert [(got[k]["p"], got[k]["rewrites"], got[k]["damaged"]) for k in (900, 901, 902)] == [(None, 0, True), (None, 0, False), (None, 0, True)]
    assert got[200]["rewrites"] == 2


def test_paths_by_pointer_jumping(spark):
    rng = random.Random(8)
    nodes = [(d, i, rng.choice([None, *range(i)]) if i else None) for d in range(4) for i in range(30)] + [(9, i, i - 1 if i else None) for i in range(40)]
    up = {(d, i): p for d, i, p in nodes}

    def path(d, i):
        return [i] if up[d, i] is None else [*path(d, up[d, i]), i]

    df = spark.createDataFrame(nodes, "d long, i long, p long")
    paths = S.outline_paths(df, "d", "i", "p")
    got = {(r["d"], r["i"]): list(r["path"]) for r in paths.collect()}
    assert got == {k: path(*k) for k in up}
    hits = [(q, d, i) for q in "ab" for d, i, _ in rng.sample(nodes, 25)]
    best = {}
    for q, d, i in hits:
        best[q, d] = min(best.get((q, d), (0, 0, [])), (-len(path(d, i)), i, path(d, i)))
    found = S.deepest_matches(paths, spark.createDataFrame(hits, "q string, d long, i long"), "d", "i", "q").collect()
    assert {(r["q"], r["d"]): list(r["path"]) for r in found} == {k: v[2] for k, v in best.items()}
    assert S.outline_paths(df.limit(0), "d", "i", "p").count() == 0
