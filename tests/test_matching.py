"""Names in text and names against names, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.operators import entities as E
from corvane.operators import matching as M


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def plain_spans(text, phrases):
    w, taken, out = words(text), set(), []
    hits = [(tier, -len(p), i, p) for tier, p in phrases for i in range(len(w)) if words(p) and w[i : i + len(words(p))] == words(p)]
    for tier, _, i, p in sorted(set(hits)):
        span = set(range(i, i + len(words(p))))
        if not span & taken:
            taken |= span
            out.append((tier, p, i, i + len(span)))
    return sorted(out)


def test_tiers_hide_what_they_claim(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["state", "board", "of", "health", "doc", "Board", "é"], k=rng.randint(0, 25)))) for i in range(60)] + [(60, None), (61, ""), (62, "state board of health")]
    phrases = [(1, "board of health"), (1, "health"), (2, "state board"), (2, "of health"), (2, "doc"), (3, "state"), (3, "é"), (3, "health"), (3, " ")]
    got = M.claimed_spans(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", "text", spark.createDataFrame(phrases, "tier int, phrase string")).collect()
    want = [(i, *s) for i, t in rows for s in plain_spans(t or "", phrases)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r[1] for r in want} == {1, 2, 3}
    assert M.claimed_spans(spark.createDataFrame(rows, "id long, text string"), "id", "text", spark.createDataFrame([], "tier int, phrase string")).count() == 0


def test_meanings_and_confidence(spark):
    catalog = spark.createDataFrame([(1, "Corrections, State Department of"), (2, "Juvenile Corrections, Department of"), (3, "Child Safety, Department of"), (4, "Department of Child Safety"), (5, "Education, Board of"), (6, "Education, Office of"), (7, "Board of")], "id long, name string")
    aliases = spark.createDataFrame([("doc", 1), ("dcs", 3), ("ed", 5), ("shared", 1), ("shared", 2), ("twin", 3), ("twin", 6), ("out", 2)], "alias string, id long")
    overlay = spark.createDataFrame([("kids", 4), ("gone", 1)], "alias string, id long")
    off = spark.createDataFrame([("gone",), ("child safety",)], "alias string")
    meanings = M.phrase_meanings(catalog, aliases, overlay, ["doc"], ["twin"], ["out"], off)

    def parse(text):
        rows = M.parse_names(spark.createDataFrame([(0, text)], "k long, t string"), "k", "t", meanings, weak_ids=[2]).collect()
        return {r["id"]: (r["tier"], r["confidence"]) for r in rows}

    assert parse("state department of corrections") == {1: (1, "EXACT")}
    assert parse("corrections budget") == {1: (1, "EXACT")}
    assert parse("juvenile corrections") == {2: (1, "WEAK")}  # the longer name hides the shorter; 2 is never sure
    assert parse("child safety") == {3: (1, "EXACT"), 4: (1, "EXACT")}  # one body recorded twice; names can't be switched off
    assert parse("education") == {5: (1, "WEAK"), 6: (1, "WEAK")}  # two bodies
    assert parse("DOC baseline") == {1: (2, "WEAK")}
    assert parse("dcs ar") == {3: (2, "EXACT"), 4: (2, "EXACT")}
    assert parse("ed") == {5: (2, "WEAK")}
    assert parse("shared") == {1: (2, "WEAK"), 2: (2, "WEAK")}
    assert parse("twin") == {3: (2, "EXACT"), 4: (2, "EXACT"), 6: (2, "EXACT")}
    assert parse("kids") == {3: (3, "WEAK"), 4: (3, "WEAK")}
    assert parse("gone out board of") == {}


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b, 1):
            row[j] = prev[j - 1] + 1 if x == y else max(prev[j], row[j - 1])
    return row[-1]


def some_names(seed, n):
    rng = random.Random(seed)
    base = ["board of barbers", "department of corrections", "emergency and military affairs", "health services", "osteopathic examiners in medicine", "a", "arizona", "state lottery lottery"]
    out = [None, "", "board", "of board barbers"]
    for _ in range(n):
        w = rng.choice(base).split()
        rng.shuffle(w)
        w = [x if rng.random() < 0.6 else x[: rng.randint(0, len(x))] + rng.choice("aeiouxy") + x[rng.randint(0, len(x)) :] for x in w]
        out.append(" ".join(w + rng.choices(["", "the", "arizona"], k=1)).strip())
    return out


def test_common_letters():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcé ", k=rng.randint(0, 90))) for _ in range(2))
        assert M.common_letters(a, b) == plain_lcs(a, b)


@pytest.mark.parametrize("kind", ["sort", "set"])
@pytest.mark.parametrize("floor", [85, 72])
def test_ratio_pairs_lose_none(spark, kind, floor):
    left, right = some_names(1, 150), some_names(2, 120)
    frame = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    got = {(r["left"], r["right"]): round(r["score"], 6) for r in M.ratio_pairs(frame(left), frame(right), kind, floor).collect()}
    want = {}
    for a in {x for x in left if x}:
        for b in {x for x in right if x}:
            score = M.SCORERS[kind](words(a), words(b))
            if score >= floor - 1e-9:
                want[a, b] = round(score, 6)
    assert got == want and len(want) > 200


@pytest.mark.parametrize("kind", ["sort", "set"])
@pytest.mark.parametrize("ordered", [False, True])
def test_ratio_pairs_of_blocks_lose_none(spark, monkeypatch, kind, ordered):
    monkeypatch.setattr(M, "CATALOG", 0)
    monkeypatch.setattr(M, "RATIO_BLOCK", 40)
    monkeypatch.setattr(M, "TILE", 16)
    names = spark.createDataFrame([(n,) for n in some_names(3, 130)], "name string")
    df = M.ratio_pairs(names, names, kind, ordered=ordered)
    assert "SortMergeJoin" not in df._jdf.queryExecution().toString()  # pairs that share a key aren't listed, only those of the floor leave a task
    got = [(r["left"], r["right"], round(r["score"], 6)) for r in df.collect()]
    own = {x for x in some_names(3, 130) if x}
    scores = [(a, b, round(M.SCORERS[kind](words(a), words(b)), 6)) for a in own for b in own if a < b or not ordered]
    assert sorted(got) == sorted(x for x in scores if x[2] >= 85 - 1e-9) and len(got) > 100


@pytest.mark.parametrize("kind", ["sort", "set"])
def test_ratios_of_many_pairs_at_once(monkeypatch, kind):
    """F2 of round 4: pairs are scored together, not one by one, and each as by itself; names of many letters or words go alone."""
    known = [" ".join(words(n)) for n in some_names(5, 90) if n] + ["a", "the the the", "b c b", "éé ü", "x" * 64, "x" * 63 + " y"]
    odd = ["x" * 63 + " yz", "a b c d e f g h i j k", "board of barbers " + "z" * 70]
    names = [" ".join(dict.fromkeys(n.split(" "))) if kind == "set" else n for n in known + odd]
    alone, plain = [], M.SCORERS[kind]
    monkeypatch.setitem(M.SCORERS, kind, lambda a, b: alone.append((a, b)) or plain(a, b))
    monkeypatch.setattr(M, "AT_ONCE", 1000)
    got = {(i, j): s for hits in M._ratio_hits(names, names, kind, 85) for i, j, s in zip(*hits)}
    scores = {(i, j): plain(a.split(" "), b.split(" ")) for i, a in enumerate(names) for j, b in enumerate(names)}
    assert got == {k: s for k, s in scores.items() if s >= 85 - 1e-9} and len(got) > 300
    few = {x for x in names if len(x) <= 64 and len(x.split(" ")) <= 8}
    assert len(few) > 60 and alone and not any(" ".join(a) in few and " ".join(b) in few for a, b in alone)


def test_title_is_the_first_line_with_words(spark, tmp_path):
    from corvane.plans.matching import _titles

    texts = ["--\n\n ?! Éa b\r c d e f g\nnext", "one", "...", "", None, "\n\r\n-\u2028x y", "x" * 101]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["name"] for r in _titles(spark, str(tmp_path)).collect()} == {0: "éa b c d e", 1: "one", 5: "x y"}


def test_windows_are_not_written(spark, monkeypatch):
    written, save = [], M.saved
    monkeypatch.setattr(M, "saved", lambda df: written.append(df.count()) or save(df))
    texts = spark.createDataFrame([(0, "how did emergancy and military afairs spend " * 40)], "k long, t string")
    got = M.fuzzy_windows(texts, "k", "t", spark.createDataFrame([("Emergency and Military Affairs", 1)], "name string, id long")).collect()
    assert [r["id"] for r in got] == [1] and max(written) == 1


def test_known_ratios():
    assert M.token_set_ratio(["arizona"], "osteopathic examiners arizona".split()) == 100
    assert M.token_sort_ratio("board of barbers".split(), "barbers board of".split()) == 100
    assert M.token_sort_ratio(["arizona"], "osteopathic board arizona".split()) == 200 * 7 / 32
    assert M.token_set_ratio([], ["a"]) == 0


def test_fuzzy_windows_equal_a_plain_search(spark):
    names = [("Emergency and Military Affairs", 1), ("Barbers, Board of", 2), ("Health Services", 3), ("Health  services!", 9), ("Corrections", 4)]
    texts = ["how did emergancy and military afairs spend", "barber board of 2024", "the board of", "helth services and corrections", "nothing here", "", None, "services health corrections services health", "x"]

    def plain(text):
        w = [x for x in words(text or "") if len(x) > 1]
        known = {}
        for n, i in names:
            known.setdefault(" ".join(words(n)), i)
        for size in range(min(6, len(w)), 1, -1):
            for i in range(len(w) - size + 1):
                window = w[i : i + size]
                text = " ".join(window)
                if len(text) < 5 or all(x in M.ORGANISATION_WORDS + M.FUNCTION_WORDS for x in window):
                    continue
                best = sorted((-M.token_set_ratio(window, n.split()), n) for n in known)
                for s, n in [x for x in best if -x[0] >= 85][:5]:
                    if size >= 0.5 * len(n.split()):
                        return text, n, known[n], round(-s, 6)
        return None

    got = M.fuzzy_windows(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", spark.createDataFrame(names, "name string, id long")).collect()
    want = {i: plain(t) for i, t in enumerate(texts) if plain(t)}
    assert {r["k"]: (r["window"], r["name"], r["id"], round(r["score"], 6)) for r in got} == want and len(want) >= 4


def test_near_words_of_many_letters_meet_by_pieces(spark):
    """long words are cut in three, not listed less some letters (2,000 letters would be two million words)."""
    rng = random.Random(6)
    left = {"".join(rng.choices("abc ", k=rng.randint(13, 24))) for _ in range(60)} | {"xyz" * 667}
    right, want = {"xyz" * 300 + "w" + "xyz" * 367}, {("xyz" * 667, "xyz" * 300 + "w" + "xyz" * 367): 1}
    for w in sorted(x for x in left if len(x) < 99):
        for edits in range(4):
            v = list(w)
            for _ in range(edits):
                at = rng.randrange(len(v))
                v[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "d"])
            right.add("".join(v))
    frame = lambda x: spark.createDataFrame([(w,) for w in sorted(x)], "word string")
    pairs = frame(left).withColumnRenamed("word", "left").crossJoin(frame({x for x in right if len(x) < 99}).withColumnRenamed("word", "right"))
    want |= {(r["left"], r["right"]): r["d"] for r in pairs.withColumn("d", F.levenshtein("left", "right")).where("d <= 2").collect()}
    assert {(r["left"], r["right"]): r["distance"] for r in M.near_words(frame(left), frame(right)).collect()} == want and len(want) > 120


def test_claimed_spans_are_dealt_by_letters(spark, monkeypatch):
    """what a task sorts is bounded by the letters of its texts, however many there are."""
    monkeypatch.setattr(M, "SPAN_LETTERS", 400)
    rows = spark.createDataFrame([(i, "a b c d b c") for i in range(1000)], "k int, t string")
    phrases = spark.createDataFrame([(1, "b c"), (2, "c d"), (2, "d b")], "tier int, phrase string")
    spans = M.claimed_spans(rows, "k", "t", phrases)
    assert spans.rdd.getNumPartitions() >= 27
    assert sorted(map(tuple, spans.collect())) == sorted((i, 1, "b c", s, s + 2) for i in range(1000) for s in (1, 4))


def test_near_words_equal_all_pairs(spark):
    rng = random.Random(3)
    pool = {"".join(rng.choices("abc", k=rng.randint(0, 11))) for _ in range(250)} | {"Customer#000000001", "Customer#000000012", "small ring", "smal ring", "é" * 8, "é" * 9}
    left, right = sorted(pool)[::2], sorted(pool)[1::2] + ["abcab"]
    frame = lambda x: spark.createDataFrame([(w,) for w in [*x, None]], "word string")
    df = M.near_words(frame(left), frame(right))
    assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
    got = {(r["left"], r["right"]): r["distance"] for r in df.collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
        return row[-1]

    want = {}
    for a in left:
        for b in right:
            n, d = max(len(a), len(b)), edits(a, b)
            if d <= (2 if n >= 8 else 1 if n >= 5 else 0):
                want[a, b] = d
    assert got == want and set(want.values()) == {1, 2} | ({0} if set(left) & set(right) else set())


def test_every_rung_of_the_ladder_decides(spark):
    slugs = spark.createDataFrame([("axs", 1), ("judsup", 2), ("jud", 3), ("cf", 4), ("app", 5)], "slug string, id long")
    names = spark.createDataFrame([("Corrections, Department of", 10), ("Barbers, Board of", 11), ("Health Services", 12), ("Barbers East", 13), ("Barbers West", 14)], "name string, id long")
    rows = [
        ("exact", "axs", ["Health Services"]), ("prefix", "axsacute", []), ("longest", "judsuperior", []), ("refused", "appropveto", ["nobody"]), ("short", "cfx", []),
        ("name", None, ["intro", "HEALTH   services"]), ("turned", "zzz", ["Department of Corrections"]), ("comma", None, ["Services, Health"]), ("fuzzy", None, ["Departmant of Corections"]),
        ("tie", None, ["Barbers xest"]), ("later", None, ["Barbers xest", "Board ov Barbers"]), ("none", None, None),
    ]
    got = {r["k"]: (r["rung"], r["id"]) for r in M.stamped(spark.createDataFrame(rows, "k string, slug string, lines array<string>"), "k", slugs, names, refused=["appropveto"]).collect()}
    assert got == {"exact": (1, 1), "prefix": (2, 1), "longest": (2, 2), "name": (3, 12), "turned": (4, 10), "comma": (4, 12), "fuzzy": (5, 10), "later": (5, 11)}


def test_the_ladder_gathers_no_rows_of_pages(spark, monkeypatch):
    plans, save = [], M.saved
    monkeypatch.setattr(M, "saved", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(df))
    slugs, names = spark.createDataFrame([("axs", 1)], "slug string, id long"), spark.createDataFrame([("Health Services", 12)], "name string, id long")
    rows = spark.createDataFrame([(i, "axs" if i % 2 else None, ["Helth Services", f"line {i}"]) for i in range(50)], "k long, slug string, lines array<string>")
    df = M.stamped(rows, "k", slugs, names)
    lefts = [line for p in plans for line in p.splitlines() if "LeftAnti" in line]
    assert lefts and not any("Broadcast" in line for line in lefts)
    assert {(r["rung"], r["id"]) for r in df.collect()} == {(1, 1), (5, 12)}


def test_unique_winners(spark):
    pairs = spark.createDataFrame([("a", "x", 1, 90.0), ("a", "y", 2, 90.0), ("b", "x", 1, 91.0), ("b", "y", 2, 90.0), ("c", "x", 1, 90.0), ("c", "z", 1, 90.0)], "left string, right string, id long, score double")
    assert {(r["left"], r["id"]) for r in M.unique_winners(pairs).collect()} == {("b", 1), ("c", 1)}


def test_longest_prefix(spark):
    slugs = spark.createDataFrame([("abcd",), ("ab",), ("",), (None,), ("abx",)], "slug string")
    catalog = spark.createDataFrame([("abc", 1), ("abcd", 2), ("ab", 3)], "slug string, id long")
    assert sorted(map(tuple, M.prefix_hits(slugs, catalog).collect())) == [("abcd", 2, "abcd")]
    assert sorted(map(tuple, M.prefix_hits(slugs, catalog.where(F.col("id") != 2), 2).collect())) == [("ab", 3, "ab"), ("abcd", 1, "abc"), ("abx", 3, "ab")]


def test_every_rung_of_the_match_ladder_decides(spark):
    catalog = spark.createDataFrame([(1, "Board of Barbers"), (2, "Corrections"), (3, "Emergency and Military Affairs"), (4, "Lottery"), (9, "board OF barbers!")], "id long, name string")
    rows = [("equal", "BOARD of barbers"), ("shared", "barbers of the board"), ("held", "all that the corrections people of the state have said so far"), ("near", "Lotery"), ("none", "water"), ("null", None), ("empty", "--"), ("best", "military affairs and corrections")]
    got = {r["k"]: (r["rung"], r["id"]) for r in E.match_ladder(spark.createDataFrame(rows, "k string, name string"), "k", catalog).collect()}
    assert got == {"equal": (1, 1), "shared": (2, 1), "held": (3, 2), "near": (4, 4), "best": (2, 3)}
