"""Phrase collocations, Merkle manifest and WARC archives: plain versions, odd tables, damage."""

import base64
import collections
import gzip
import hashlib
import io
import random
import re
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import merkle, phrases, warc
from corvane.llm.common import saved, shared_folder
from tests.compare import assert_same, duck

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, digest string, n long"


# phrases


def plain_phrases(rows, floor, percent=100, top=2000):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = [x for x in re.split("[ \t]", piece) if x]
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= floor}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, cut = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        out += [(lang, r, p.decode(), -a, x, y, total[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


ODD_TEXTS = [(None, "en"), ("", "en"), (" \t ", None), ("...,;", "en"), ("A a\ta A", "en"), ("a a a a a a a. a a", "und"), ("É é É é, É é", None), ("x\ny z\r\nx y", "en"), ("word " * 5000, "en"), ("a b c d e f g " * 40, "fr")]


def spoken(n, seed):
    rng = random.Random(seed)
    return [("".join(rng.choice(["the cat ", "sat on ", "a ", "mat. ", "Dog, ", "the cat sat on a ", "ß 中 "]) for _ in range(60)), rng.choice(["en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("bits", [4, 27])  # of 4 bits all buckets are full: windows of all lengths
@pytest.mark.parametrize("slice_bytes, most", [(40, 4_000_000), (1 << 21, 4_000_000), (1 << 21, 5)])  # more than 5 words: by their hashes
def test_collocations_equal_a_plain_count(spark, monkeypatch, bits, slice_bytes, most):
    monkeypatch.setattr(phrases, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(phrases, "MOST_WORDS", most)
    if slice_bytes == 1 << 21:  # texts in many rows of numbers, counted a few at a time
        monkeypatch.setattr(phrases, "PIECE_IDS", 7)
        monkeypatch.setattr(phrases, "RUN_IDS", 20)
    rows = ODD_TEXTS + spoken(40, 3) + [("a b c", "en")] * 7
    df = spark.createDataFrame([(i, t, x, None, 0, "r", "d", 1) for i, (t, x) in enumerate(rows)], DOCS).repartition(3)
    for floor, percent in ((5, 100), (3, 60)):
        got = phrases.collocations(*phrases.phrase_counts(df, floor=floor, filter_bits=bits), percent).collect()
        assert sorted(tuple(r) for r in got) == plain_phrases(rows, floor, percent)


def test_top_of_a_lang_is_cut_in_order(spark):
    rows = spoken(30, 9)
    df = spark.createDataFrame([(t, x) for t, x in rows], "text string, lang string")
    got = phrases.collocations(*phrases.phrase_counts(df, floor=3), top=4).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, 3, top=4)


def test_products_beyond_64_bits_are_exact(spark):
    f = 200_000_000_000_000_000
    counts = spark.createDataFrame([("en", [], f), ("en", [5], f - 1), ("en", [6], f - 3), ("en", [5, 6], f - 7)], "lang string, words array<long>, f long")
    row = phrases.collocations(counts, spark.createDataFrame([(5, "a"), (6, "b")], "hash long, word string")).collect()[0]
    assert row["phrase"] == "a b" and row["score"] == 1000 * (f - 7) * f // ((f - 1) * (f - 3))


def test_no_phrases(spark):
    for rows in ([], [(None, None)], [("", "en")]):
        df = spark.createDataFrame(rows, "text string, lang string")
        assert phrases.collocations(*phrases.phrase_counts(df, floor=1)).collect() == []


def test_windows_are_exact_where_hashes_are_alike(spark):
    """The filter may keep too much, never too little, and words are told apart by their letters."""
    rows = spoken(20, 4)
    df = spark.createDataFrame(rows, "text string, lang string")
    wide = phrases.phrase_counts(df, floor=2, filter_bits=3)[0]
    narrow = phrases.phrase_counts(df, floor=2, filter_bits=27)[0]
    assert sorted(map(str, wide.collect())) == sorted(map(str, narrow.collect()))


def test_frequent_words_of_one_hash_are_hashed_anew(spark, monkeypatch):
    right = phrases.span_hashes
    monkeypatch.setattr(phrases, "span_hashes", lambda data, starts, ends, seed=0: np.full(len(starts), 9, np.uint64) if seed == 0 else right(data, starts, ends, seed))
    rows = spoken(5, 6)
    got = phrases.collocations(*phrases.phrase_counts(spark.createDataFrame(rows, "text string, lang string"), floor=3)).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, 3)


# manifest


def plain_manifest(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, a in enumerate(at):
                run = nodes[a // 3 * 3 : a // 3 * 3 + 3]
                ways[k].append((run[: a % 3], run[a % 3 + 1 :]))
                at[k] = a // 3
            nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        return nodes[0], ways

    leaf = lambda r, text: h("".join(map(framed, (r[0], r[3], r[2], r[4], text))))
    by = collections.defaultdict(list)
    for r in rows:
        by[(r[3] is not None, (r[3] or "").encode())].append(r)
    order, subs = sorted(by), []
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        subs.append(tree([leaf(r, r[1]) for r in by[s]]))
    root, tops = tree([x[0] for x in subs])
    out = []
    for s, (subroot, ways), top in zip(order, subs, tops):
        for r, way in zip(by[s], ways):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            d = leaf(r, r[1].replace("\n", "") if changed else r[1])
            for before, after in way + top:
                d = h("".join([*before, d, *after]))
            out.append((r[0], leaf(r, r[1]), subroot, root, h("".join("".join(b + a) for b, a in way + top)), d, d == root))
    return sorted(out, key=str)


def manifest(df):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = merkle.merkle_manifest(df, tampered=F.when(changed, F.translate("text", "\n", "")).otherwise(F.col("text"))).collect()
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("height", [1, 2, 5])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "WIDE", 3**height)
    rows = [(i, f"a\n{i}\n", "en", "hot" if i % 3 else f"s{i % 11}", i) for i in range(90)] + [(3, "é\n", None, None, None), (None, None, None, None, 5), (None, "x\ny", None, "one", 5), (7, "z" * 9000, "", "", -1)] + [(500, "same", "en", "twice", 4)] * 5
    df = spark.createDataFrame([(*r, "r", "d", 1) for r in rows], DOCS).repartition(5)
    assert manifest(df) == plain_manifest(rows)


def test_manifest_of_few_rows(spark):
    assert manifest(spark.createDataFrame([], DOCS)) == []
    for rows in ([(1, None, None, None, None)], [(1, "a\nb", "x", None, 3), (2, "c", "x", "b", 1)], [(i, "t", "x", "s", 1) for i in range(4)]):
        assert manifest(spark.createDataFrame([(*r, "r", "d", 1) for r in rows], DOCS)) == plain_manifest(rows)


def test_a_record_that_isnt_in_the_store_gives_no_proof(spark):
    packs = merkle.pack_up(spark.createDataFrame([("t", 0, 1, "aa")], "tree string, rank long, n long, digest string"), [])
    ask = spark.createDataFrame([("t", 0, 1, "bb", None, "bb", [])], "tree string, pack long, leaves long, digest string, subroot string, root string, way array<string>")
    assert merkle.descend(ask, packs, 0).collect() == []


# archives

ODD_PAGES = [None, "", "<p>\r\n\r\nWARC/1.1\r\n\r\n</p>", "é中" * 3000, "x" * 8192, "0\r\n\r\n", "a", "a", "", "\x00\x01", "<html>" + "y" * 70000]
PAGES = "page_id long, url string, html string, record_type string, payload_bytes string"


def plain_pages(rows, min_bytes=0):
    at_least = [(p, (h or "").encode()) for p, _, h in rows]
    out, holders, used = [], {}, set()
    for p, h in at_least:
        if p is not None:
            holders[h] = max(holders.get(h, p), p)
    for p, h in at_least:
        holder = holders.get(h)
        first = p == holder and (h, p) not in used
        used.add((h, p))
        holds = first or len(h) < min_bytes
        out.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if holds else "revisit", None if holds else holder))
    return sorted(out, key=str)


def archives(spark, rows, **how):
    path = f"{shared_folder(spark)}/warc-test/{uuid.uuid4().hex}"
    warc.write_archives(spark.createDataFrame([(*r, "t", "b") for r in rows], PAGES), path, **how)
    return path


@pytest.mark.parametrize("segment", [37, 8192])
def test_archives_equal_a_plain_count(spark, segment):
    rows = [(i, f"http://h/{i} é\r\n", h) for i, h in enumerate(ODD_PAGES)] + [(20, None, "a"), (20, None, "a"), (21, None, "b"), (None, None, "a"), (None, None, "only null"), (None, None, "only null")]
    for least in (0, 2):
        path = archives(spark, rows, segment_bytes=segment, min_bytes=least)
        records = saved(warc.read_archives(spark, path))
        got = sorted(map(tuple, warc.resolved(records).collect()), key=str)
        assert got == plain_pages(rows, least)
        held = {r["page_id"]: bytes(r["content"]).decode() for r in records.where("record_type = 'response'").collect()}
        assert held[2] == ODD_PAGES[2] and held[3] == ODD_PAGES[3] and held[10] == ODD_PAGES[10]


def test_no_pages(spark):
    assert warc.resolved(saved(warc.read_archives(spark, archives(spark, [])))).collect() == []


def test_archive_is_valid_and_segments_are_verified(spark, tmp_path):
    path = archives(spark, [(1, "u", "z" * 5000), (2, "u", "q" * 300)], segment_bytes=1000)
    whole = b"".join(gzip.decompress(open(f, "rb").read()) for f in map(str, __import__("pathlib").Path(path.removeprefix("file:")).glob("part-*")))
    records = list(warc.parsed(io.BytesIO(whole)))
    origin = [f for f, _ in records if f.get("warc-segment-number") == "1"]
    rest = [f for f, _ in records if f["warc-type"] == "continuation"]
    assert len(origin) == 1 and {f["warc-segment-origin-id"] for f in rest} == {origin[0]["warc-record-id"]}
    total = sum(len(b) for f, b in records if "warc-segment-number" in f)
    assert [f["warc-segment-total-length"] for f in rest if "warc-segment-total-length" in f] == [str(total)]

    def complete(kept):
        d = tmp_path / uuid.uuid4().hex
        d.mkdir()
        (d / "a.warc.gz").write_bytes(gzip.compress(b"".join(warc.record([(k, v) for k, v in f.items() if k != "content-length"], b) + b"\r\n\r\n" for f, b in kept)))
        return {r["page_id"]: r["complete"] for r in warc.read_archives(spark, str(d)).collect()}

    shuffled = records[:]
    random.Random(2).shuffle(shuffled)
    assert complete(shuffled) == {1: True, 2: True}
    gone = [r for r in records if r[0].get("warc-segment-number") != "3"]
    assert complete(gone) == {1: False, 2: True}
    short = [r for r in records if r[0].get("warc-segment-number") != "6"]
    assert complete(short) == {1: False, 2: True}
    wrong = [({**f, "warc-segment-total-length": "7"}, b) if "warc-segment-total-length" in f else (f, b) for f, b in records]
    assert complete(wrong) == {1: False, 2: True}
    broken = [(f, b.replace(b"qq\r\n", b"qqxx")) if f.get("page-id") == "2" else (f, b) for f, b in records]
    assert complete(broken) == {1: True, 2: False}


def test_chunked_framing_in_any_pieces():
    payload = bytes(range(256)) * 50
    message = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n" + warc.chunked(payload[:100], 7) [:-5] + b"A;name=value\r\n" + payload[100:110] + b"\r\n" + warc.chunked(payload[110:], 999)[:-2] + b"Trailer: x\r\n\r\n"
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 100, len(message)):
        cuts = [0, *sorted(rng.integers(0, len(message), len(message) // size).tolist()), len(message)]
        body = warc.HttpBody()
        assert b"".join(body.feed(message[a:b]) for a, b in zip(cuts, cuts[1:])) == payload and body.whole
    plain = warc.HttpBody()
    assert plain.feed(b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc") == b"abc" and plain.whole


@pytest.mark.parametrize("name, sql", [("op11_phrase_collocations", phrases.OP11_SQL), ("op12_merkle_manifest", merkle.OP12_SQL), ("op13_warc_roundtrip", warc.OP13_SQL)])
def test_queries_equal_their_sql(spark, name, sql):
    from corvane.llm import queries

    assert_same(queries.QUERIES[name](spark, SF).toPandas(), duck(SF).sql(sql).df())
