"""Names in text and names against names: tiers of phrases that claim spans, edit ratios, bounded edit distance, ladders of rules.

Pairs are found by equi-joins on keys that no wanted pair can miss (rare words, words less some letters) and verified after. Ratios of edits have no rare keys:
names meet in blocks, as products of matrices of their letter pairs, and what no product rules out is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.shared import dealt, saved, small

WORD = "[\\p{L}\\p{N}]+"
FLOOR = 85
WIDEST, NARROWEST = 6, 2
CANDIDATES = 5
COVERAGE = 0.5
SPAN_LETTERS = 1 << 22  # of the texts whose claims one task settles
PIECED = 16  # letters of a word up to which it is listed less some letters
# Ratios: names of a right side that is sent to all tasks, names of a block, rows of a tile and of a profile, and slots that pairs of letters are counted in.
CATALOG = 2_000
RATIO_BLOCK = 16_384
TILE = 1_024
PROFILED = 8_192
PAIR_SLOTS = 512
# Ratios of many pairs at once: letters, words and different letters of a name that is compared in words of bits, and pairs.
BITS = 64
FEW_WORDS = 8
LETTERS = 255
AT_ONCE = 1 << 15

# Words that say nothing of which body is meant.
ORGANISATION_WORDS = ["board", "boards", "commission", "commissions", "department", "departments", "office", "offices", "council", "councils", "authority", "authorities", "agency", "agencies", "division", "divisions", "bureau", "bureaus", "committee", "committees"]
FUNCTION_WORDS = ["of", "the", "and", "for", "in", "on", "to", "a", "an"]
GROUP_STOP_WORDS = ["of", "the", "for", "and", "a"]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def claimed_spans(rows: DataFrame, key: str, text: str, phrases: DataFrame, words=words_of, by_letters: bool = True) -> DataFrame:
    """``key, tier, phrase, start, end``: occurrences of the phrases (``tier, phrase``) in the texts, word by word, without overlaps.

    Lower tiers go first, in a tier longer phrases (by letters, or else by words), then earlier places; what a phrase has claimed is hidden from all after it. A position carries
    as many words as the longest phrase has, not its text. Phrases meet the texts through their first word.
    A task gets the hits of ``SPAN_LETTERS`` letters of texts, so what it sorts doesn't grow with the tables.
    """
    catalog = saved(phrases.select("tier", "phrase", words(F.col("phrase")).alias("_n")).where(F.size("_n") > 0).distinct().withColumn("_first", F.get("_n", F.lit(0))))
    longest = catalog.agg(F.max(F.size("_n"))).first()[0] or 1
    listed = rows.select(F.col(key).alias("key"), words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    placed = listed.select("key", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_w")), lambda i: F.slice("_w", i, longest))).alias("start", "_own"))
    hits = placed.withColumn("_first", F.get("_own", F.lit(0))).join(small(catalog), "_first").where(F.slice("_own", 1, F.size("_n")) == F.col("_n"))
    hits = hits.select("key", "tier", "phrase", "start", (F.col("start") + F.size("_n")).alias("end"), (F.length("phrase") if by_letters else F.size("_n")).alias("_long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = object(), set()  # the words of one text that are claimed
        for batch in batches:
            keep = []
            for k, a, b in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "end"))):
                if k != now:
                    now, taken = k, set()
                free = taken.isdisjoint(range(a, b))
                if free:
                    taken.update(range(a, b))
                keep.append(free)
            yield batch.filter(pa.array(keep, pa.bool_()))

    kind = rows.schema[key].dataType.simpleString()
    order = ["key", "tier", F.desc("_long"), "start", "phrase"]
    letters = rows.agg(F.sum(F.length(text))).first()[0] or 0
    tasks = max(-(-int(letters) // SPAN_LETTERS), rows.sparkSession.sparkContext.defaultParallelism)
    spans = hits.repartition(tasks, "key").sortWithinPartitions(*order).mapInArrow(run, f"key {kind}, tier int, phrase string, start int, end int, _long int")
    return spans.select(F.col("key").alias(key), "tier", "phrase", "start", "end")


def usable(phrase: Column) -> Column:
    """Five letters or more, and a word that isn't of every body."""
    return (F.length(phrase) >= 5) & F.exists(F.split(phrase, " "), lambda w: ~w.isin(ORGANISATION_WORDS + FUNCTION_WORDS))


def name_phrases(catalog: DataFrame) -> DataFrame:
    """``id, phrase``: the names (``id, name``) as they stand, turned round at the comma, and up to the first comma; normalised, usable ones."""
    head, tail = F.btrim(F.substring_index("name", ",", 1)), F.btrim(F.regexp_extract("name", "^[^,]*,(.*)$", 1))
    turned = F.when(tail != "", F.concat_ws(" ", tail, head))
    forms = F.explode(F.array("name", turned, head))
    return catalog.select("id", forms.alias("form")).select("id", F.array_join(words_of(F.col("form")), " ").alias("phrase")).where(usable(F.col("phrase"))).distinct()


def name_groups(catalog: DataFrame) -> DataFrame:
    """``id, group``: entries whose names have the same words, in any order, are one body recorded twice."""
    w = F.array_sort(F.filter(words_of(F.col("name")), lambda x: ~x.isin(GROUP_STOP_WORDS)))
    return catalog.select("id", F.array_join(w, " ").alias("group")).distinct()


def phrase_meanings(catalog: DataFrame, aliases: DataFrame, overlay: DataFrame, ambiguous: list[str], curated: list[str], suppressed: list[str], off: DataFrame) -> DataFrame:
    """``tier, phrase, id, exact``: what the phrases of each tier stand for.

    Tier 1 are names, 2 aliases (``alias, id``), 3 an overlay of the same form. A name or alias is exact if all its ids are one body (or it is curated) and it isn't
    ambiguous beyond the catalog; aliases need three letters for it. What is exact, and the overlay, stands for all ids of the body. ``off``
    (``alias``) switches aliases and overlay off, never names.
    """
    phrase = F.array_join(words_of(F.col("alias")), " ").alias("phrase")
    named = name_phrases(catalog).select(F.lit(1).alias("tier"), "phrase", "id")
    off = off.select(phrase).distinct()
    other = aliases.select(F.lit(2).alias("tier"), phrase, "id").where(~F.col("phrase").isin(suppressed)).unionByName(overlay.select(F.lit(3).alias("tier"), phrase, "id"))
    base = saved(named.unionByName(other.where(F.col("phrase") != "").join(off, "phrase", "left_anti")).distinct())
    groups = saved(name_groups(catalog))
    counted = base.join(groups, "id").groupBy("tier", "phrase").agg(F.countDistinct("group").alias("_n"))
    sure = (F.col("_n") == 1) & ~F.col("phrase").isin(ambiguous) & ((F.col("tier") == 1) | (F.length("phrase") >= 3))
    told = counted.select("tier", "phrase", ((F.col("tier") < 3) & (sure | F.col("phrase").isin(curated))).alias("exact"))
    meant = base.join(told, ["tier", "phrase"])
    wide = meant.where(F.col("exact") | (F.col("tier") == 3)).join(groups, "id").drop("id").join(groups, "group").drop("group")
    return wide.unionByName(meant.where(~F.col("exact") & (F.col("tier") < 3)), allowMissingColumns=True).select("tier", "phrase", "id", "exact").distinct()


def parse_names(rows: DataFrame, key: str, text: str, meanings: DataFrame, weak_ids: list | None = None) -> DataFrame:
    """``key, id, tier, phrase, start, confidence``: the bodies that each text names, each once, as its first tier and place say."""
    meanings = saved(meanings)
    spans = claimed_spans(rows, key, text, meanings.select("tier", "phrase"))
    found = spans.join(small(meanings), ["tier", "phrase"]).groupBy(key, "id").agg(F.min(F.struct("tier", "start", "phrase", "exact")).alias("_m"))
    exact = F.col("_m.exact") & (F.lit(True) if not weak_ids else ~F.col("id").isin(weak_ids))
    return found.select(key, "id", "_m.tier", "_m.phrase", "_m.start", F.when(exact, "EXACT").otherwise("WEAK").alias("confidence"))


# edit ratios


def common_letters(a: str, b: str) -> int:
    """The length of the longest common subsequence, in words of bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def edit_ratio(a: str, b: str) -> float:
    """100 for equal strings, 0 for such without a common letter: twice the common subsequence over both lengths."""
    return 200.0 * common_letters(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: list[str], b: list[str]) -> float:
    return edit_ratio(" ".join(sorted(a)), " ".join(sorted(b)))


def token_set_ratio(a: list[str], b: list[str]) -> float:
    """The best ratio among the common words and the common words with either side's rest; 100 if one side holds the other."""
    one, two = set(a), set(b)
    if not one or not two:
        return 0.0
    both, left, right = (" ".join(sorted(x)) for x in (one & two, one - two, two - one))
    if both and (not left or not right):
        return 100.0
    x, y = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = edit_ratio(x, y)
    if both:
        best = max(best, *(200.0 * len(both) / (len(both) + len(z)) for z in (x, y)))
    return best


SCORERS = {"sort": token_sort_ratio, "set": token_set_ratio}


def _profiles(names: list[str]):
    """A row for each name (words joined by blanks): its pairs of letters, a blank on either side of each word, numbered where they come again, counted in ``PAIR_SLOTS`` slots; and its length.

    The product of two rows is at least the number of pairs that both names have.
    """
    import numpy as np

    size = np.array([len(n) for n in names], np.int64)
    letters = np.frombuffer("".join(f" {n} " for n in names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(names)), size + 2)
    pair = (letters[:-1] << 21 | letters[1:])[owner[:-1] == owner[1:]]
    row = np.repeat(np.arange(len(names)), size + 1)
    order = np.lexsort((pair, row))
    pair, row = pair[order], row[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    again = np.arange(len(pair)) - np.repeat(first, np.diff(np.append(first, len(pair))))
    slot = ((pair * 64 + np.minimum(again, 63)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % PAIR_SLOTS
    out = np.bincount(row * PAIR_SLOTS + slot, minlength=len(names) * PAIR_SLOTS).astype(np.float32).reshape(len(names), PAIR_SLOTS)
    return out, size


def _alike(left, right, kind: str, floor: int) -> Iterator[tuple]:
    """Places (two arrays at a time) of two lists' profiles of which the ratio may reach the floor; no other pair does.

    Strings of n and m letters of a ratio r differ by at most (1 - r)(n + m) letters in or out, each of which costs at most two pairs of letters, so they share at least
    (n + m) / 2 + 1 - 1.5 (1 - r)(n + m) pairs (floor: 70 or more), and lengths are near. A token set ratio may also come from words in common, of r / (2 - r) of a side's letters: these share
    all their pairs. Rows go by length, so that one number bounds nearly all of a tile.
    """
    import numpy as np

    share = floor / 100

    def needed(n, m):
        total, least = n + m, np.minimum(n, m)
        need = np.where(2 * least >= (share - 1e-9) * total, (0.5 - 1.5 * (1 - share)) * total + 1, np.inf)
        return np.minimum(need, share / (2 - share) * least + 1) if kind == "set" else need

    by_left, by_right = (np.argsort(side[1], kind="stable") for side in (left, right))
    columns, sizes = right[0][by_right], right[1][by_right]
    for at in range(0, len(by_left), TILE):
        own = by_left[at : at + TILE]
        rows, n = left[0][own], left[1][own]
        for begin in range(0, len(by_right), TILE):
            m = sizes[begin : begin + TILE]
            least = needed(np.unique(n)[:, None], np.unique(m)).min()
            if least == np.inf:
                continue
            shared = (rows @ columns[begin : begin + TILE].T).ravel()
            near = np.flatnonzero(shared >= np.float32(least - 1e-3))
            i, j = near // len(m), near % len(m)
            near = shared[near] >= needed(n[i], m[j]) - 1e-3
            yield own[i[near]], by_right[begin + j[near]]


def _ratios(left: list[str], right: list[str], kind: str, floor: int):
    """A function of places in two lists of names (words joined by blanks; two arrays) that gives the ratios of these pairs, as ``SCORERS`` do; what is under the floor may be told lower.

    Common subsequences of many pairs are found at once, each in a word of ``BITS`` bits. Words that both names have are left out of it: the strings of a token set ratio
    begin with them. Names of more letters or more than ``FEW_WORDS`` words, or with letters beyond the ``LETTERS`` commonest, go one by one.
    """
    import numpy as np

    tokens = [[n.split(" ") for n in side] for side in (left, right)]
    listed = [[sorted(w if kind == "sort" else set(w)) for w in side] for side in tokens]
    joined = [[" ".join(w) for w in side] for side in listed]
    size = [np.array([len(n) for n in side], np.int64) for side in joined]
    flat = [np.frombuffer("".join(side).encode("utf-32-le", "surrogatepass"), np.uint32) for side in joined]
    known, often = np.unique(np.concatenate(flat), return_counts=True)
    code_of = np.full(len(known), -1, np.int64)
    common = np.argsort(-often, kind="stable")[:LETTERS]
    code_of[common] = np.arange(1, len(common) + 1)
    n_codes = len(common) + 1
    odd, grid = [], []
    for n, letters in zip(size, flat):
        owner = np.repeat(np.arange(len(n)), n)
        code, place = code_of[np.searchsorted(known, letters)], np.arange(len(letters)) - np.repeat(np.cumsum(n) - n, n)
        other = n > BITS
        other[owner[code < 0]] = True
        usual = ~other[owner]
        odd.append(other)
        grid.append((owner[usual], place[usual], code[usual]))
    row, place, code = grid[0]
    table = np.zeros(len(left) * n_codes, np.uint64)  # for each name and letter the places that have it
    np.add.at(table, row * n_codes + code, np.uint64(1) << place.astype(np.uint64))
    row, place, code = grid[1]
    spelt = np.zeros((len(right), BITS), np.uint8)
    spelt[row, place] = code
    if kind == "set":
        number: dict[str, int] = {}
        names, spans, gaps, lengths = [], [], [], []
        most = min(max((len(w) for side in listed for w in side), default=1), FEW_WORDS)
        for k, side in enumerate(listed):
            name = np.full((len(side), most), -1 - k, np.int32)
            span, gap = (np.zeros((len(side), most), np.uint64) for _ in range(2))
            length = np.zeros((len(side), most), np.int32)
            for i, words in enumerate(side):
                if len(words) > FEW_WORDS:
                    odd[k][i] = True
                elif not odd[k][i]:
                    at = 0
                    for w, word in enumerate(words):
                        name[i, w], length[i, w] = number.setdefault(word, len(number)), len(word)
                        span[i, w], gap[i, w] = ((1 << len(word)) - 1) << at, 1 << at - 1 if at else 0
                        at += len(word) + 1
            names.append(name), spans.append(span), gaps.append(gap), lengths.append(length)

    def subsequence(i, j, kept_i=None, kept_j=None):
        spelling, offset = np.ascontiguousarray(spelt[j].T), i * n_codes
        rows = np.full(len(i), ~np.uint64(0))
        for p in range(int(size[1][j].max(initial=0))):
            mask = table[offset + spelling[p]]
            if kept_i is not None:
                mask &= kept_i
                mask *= kept_j >> np.uint64(p) & np.uint64(1)
            mask &= rows
            rows = (rows + mask) | (rows - mask)
        n = size[0][i].astype(np.uint64)
        rows |= np.where(n < BITS, ~np.uint64(0) << np.minimum(n, np.uint64(BITS - 1)), np.uint64(0))
        return BITS - np.bitwise_count(rows).astype(np.int64)

    def rest(k, i, shared):
        """The places of the words that aren't shared, with the blanks between them; how many words and letters are shared, and how many words are left."""
        real = lengths[k][i] > 0
        left_out, own = real & shared, real & ~shared
        kept = np.where(own, spans[k][i], np.uint64(0)) | np.where(own & (np.cumsum(own, 1) > 1), gaps[k][i], np.uint64(0))
        n = left_out.sum(1)
        return np.bitwise_or.reduce(kept, 1), n, np.maximum((lengths[k][i] * left_out).sum(1) + n - 1, 0), own.sum(1)

    def usual_scores(i, j):
        n, m = size[0][i], size[1][j]
        if kind == "sort":
            return 200.0 * subsequence(i, j) / (n + m)
        x, y = names[0][i], names[1][j]
        in_x, in_y = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
        for w in range(x.shape[1]):
            same = y == x[:, w, None]
            in_x[:, w] = same.any(1)
            in_y |= same
        kept_i, both, letters, left_i = rest(0, i, in_x)
        kept_j, _, _, left_j = rest(1, j, in_y)
        first = np.where(both > 0, letters + 1, 0)
        best = np.zeros(len(i))
        able = np.flatnonzero(200.0 * np.minimum(n, m) >= (floor - 1e-9) * (n + m))
        best[able] = 200.0 * (subsequence(i[able], j[able], kept_i[able], kept_j[able]) + first[able]) / (n + m)[able]
        held = 200.0 * letters / (letters + np.minimum(n, m))
        return np.where(both == 0, best, np.where((left_i == 0) | (left_j == 0), 100.0, np.maximum(best, held)))

    def scores(i, j):
        out = np.zeros(len(i))
        alone = odd[0][i] | odd[1][j]
        rows = np.flatnonzero(~alone)
        for at in range(0, len(rows), AT_ONCE):
            own = rows[at : at + AT_ONCE]
            out[own] = usual_scores(i[own], j[own])
        for own in np.flatnonzero(alone):
            out[own] = SCORERS[kind](tokens[0][i[own]], tokens[1][j[own]])
        return out

    return scores


def _ratio_hits(left: list[str], right: list[str], kind: str, floor: int, profiles=None) -> Iterator[tuple[list, list, list]]:
    """Places and scores (three lists at a time) of the pairs of two lists of names whose ratio is at least floor. ``profiles``: those of the right, if they are at hand."""
    scores, waiting, n = _ratios(left, right, kind, floor), [], 0
    for pair in _alike(_profiles(left), profiles or _profiles(right), kind, floor):
        waiting.append(pair)
        n += len(pair[0])
        if n >= AT_ONCE:
            yield from _reaching(scores, waiting, floor)
            waiting, n = [], 0
    if n:
        yield from _reaching(scores, waiting, floor)


def _reaching(scores, pairs: list, floor: int) -> Iterator[tuple[list, list, list]]:
    import numpy as np

    i, j = (np.concatenate(x) for x in zip(*pairs))
    score = scores(i, j)
    high = score >= floor - 1e-9
    yield i[high].tolist(), j[high].tolist(), score[high].tolist()


def _normal_tokens(kind: str) -> Column:
    tokens = words_of(F.col("name"))
    return F.array_join(tokens if kind == "sort" else F.array_distinct(tokens), " ").alias("_t")


def catalog_ratios(rows: DataFrame, names: DataFrame, kind: str, floor: int = FLOOR) -> DataFrame:
    """The rows (column ``name`` and more) with each name (column ``name``) of a token sort or token set ratio of floor or more: ``right, score``. Names are sent to all tasks; no row is moved."""
    known = [tuple(r) for r in names.select("name", _normal_tokens(kind)).distinct().where("_t <> ''").collect()]
    texts_known = [t for _, t in known]
    columns = [*rows.columns, "right", "score"]
    asked = rows.select(*rows.columns, _normal_tokens(kind)).where("_t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = _profiles(texts_known)
        for batch in batches:
            of_text: dict[str, list[tuple[int, float]]] = {}
            texts = batch.column(batch.num_columns - 1).to_pylist()
            every = list(dict.fromkeys(texts))
            for begin in range(0, len(every), PROFILED):
                own = every[begin : begin + PROFILED]
                for hits in _ratio_hits(own, texts_known, kind, floor, right):
                    for i, j, score in zip(*hits):
                        of_text.setdefault(own[i], []).append((j, score))
            hits = [(row, j, score) for row, t in enumerate(texts) for j, score in of_text.get(t, ())]
            kept = batch.take(pa.array([row for row, _, _ in hits], pa.int64()))
            yield pa.record_batch([*kept.columns[:-1], pa.array([known[j][0] for _, j, _ in hits], pa.string()), pa.array([score for _, _, score in hits], pa.float64())], columns)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return asked.mapInArrow(run, f"{kinds}, right string, score double")


def ratio_pairs(left: DataFrame, right: DataFrame, kind: str, floor: int = FLOOR, ordered: bool = False) -> DataFrame:
    """``left, right, score``: the names (column ``name``) of both sides whose token sort or token set ratio is at least floor; ``ordered``: only those with left < right.

    A small right side is sent to all tasks. Else both sides are dealt to blocks, and each block meets each other in one task, which holds no more than the two and a tile of their product: by pairs of letters
    in common (see ``_alike``), and the ratio of what is left. (Of ordered pairs of one set, blocks meet once.)
    """
    same = left is right and ordered
    a = saved(left.select("name", _normal_tokens(kind)).distinct().where("_t <> ''"))
    b = (a if same else saved(right.select("name", _normal_tokens(kind)).distinct().where("_t <> ''"))).select(F.col("name").alias("name"), F.col("_t").alias("_t"))
    n, m = a.count(), b.count()
    if m <= CATALOG and not same:
        out = catalog_ratios(a.select("name"), b.select("name"), kind, floor).withColumnRenamed("name", "left")
        return out.where("left < right") if ordered else out
    size = min(max(max(n, m) // 16, 256), RATIO_BLOCK)
    blocks = [max(-(-k // size), 1) for k in (n, m)]
    numbered = lambda side, k, own: side.withColumn(own, F.pmod(F.xxhash64("_t"), F.lit(k)).cast("int"))
    meets = lambda df, own, other, low, high: df.select("name", "_t", own, F.explode(F.sequence(low, high)).alias(other))
    zero = F.lit(0)
    lefts = meets(numbered(a, blocks[0], "_i"), "_i", "_j", F.col("_i") if same else zero, F.lit(blocks[1] - 1))
    rights = meets(numbered(b, blocks[1], "_j"), "_j", "_i", zero, F.col("_j") if same else F.lit(blocks[0] - 1))

    def run(key, one: pa.Table, two: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = [], [], []
        once = same and key[0].as_py() == key[1].as_py()
        if one.num_rows and two.num_rows:
            (x, s), (y, t) = ((z.column("name").to_pylist(), z.column("_t").to_pylist()) for z in (one, two))
            for hits in _ratio_hits(s, t, kind, floor):
                for i, j, score in zip(*hits):
                    if (once or (ordered and not same)) and x[i] >= y[j]:
                        continue
                    swap = same and x[i] > y[j]
                    out[0].append(y[j] if swap else x[i])
                    out[1].append(x[i] if swap else y[j])
                    out[2].append(score)
        return pa.table({"left": pa.array(out[0], pa.string()), "right": pa.array(out[1], pa.string()), "score": pa.array(out[2], pa.float64())})

    columns = ["name", "_t", "_i", "_j"]
    return lefts.select(*columns).groupBy("_i", "_j").cogroup(rights.select(*columns).groupBy("_i", "_j")).applyInArrow(run, "left string, right string, score double")


def unique_winners(pairs: DataFrame) -> DataFrame:
    """``left, right, score`` of the pairs (``left, right, id, score``) whose best score stands for one id alone; ties between ids are refused."""
    best = pairs.groupBy("left").agg(F.max("score").alias("score"))
    top = pairs.join(best, ["left", "score"])
    return top.groupBy("left", "score").agg(F.countDistinct("id").alias("_n"), F.min("id").alias("id"), F.min("right").alias("right")).where("_n = 1").select("left", "right", "id", "score")


def fuzzy_windows(rows: DataFrame, key: str, text: str, names: DataFrame, floor: int = FLOOR) -> DataFrame:
    """``key, window, name, id, score``: each text's widest window of 6 to 2 words, then its first, with a name (``name, id``) of that token set ratio.

    Of a window's names the five best count, by score and name; a name needs twice the window's words at most. Names are compared by their normal form.
    """
    names = saved(names.select(F.array_join(words_of(F.col("name")), " ").alias("name"), "id").where("name <> ''").groupBy("name").agg(F.min("id").alias("id")))
    listed = rows.select(key, F.filter(words_of(F.col(text)), lambda w: F.length(w) > 1).alias("_w"))
    sizes = F.filter(F.sequence(F.lit(NARROWEST), F.lit(WIDEST)), lambda s: s <= F.size("_w"))
    each = listed.select(key, "_w", F.explode(sizes).alias("size")).select(key, "size", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("size") + 1), lambda i: F.array_join(F.slice("_w", i, F.col("size")), " "))).alias("start", "window"))
    each = each.where((F.length("window") >= 4) & usable(F.col("window"))).withColumn("name", F.col("window"))
    if names.count() <= CATALOG:  # windows are met where they are made
        met = catalog_ratios(each, names, "set", floor).drop("name")
    else:
        each = saved(each)
        met = each.join(ratio_pairs(each.select("name"), names, "set", floor).withColumnRenamed("left", "name"), "name").drop("name")
    best = met.withColumn("_n", F.row_number().over(Window.partitionBy(key, "size", "start").orderBy(F.desc("score"), "right"))).where(F.col("_n") <= CANDIDATES)
    held = F.size(F.split("window", " ")) >= COVERAGE * F.size(F.split("right", " "))
    hits = best.where(held).groupBy(key).agg(F.min_by(F.struct("window", "right", "score"), F.struct(-F.col("size"), "start", "_n")).alias("_h"))
    return hits.select(key, "_h.window", F.col("_h.right").alias("name"), F.col("_h.score").alias("score")).join(names, "name").select(key, "window", "name", "id", "score")


# bounded edit distance


def _less_one(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))


def near_words(left: DataFrame, right: DataFrame, word: str = "word") -> DataFrame:
    """``left, right, distance``: words that are equal, or with 5 letters or more (of the longer) one edit apart, or with 8 or more two.

    Words that few edits part become equal by leaving out as many letters on either side: each word is listed under itself less up to two letters, lists
    meet by an equi-join, and the distance is verified. Such lists grow with the square of a word's letters, so where the right one has more than ``PIECED`` it is cut in
    three: two edits leave one of the pieces whole, and the left one holds it at most two letters away from its place.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # short as the words are, there is much to do for each
    words = lambda side: side.select(F.col(word).alias("w")).where(F.col("w").isNotNull()).repartition(tasks, "w").distinct()
    w, letters = F.col("w"), F.length("w")

    def variants(side: DataFrame, name: str) -> DataFrame:
        once = F.when(letters >= 4, _less_one(w)).otherwise(F.array().cast("array<string>"))
        twice = F.when(letters >= 6, F.flatten(F.transform(once, _less_one))).otherwise(F.array().cast("array<string>"))
        return side.select(w.alias(name), F.explode(F.array_distinct(F.concat(F.array(w), once, twice))).alias("_v"))

    def pieces(side: DataFrame, name: str, away: int) -> DataFrame:
        near = F.explode(F.sequence(F.lit(-away), F.lit(away)))
        cut = lambda i: F.floor(i * F.col("_n") / 3).cast("int")
        sized = side.select("w", near.alias("_away")).select("w", (letters + F.col("_away")).alias("_n")).where(F.col("_n") > PIECED)
        each = sized.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("_i")).select("*", near.alias("_away"))
        start, size = cut(F.col("_i")) + F.col("_away"), cut(F.col("_i") + 1) - cut(F.col("_i"))
        return each.where((start >= 0) & (start + size <= letters)).select(w.alias(name), "_n", "_i", F.substr(w, start + 1, size).alias("_v"))

    a, b = words(left), words(right)
    short = variants(a.where(letters <= PIECED + 2), "left").join(variants(b.where(letters <= PIECED), "right"), "_v")
    long = pieces(a.where(letters > PIECED - 2), "left", 2).join(pieces(b.where(letters > PIECED), "right", 0), ["_n", "_i", "_v"])
    met = short.select("left", "right").unionByName(long.select("left", "right")).distinct()
    longest = F.greatest(F.length("left"), F.length("right"))
    most = F.when(longest >= 8, 2).when(longest >= 5, 1).otherwise(0)
    return met.withColumn("distance", F.levenshtein("left", "right")).where(F.col("distance") <= most)


# ladders


def first_rung(rungs: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of the first rung that has any for their key; each rung's own rows are unique by key."""
    tagged = [r.withColumn("rung", F.lit(n)) for n, r in enumerate(rungs, 1)]
    every = tagged[0]
    for r in tagged[1:]:
        every = every.unionByName(r)
    rest = [c for c in every.columns if c not in (*key, "rung")]
    best = every.groupBy(*key).agg(F.min_by(F.struct("rung", *rest), "rung").alias("_b"))
    return best.select(*key, "_b.*")


def prefix_hits(slugs: DataFrame, catalog: DataFrame, least: int = 3) -> DataFrame:
    """``slug, id, prefix``: the longest catalog slug (``slug, id``) of ``least`` letters or more that each slug begins with; each emits its prefixes once."""
    own = slugs.select("slug").distinct()
    starts = own.where(F.length("slug") >= least).select("slug", F.explode(F.transform(F.sequence(F.lit(least), F.length("slug")), lambda n: F.substr("slug", F.lit(1), n))).alias("prefix"))
    met = starts.join(catalog.select(F.col("slug").alias("prefix"), "id"), "prefix")
    return met.groupBy("slug").agg(F.max_by(F.struct("id", "prefix"), F.length("prefix")).alias("_b")).select("slug", "_b.id", "_b.prefix")


LEADING_BODY = "^(department|office|board|commission|council|authority) of (.+)$"


def stamped(rows: DataFrame, key: str, slugs: DataFrame, names: DataFrame, floor: int = FLOOR, refused: list[str] | None = None) -> DataFrame:
    """``key, rung, id, evidence``: the body that each row is of, by the first rung that tells: rows have ``slug`` and ``lines`` (the path and first lines).

    1 the slug (``slug, id``), 2 the longest slug that it begins with (never of those ``refused``), 3 a line that is a name (``name, id``), 4 one that is a name turned round
    at its comma, or at its leading "Department of" and the like, 5 the line that is alike to names of one body alone (token sort ratio); earlier lines first, a tie within a line
    is refused. Only rows that a rung leaves go on to the next.
    """
    own = rows.select(key, "slug").where(F.col("slug").isNotNull())
    exact = own.join(slugs, "slug").groupBy(key).agg(F.min("id").alias("id"), F.first("slug").alias("evidence"))
    starts = own if not refused else own.where(~F.col("slug").isin(refused))
    prefix = starts.join(prefix_hits(starts, slugs), "slug").groupBy(key).agg(F.min("id").alias("id"), F.first("prefix").alias("evidence"))
    by_slug = saved(first_rung([exact, prefix], [key]))

    normal = lambda c: F.array_join(words_of(c), " ")
    left = rows.join(dealt(by_slug.select(key)), key, "left_anti").select(key, F.posexplode("lines").alias("_at", "_line"))
    left = saved(left.select(key, "_at", "_line", normal(F.col("_line")).alias("name")).where("name <> ''"))
    known = saved(names.select(normal(F.col("name")).alias("name"), "id").where("name <> ''").distinct())
    first = F.min(F.struct("_at", "id", "name")).alias("_b")
    as_is = left.join(known, "name").groupBy(key).agg(first)
    comma = F.btrim(F.regexp_extract("_line", "^[^,]*,(.*)$", 1))
    turned = F.when(comma != "", F.concat_ws(" ", comma, F.substring_index("_line", ",", 1))).otherwise(F.regexp_replace("_line", f"(?i){LEADING_BODY}", "$2, $1 of"))
    inverted = left.select(key, "_at", normal(turned).alias("name")).join(known, "name").groupBy(key).agg(first)
    alike = unique_winners(ratio_pairs(left.select("name"), known.select("name"), "sort", floor).join(known.withColumnRenamed("name", "right"), "right"))
    near = left.join(dealt(alike.select(F.col("left").alias("name"), "id")), "name").groupBy(key).agg(first)
    told = [b.select(key, "_b.id", F.col("_b.name").alias("evidence")) for b in (as_is, inverted, near)]
    by_line = first_rung(told, [key]).withColumn("rung", F.col("rung") + 2)
    columns = [key, "rung", "id", "evidence"]
    return by_slug.select(*columns).unionByName(by_line.select(*columns))
