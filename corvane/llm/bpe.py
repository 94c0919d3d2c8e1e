"""Byte-pair encoding by speculation and verification.

A word is first cut by greedy longest match. The guess is right exactly when no merge would have
joined bytes across one of its cuts, which depends on the two tokens at the cut alone: all adjacent
pairs of a batch are tested at once with numpy. Only the words that hold an incompatible pair are
merged exactly.

Texts are cut into chunks first, at every single space or newline between visible characters: the
pre-tokenizer always cuts there, so a chunk's tokens don't depend on its neighbours. Chunks repeat, and
each worker keeps the ids of those that it has seen (bounded by ``CACHE_CHUNKS`` and ``CACHE_BYTES``). They are found by
hash, and the bytes of all chunks found are compared with the text: if any differ, that text is encoded without the cache.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import regex

from corvane.llm import common
from corvane.llm.common import mix64

# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_CHUNKS = 400_000
CACHE_BYTES = 16 << 20
LONG_WORD = 64  # bytes; longer words are merged one by one, with a heap
SIDE_BY_SIDE = 8  # bytes that lengths of words merged together are rounded up to
LANED = 64  # bytes of the longest chunk that is hashed eight bytes at a time, all chunks at once
NEVER = np.int64(1) << 40


def visible_alphabet() -> dict[str, int]:
    """Character of the vocabulary file -> byte: printable Latin-1 stands for itself, others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every run, one run after the other."""
    stop = np.cumsum(size)
    return np.repeat(start - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)


class SlotTable:
    """A hash table in arrays that looks up many integer keys (0 or more) at once."""

    def __init__(self, keys: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        self.bits = max(4, len(keys).bit_length() + 2)
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.first = np.full(1 << self.bits, NEVER, np.int64)
        self.second = np.zeros(1 << self.bits, np.int64)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):  # of the keys that ask for a free slot the first gets it, the others ask for the next
            free = self.key[slot] < 0
            _, win = np.unique(np.where(free, slot, -1), return_index=True)
            win = win[free[win]]
            self.key[slot[win]], self.first[slot[win]], self.second[slot[win]] = keys[left[win]], first[left[win]], second[left[win]]
            rest = np.ones(len(left), bool)
            rest[win] = False
            slot, left = (slot[rest] + 1) & ((1 << self.bits) - 1), left[rest]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two values of every key; NEVER and 0 for unknown ones."""
        slot = self._slots(keys)
        held = self.key[slot]
        hit = held == keys
        on = np.nonzero(~hit & (held >= 0))
        while len(on[0]):
            slot[on] = (slot[on] + 1) & ((1 << self.bits) - 1)
            held = self.key[slot[on]]
            same = held == keys[on]
            hit[tuple(x[same] for x in on)] = True
            more = ~same & (held >= 0)
            on = tuple(x[more] for x in on)
        return np.where(hit, self.first[slot], NEVER), np.where(hit, self.second[slot], 0)


class PairModel:
    """Vocabulary and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = visible_alphabet()
        vocab = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in alphabet for c in token)}
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.ids = {t: i for t, i in vocab.items()}
        for content in self.specials:
            if vocab.get(content.encode()) == self.specials[content]:
                del self.ids[content.encode()]
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in [*vocab.items(), *((c.encode(), i) for c, i in self.specials.items())]:
            self.bytes_of[i] = token
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        # A token is made by one merge at one time; single bytes are there from the start (-1).
        self.made = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = (vocab[bytes(alphabet[c] for c in part)] for part in (a, b))
            new = vocab[self.bytes_of[x] + self.bytes_of[y]]
            self.merge[x, y] = (rank, new)
            self.made[new], self.left[new], self.right[new] = rank, x, y
        keys = np.array([(x << 32) | y for x, y in self.merge], np.int64)
        self.merges = SlotTable(keys, np.array([r for r, _ in self.merge.values()], np.int64), np.array([n for _, n in self.merge.values()], np.int64))
        self._grow_trie()
        self.words = regex.compile(PATTERN)
        self.words_seen = self.words_failed = 0
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.flat_size = np.array([len(x) for x in self.bytes_of], np.int64)
        self.flat_start = np.concatenate([[0], np.cumsum(self.flat_size)[:-1]])

    def _grow_trie(self) -> None:
        """Transitions ``node << 8 | byte`` of the vocabulary's trie, and the token that ends at each node."""
        step: dict[int, int] = {}
        ends = [-1]
        for token, i in self.ids.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = step.get(key, 0)
                if not node:
                    node = step[key] = len(ends)
                    ends.append(-1)
            ends[node] = i
        self.token_at = np.array(ends, np.int64)
        values = np.fromiter(step.values(), np.int64, len(step))
        self.trie = SlotTable(np.fromiter(step.keys(), np.int64, len(step)), values, values)

    # speculation
    def greedy(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches of all words side by side, a byte a step: (word, token) in order of word and place."""
        word = np.arange(len(starts))
        at, begin, stop = starts.copy(), starts.copy(), ends
        node = np.zeros(len(word), np.int64)
        best, best_end = np.full(len(word), -1, np.int64), starts.copy()
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            going = at < stop
            rank, new = self.trie.find(np.where(going, node << 8 | data[np.minimum(at, len(data) - 1)], -1))
            going &= rank < NEVER
            node = np.where(going, new, 0)
            at = np.where(going, at + 1, at)
            token = np.where(going, self.token_at[node], -1)
            best, best_end = np.where(token >= 0, token, best), np.where(token >= 0, at, best_end)
            done = np.flatnonzero(~going)
            if len(done):
                got.append((word[done], begin[done], best[done]))
                begin[done] = at[done] = best_end[done]
                best[done] = -1
                rest = going | (at < stop)
                if not rest.all():
                    word, at, begin, stop, node, best, best_end = (x[rest] for x in (word, at, begin, stop, node, best, best_end))
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner, place, token = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(place, kind="stable")
        return owner[order], token[order]

    # verification
    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the merges leave each pair's cut alone.

        Going back in time from the finished tokens, the pieces that touch the cut are parts of one or the other,
        undone latest merge first. The cut is crossed if two pieces that touch at some time have a merge
        that comes before either is used up; of equal merges the left one comes first.
        """
        good = np.ones(len(first), bool)
        at = np.arange(len(first))
        a, b = first.astype(np.int64), second.astype(np.int64)
        until_a, until_b = np.full(len(a), NEVER), np.full(len(b), NEVER)
        while len(at):
            rank, _ = self.merges.find((a << 32) | b)
            crossed = (rank < until_a) & (rank <= until_b)
            good[at[crossed]] = False
            made_a, made_b = self.made[a], self.made[b]
            go = ~crossed & ((made_a >= 0) | (made_b >= 0))
            undo_a = made_a > made_b
            until_a, until_b = np.where(undo_a, made_a, until_a)[go], np.where(undo_a, until_b, made_b)[go]
            a, b = np.where(undo_a, self.right[a], a)[go], np.where(undo_a, b, self.left[b])[go]
            at = at[go]
        return good

    # exact merging
    def exact(self, word: bytes) -> list[int]:
        """One long word, its merges in a heap."""
        ids = [self.byte_id[b] for b in word]
        after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
        heap = [(self.merge[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= len(ids) or ids[i] != x or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = self.merge[x, y][1], False, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m < len(ids) and (p := (ids[k], ids[m])) in self.merge:
                    heapq.heappush(heap, (self.merge[p][0], k, *p))
        return [x for x, live in zip(ids, alive) if live]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after the other, and each word's number of ids."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        owner, flat = self.greedy(np.frombuffer(b"".join(words), np.uint8), ends - size, ends)
        inner = owner[1:] == owner[:-1]
        pairs, back = np.unique((flat[:-1][inner] << 32) | flat[1:][inner], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failing = np.zeros(len(words), bool)
        failing[owner[1:][inner][~good[back]]] = True
        self.words_seen += len(words)
        self.words_failed += int(failing.sum())
        kept = ~failing[owner]
        n = np.bincount(owner[kept], minlength=len(words))
        exact = self.merge_all(words, np.flatnonzero(failing))
        for at, ids in exact:
            n[at] = ids.shape[1]
        start = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), np.int64)
        out[np.repeat(~failing, n)] = flat[kept]
        for at, ids in exact:
            out[start[at][:, None] + np.arange(ids.shape[1])] = ids
        return out, n

    def merge_all(self, words: list[bytes], failing: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Exact merging of the failing words, those of about one length side by side: one merge of each word a step."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        by_size: dict[int, list[int]] = {}
        for i in failing.tolist():
            by_size.setdefault(-(-len(words[i]) // SIDE_BY_SIDE) * SIDE_BY_SIDE, []).append(i)
        start = np.array(self.byte_id, np.int64)
        for width, members in by_size.items():
            if width > LONG_WORD:
                out += [(np.array([i]), np.array([self.exact(words[i])])) for i in members]
                continue
            at = np.array(members)
            left = np.fromiter((len(words[i]) for i in members), np.int64, len(members))
            ids = start[np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in members]), np.uint8).reshape(-1, width)]
            ids[np.arange(width) >= left[:, None]] = -1  # behind the word; such a pair is no key
            # The merge of each pair is looked up once; a merge changes but the pairs on either side of it.
            # Columns of pairs without a merge stand before the first and after the last place.
            rank, new = (np.pad(x, ((0, 0), (1, 1)), constant_values=c) for x, c in zip(self.merges.find((ids[:, :-1] << 32) | ids[:, 1:]), (NEVER, 0)))
            while len(at):
                best = rank.argmin(1)
                rows = np.arange(len(at))
                live = rank[rows, best] < NEVER
                if not live.all():
                    out += [(at[own], ids[own, :n]) for n in np.unique(left[~live]).tolist() if len(own := np.flatnonzero(~live & (left == n)))]
                    at, best, left, ids, rank, new = at[live], best[live], left[live], ids[live], rank[live], new[live]
                    rows = rows[: len(at)]
                    if not len(at):
                        break
                ids[rows, best - 1] = new[rows, best]
                left -= 1
                # Without the place of the second token, and without the pair of the two.
                moved = np.arange(ids.shape[1]) >= best[:, None]
                flat = np.arange(ids.shape[1] - 1) + moved[:, :-1]
                ids = ids.ravel()[flat + (rows * ids.shape[1])[:, None]]
                flat = np.arange(rank.shape[1] - 1) + moved
                flat += (rows * rank.shape[1])[:, None]
                rank, new = rank.ravel()[flat], new.ravel()[flat]
                # The pair before the merged token is pair best - 1 now, the one after it pair best.
                for place, there in ((best - 1, best > 1), (best, best < ids.shape[1])):
                    r, p = rows[there], place[there]
                    rank[r, p], new[r, p] = self.merges.find((ids[r, p - 1] << 32) | ids[r, p])
        return out

    def encode_chunks(self, chunks: list[bytes], inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All chunks' ids one after the other, and each chunk's number of ids.

        ``inner`` marks chunks that begin with a lone space and end with a visible character: joined, they
        are cut as each alone is, so the pattern runs once over all of them.
        """
        number: dict[str, int] = {}
        word_of: list[int] = []
        count = np.zeros(len(chunks), np.int64)
        special = np.zeros(len(chunks), bool)
        raw = b"".join(chunks)
        if self.special_cut is not None and self.special_cut.search(raw.decode()):
            special[[i for i, c in enumerate(chunks) if self.special_cut.search(c.decode())]] = True
        joined = np.flatnonzero(inner & ~special)
        if len(joined) < len(chunks):
            raw = b"".join([chunks[i] for i in joined])
        found = self.words.findall(raw.decode())
        if len(joined):
            # Where chunks end, in characters: bytes that don't go on with one.
            sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))[joined]
            ends = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[np.cumsum(sizes) - 1]
            count[joined] = np.diff(np.searchsorted(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), ends, "right"), prepend=0)
        lone = np.flatnonzero(~inner | special)
        for i in lone:
            own_text = chunks[i].decode()
            pieces = self.special_cut.split(own_text) if special[i] else (own_text,)
            own = [w for p in pieces for w in ((p,) if p in self.specials else self.words.findall(p))]
            found += own
            count[i] = len(own)
        word_of = [number.setdefault(w, len(number)) for w in found]
        flat, size = self.encode_words([w.encode() for w in number])
        for content, i in self.specials.items():
            if content in number:  # an added token is one id whatever its bytes would merge to
                k = number[content]
                at = int(size[:k].sum())
                flat, size = np.concatenate([flat[:at], [i], flat[at + size[k] :]]), np.concatenate([size[:k], [1], size[k + 1 :]])
        start = np.cumsum(size) - size
        # Words lie as the joined chunks and then the lone ones; put them in the chunks' order.
        order = np.concatenate([joined, lone])
        begin = np.zeros(len(chunks), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        words = np.array(word_of, np.int64)[spread(begin, count)]
        return flat[spread(start[words], size[words])], np.add.reduceat(np.append(size[words], 0), np.cumsum(count) - count) * (count > 0) if len(chunks) else size

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes in UTF-8; what isn't valid UTF-8 becomes U+FFFD, as in the library."""
        size = self.flat_size[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        raw = self.flat[np.repeat(self.flat_start[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()
        return raw.decode("utf-8", "replace").encode()


_ODD = np.uint64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
# Bytes by what a cut may follow or precede.
_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
_TWO_BYTE_LEAD = np.zeros(256, bool)
_TWO_BYTE_LEAD[0xC3:0xE0] = True  # U+00C0 to U+07FF: no white space
_NEXT = _GRAPHIC.copy()
_NEXT[0xC3:0xF5] = True
_NEXT[[0xE1, 0xE2, 0xE3]] = False  # white space beyond Latin-1 begins so


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin: every row's first byte and each lone space or newline between visible characters.

    The second array marks the chunks that lie between two such spaces.
    """
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[(at >= 1) & (at < len(data) - 1)]
    last = data[at - 1]
    ok = (_GRAPHIC[last] | ((last >= 0x80) & _TWO_BYTE_LEAD[data[np.maximum(at - 2, 0)]])) & _NEXT[data[at + 1]]
    begin = np.zeros(len(data), bool)
    begin[at[ok]] = True
    inner = begin.copy()  # begins with a lone space in the midst of its row
    heads = offsets[:-1][np.diff(offsets) > 0]
    begin[heads] = True
    inner[heads] = False
    starts = np.flatnonzero(begin)
    inner = inner[starts]
    inner[:-1] &= inner[1:]  # and ends where another such begins
    inner[-1:] = False
    return starts, inner


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every chunk: eight bytes after the other are mixed in, for all chunks at once; only those over ``LANED`` bytes are hashed one by one."""
    size = ends - starts
    out = mix64(size.astype(np.uint64))
    lanes = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(8, np.uint8)]), (len(data) + 1, 8), (1, 1))
    on = np.flatnonzero(size <= LANED)
    for at in range(0, LANED, 8):
        on = on[size[on] > at]
        if not len(on):
            break
        word = lanes[starts[on] + at].view("<u8").ravel()
        word &= _FIRST_BYTES[np.minimum(size[on] - at, 8)]
        out[on] = mix64(out[on] * _ODD + word)
    long = np.flatnonzero(size > LANED)
    out[long] = common.span_hashes(data, starts[long], ends[long])
    return out


class ChunkEncoder:
    """Ids of whole texts, batch by batch, with the ids of known chunks in sorted arrays."""

    def __init__(self, path: str) -> None:
        self.model = PairModel(path)
        self.forget()

    def forget(self) -> None:
        """Empty the cache."""
        # Levels of (hash, place and number of the ids, place and number of the bytes), sorted by hash.
        self.levels: list[tuple[np.ndarray, ...]] = []
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.raw, self.raw_used = np.zeros(1 << 18, np.uint8), 0

    def _add(self, keys: np.ndarray, chunks: list[bytes], inner: np.ndarray) -> None:
        ids, size = self.model.encode_chunks(chunks, inner)
        raw, raw_size = np.frombuffer(b"".join(chunks), np.uint8), np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.pool = self._put(self.pool, self.used, ids)
        self.raw = self._put(self.raw, self.raw_used, raw)
        level = (keys, np.cumsum(size) - size + self.used, size, np.cumsum(raw_size) - raw_size + self.raw_used, raw_size)
        self.used, self.raw_used = self.used + len(ids), self.raw_used + len(raw)
        # Levels at least double in size from the newest to the oldest, so lookups stay few.
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            joined = [np.concatenate(x) for x in zip(self.levels.pop(), level)]
            order = np.argsort(joined[0], kind="stable")
            level = tuple(x[order] for x in joined)
        self.levels.append(level)

    @staticmethod
    def _put(pool: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
        if used + len(new) > len(pool):
            pool = np.concatenate([pool[:used], np.zeros(max(len(new), used), pool.dtype)])
        pool[used : used + len(new)] = new
        return pool

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Place and number of the ids and of the bytes of every key; -1 for the place of unknown ones."""
        out = np.full(len(keys), -1), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for known, *values in self.levels:
            spot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[spot] == keys
            for x, v in zip(out, values):
                x[hit] = v[spot[hit]]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after the other, and the n + 1 offsets of each row's ids."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, inner = chunk_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = span_hashes(data, starts, ends)
        order = np.argsort(hashes, kind="stable")
        change = np.append(True, hashes[order][1:] != hashes[order][:-1])
        keys, first = hashes[order][change], order[change]
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(change) - 1
        found = self._find(keys)
        if (found[0] < 0).any() and (sum(len(x[0]) for x in self.levels) > CACHE_CHUNKS or self.raw_used > CACHE_BYTES):
            self.forget()
            found = self._find(keys)
        new = np.flatnonzero(found[0] < 0)
        cut = lambda which: [data[s:e].tobytes() for s, e in zip(starts[which].tolist(), ends[which].tolist())]
        for part in np.array_split(new, max(1, -(-len(new) // 100_000))):
            if len(part):
                self._add(keys[part], cut(first[part]), inner[first[part]])
        if len(new):
            found = self._find(keys)
        start, n, raw_start, raw_size = (x[back] for x in found)
        # Chunks lie one after the other: those found, joined, must be the text.
        if np.array_equal(raw_size, ends - starts) and np.array_equal(self.raw[spread(raw_start, raw_size)], data):
            ids = self.pool[spread(start, n)]
        else:
            ids, n = self.model.encode_chunks(cut(slice(None)), inner)
            ids = ids.astype(np.uint32)
        return ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offsets)]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
