"""A compressed FM-index of word sequences, and matching statistics by backward search, many sequences at a time.

The Burrows-Wheeler transform of all sequences lies in a wavelet tree whose shape follows Shannon's code: a word that makes up a
share p of the text has a path of ceil(log2 1/p) bits, so the planes take about the text's entropy and frequent words few steps.

Matching statistics of a sequence with the bound b: at each place the length of the longest run of words from there that also
stands in a sequence with an id smaller than b. A sequence is read from its end to its start. Each word extends the match at
hand to the left, by one backward-search step on its interval of the suffix order; while the longer match has no occurrence with
a smaller id, the match loses words on its right, as many as the parent interval says."""

from __future__ import annotations

import numpy as np


def _rounds(words: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix order, ranks by the first 1, 2, 4, ... words) by prefix doubling; separators all differ and sort first."""
    n = len(words)
    rank = (words + len(separators)).astype(np.int64)
    rank[separators] = np.arange(len(separators))
    ranks, width = [rank.astype(np.int32)], 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = new
        if new[-1] == n - 1:
            return order.astype(np.int32), ranks
        ranks.append(rank.astype(np.int32))
        width *= 2


def _common(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """The number of words that each suffix shares with the one before it in the order; 0 for the first, and at the end."""
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    shared = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        shared += (ranks[level][a + shared] == ranks[level][b + shared]).astype(np.int64) << level
    return np.concatenate([[0], shared, [0]]).astype(np.int32)


def _smaller(values: np.ndarray, step: int) -> np.ndarray:
    """For each place the nearest one before (step -1) or after (step 1) it with a smaller value; the end where there is none."""
    n = len(values)
    at = np.clip(np.arange(n) + step, 0, n - 1).astype(np.int32)
    todo = np.arange(1, n - 1) if n > 2 else np.zeros(0, np.int64)
    while len(todo):
        todo = todo[(values[at[todo]] >= values[todo]) & (at[todo] > 0) & (at[todo] < n - 1)]
        at[todo] = at[at[todo]]  # what lies between a place and its candidate isn't smaller
    return at


class Least:
    """Minima of ranges: powers of two up to 16 from each place, and powers of two of whole blocks of 16."""

    def __init__(self, values: np.ndarray):
        self.near, self.far = [values], []
        for k in range(4):
            x = self.near[-1]
            self.near.append(np.minimum(x, np.concatenate([x[1 << k :], x[-1:].repeat(min(1 << k, len(x)))])[: len(x)]))
        blocks = self.near[4][::16]
        while len(blocks):
            self.far.append(blocks)
            half = 1 << (len(self.far) - 1)
            blocks = np.minimum(blocks[:-half], blocks[half:]) if len(blocks) > half else blocks[:0]

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of values[lo:hi], for non-empty ranges."""
        size, out = hi - lo, np.empty(len(lo), self.near[0].dtype)
        for k in range(5):
            sel = np.flatnonzero((size >> k == 1) if k < 4 else (size >= 16))
            if len(sel):
                out[sel] = np.minimum(self.near[k][lo[sel]], self.near[k][hi[sel] - (1 << k)])
        first, last = (lo + 15) >> 4, hi >> 4
        sel = np.flatnonzero(last > first)
        if len(sel):
            level = np.frexp((last[sel] - first[sel]).astype(np.float64))[1] - 1
            for k in np.unique(level):
                on = sel[level == k]
                out[on] = np.minimum(out[on], np.minimum(self.far[k][first[on]], self.far[k][last[on] - (1 << k)]))
        return out


_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)  # the bits under each place of a word


class WaveletTree:
    """Symbols by the bits of their codes. A level's planes hold the nodes of that depth one after another, packed to 64-bit
    words with the number of ones before each; symbols whose code has ended are in no deeper level."""

    def __init__(self, symbols: np.ndarray, size: int):
        counts = np.bincount(symbols, minlength=size)
        share = np.maximum(counts, 1) / max(1, int(np.maximum(counts, 1).sum()))
        self.bits = np.maximum(1, np.ceil(-np.log2(share) - 1e-9)).astype(np.int32)  # lengths that meet Kraft's inequality
        depth = int(self.bits.max())
        by_length = np.argsort(self.bits, kind="stable")
        room = np.int64(1) << (depth - self.bits[by_length]).astype(np.int64)
        self.code = np.zeros(size, np.int64)
        self.code[by_length] = (np.cumsum(room) - room) >> (depth - self.bits[by_length])
        self.levels, held = [], symbols
        for level in range(depth):
            alive = self.bits > level
            prefix = self.code >> np.maximum(self.bits - level, 0)
            of = prefix[held]
            edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(held) else np.zeros(0, np.int64)
            begins = np.zeros(1 << level, np.int64)
            begins[of[edge]] = edge
            start = np.where(alive, begins[np.where(alive, prefix, 0)], 0).astype(np.int32)
            ones = (self.code[held] >> (self.bits[held] - 1 - level) & 1).astype(bool)
            padded = np.zeros((len(ones) // 64 + 1) * 64, bool)
            padded[: len(ones)] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32)
            self.levels.append((packed, before, start, self._ones(packed, before, start)))
            held = np.concatenate([held[~ones], held[ones]])
            held = held[self.bits[held] > level + 1]

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return before.take(word) + np.bitwise_count(packed.take(word) & _BELOW.take(at & 63))

    def ranks(self, symbol: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its two places (two rows, of ascending places). Where it doesn't stand between
        them the two numbers are equal and may be any."""
        low, high = (x.astype(np.int32) for x in places)
        lo, hi, on, bits, code = low.copy(), high.copy(), np.arange(len(low)), self.bits[symbol], self.code[symbol]
        for level, (packed, before, start, ones_at) in enumerate(self.levels):
            first, less = start.take(symbol), ones_at.take(symbol)
            one = (code >> (bits - 1 - level) & 1) == 1
            a, b = self._ones(packed, before, first + lo) - less, self._ones(packed, before, first + hi) - less
            lo, hi = np.where(one, a, lo - a), np.where(one, b, hi - b)
            done = (bits == level + 1) | (lo == hi)
            ended = np.flatnonzero(done)
            if len(ended):
                left = np.flatnonzero(~done)
                at = on.take(ended)
                low[at], high[at] = lo.take(ended), hi.take(ended)
                on, bits, code, lo, hi, symbol = (x.take(left) for x in (on, bits, code, lo, hi, symbol))
                if not len(on):
                    break
        return np.stack([low, high])


class Index:
    """The FM-index of sequences, with the intervals' parents and the least id of an interval."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, ids: np.ndarray):
        """words: the sequences' words as numbers from 0, one after another; ends: where each ends; ids: each one's id."""
        sizes = np.diff(np.concatenate([[0], ends]))
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        self.sizes, self.ids = sizes, ids
        separators = self.starts + sizes
        text = np.zeros(len(words) + len(ends), np.int64)
        inside = np.ones(len(text), bool)
        inside[separators] = False
        text[inside] = words
        order, ranks = _rounds(text, separators)
        text[inside] += 1  # 0 ends a sequence
        text[separators] = 0
        self.text, self.n = text, len(text)
        self.shared = _common(order, ranks)
        del ranks
        size = int(text.max()) + 1
        self.tree = WaveletTree(text[order - 1], size)
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))]).astype(np.int32)
        names, rank = np.unique(ids, return_inverse=True)
        self.rank = rank.astype(np.int32)
        owner = np.repeat(self.rank, sizes + 1)
        self.least = Least(owner[order])
        self.before, self.after = _smaller(self.shared, -1), _smaller(self.shared, 1)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of the matches that are longer by a word on their left."""
        return tuple(self.count[symbol] + self.tree.ranks(symbol, np.stack([lo, hi])))

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest larger intervals and their matches' lengths."""
        k = np.where(self.shared[lo] >= self.shared[hi], lo, hi)
        return np.where(self.shared[k] > 0, self.before[k], 0), np.where(self.shared[k] > 0, self.after[k], self.n), self.shared[k]


def matching_statistics(index: Index) -> np.ndarray:
    """At each word of the index's sequences, one after another: how many words from there on, within the sequence, also stand
    in a sequence of the index with a smaller id than the sequence's own."""
    at = (index.starts + index.sizes - 1)[index.sizes > 0]  # each sequence's place, from its last word on
    left, bound = index.sizes[index.sizes > 0].copy(), index.rank[index.sizes > 0]
    out = np.zeros(index.n, np.int32)
    lo, hi, length = np.zeros(len(at), np.int32), np.full(len(at), index.n, np.int32), np.zeros(len(at), np.int32)
    while len(at):
        # One try of every sequence: a longer match, or, where there is none, a shorter one; an empty match can't get shorter.
        a, b = index.step(index.text[at], lo, hi)
        good = np.zeros(len(at), bool)
        some = np.flatnonzero(b > a)
        good[some] = index.least(a[some], b[some]) < bound[some]
        fail = np.flatnonzero(~good & (length > 0))
        shorter = index.parent(lo[fail], hi[fail])
        lo, hi, length = np.where(good, a, lo), np.where(good, b, hi), length + good
        done = good | (length == 0)
        lo[fail], hi[fail], length[fail] = shorter
        out[at[done]] = length[done]
        at, left = at - done, left - done
        if not left.all():
            go = np.flatnonzero(left)
            at, left, bound, lo, hi, length = (x[go] for x in (at, left, bound, lo, hi, length))
    inside = np.ones(index.n, bool)
    inside[index.starts + index.sizes] = False
    return out[inside]
