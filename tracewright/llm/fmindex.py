"""An FM-index over word codes, and matching statistics of streamed texts by backward search.

What is kept of the indexed texts is the Burrows-Wheeler transform in a wavelet matrix, the number of smaller codes for
each code, the common prefix of neighbouring suffixes (one byte each, capped at 64), and the least weight of each
group of suffixes that share a window; the texts and the suffix order are dropped once these are built.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
DEEPEST = 64  # suffixes are ordered by so many codes, which is all that patterns of that length need


def _classes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense order-preserving numbers of pairs."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _ahead(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(x)
    if n < len(x):
        out[: len(x) - n] = x[n:]
    return out


class Bits:
    """A bit vector with rank: packed words, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(U64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]))
        self.zeros = n - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (U64(1) << (at & 63).astype(U64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class Lows:
    """An array of bytes with searches for the nearest entry below a value, by minima over blocks of 2, 4, 8, ... entries."""

    def __init__(self, values: np.ndarray):
        levels = [values.astype(np.uint8)]
        while len(levels[-1]) > 1:
            last = levels[-1]
            if len(last) % 2:
                last = np.append(last, np.uint8(255))
            levels.append(np.minimum(last[::2], last[1::2]))
        self.at = np.cumsum([0, *map(len, levels)])
        self.flat = np.concatenate(levels)

    def nearest(self, at: np.ndarray, value: np.ndarray, step: int) -> np.ndarray:
        """The entry nearest to each place, itself included, on the left (step -1) or the right (1), that is below the value; there is one."""
        place, level = at.copy(), np.zeros(len(at), np.int64)
        open_ = np.flatnonzero(self.flat[place] >= value)
        side = 1 if step < 0 else 0  # a block of this parity has its sibling in the direction of the search
        while len(open_):  # up: to the sibling where it lies ahead, else to the parent's neighbour
            p, v = place[open_], level[open_]
            ahead = (p & 1) == side
            p, v = np.where(ahead, p + step, (p >> 1) + step), np.where(ahead, v, v + 1)
            place[open_], level[open_] = p, v
            open_ = open_[self.flat[self.at[v] + p] >= value[open_]]
        deep = np.flatnonzero(level)
        while len(deep):  # down: into the nearer half that holds such an entry
            p, v = place[deep] * 2 + side, level[deep] - 1
            there = np.minimum(p, self.at[v + 1] - self.at[v] - 1)
            far = (self.flat[self.at[v] + there] >= value[deep]) | (there != p)
            place[deep], level[deep] = np.where(far, p + step, p), v
            deep = deep[v > 0]
        return place


class FMIndex:
    """Texts of codes >= 1 parted by 0, with a weight for each code; ``window`` (at most 64) is the length that is reported."""

    def __init__(self, codes: np.ndarray, weight: np.ndarray, window: int):
        self.n, self.window = len(codes), window
        rank = {1: np.unique(codes, return_inverse=True)[1]}
        for d in (1, 2, 4, 8, 16, 32):
            rank[2 * d] = _classes(rank[d], _ahead(rank[d], d))
        order = np.argsort(rank[DEEPEST], kind="stable")
        common, a, b = np.zeros(self.n + 1, np.int64), order[:-1], order[1:]
        for d in (64, 32, 16, 8, 4, 2, 1):
            padded = np.append(rank[d], [-1] * (DEEPEST + 1))  # a suffix's end is like nothing but itself
            at = common[1:-1]
            at += np.where((padded[np.minimum(a + at, self.n)] == padded[np.minimum(b + at, self.n)]) & (np.maximum(a, b) + at < self.n), d, 0)
            if d == 64:
                whole = at == 64
            at[whole] = 64
        self.common = Lows(common)
        self.begin, self.least = {}, None
        for depth in (window - 1, window):
            self.begin[depth] = np.flatnonzero(common[:-1] < depth)
        self.least = np.minimum.reduceat(weight[order], self.begin[window])
        counts = np.bincount(codes)
        self.below = np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.levels, seq = [], codes[order - 1]
        for level in range(max(1, int(codes.max(initial=1)).bit_length()) - 1, -1, -1):
            bit = (seq >> level & 1).astype(np.uint8)
            self.levels.append((level, Bits(bit)))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.home = self._walk(np.arange(len(counts)), np.zeros(len(counts), np.int64))

    def _walk(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in self.levels:
            ones = bits.ones(at)
            at = np.where(code >> level & 1, bits.zeros + ones, at - ones)
        return at

    def occurrences(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each code stands among the first ``at`` of the transform."""
        return self._walk(code, at) - self.home[code]

    def extend(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of the pattern with a code put before it: one backward-search step; empty where it doesn't occur."""
        both = self.occurrences(np.concatenate([code, code]), np.concatenate([lo, hi]))
        return self.below[code] + both[: len(code)], self.below[code] + both[len(code) :]

    def shortened(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffix interval and length of the longest shorter pattern (codes dropped at the end) that occurs more often."""
        depth = np.maximum(self.common.flat[lo], self.common.flat[hi])
        root = depth == 0
        left, right = np.zeros(len(lo), np.int64), np.full(len(lo), self.n)
        some = np.flatnonzero(~root)
        left[some] = self.common.nearest(lo[some], depth[some], -1)
        right[some] = self.common.nearest(hi[some], depth[some], 1)
        return left, right, depth.astype(np.int64)

    def matches(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Where streamed texts match a window: (text, position, least weight of the window's occurrences).

        A text is a stretch of ``codes``, 0 for a code that the index doesn't have, and is read backwards. Its matching
        statistic at a position, the length of the longest match that starts there, is kept up to ``window``: the match
        is extended by the code before it; where that doesn't occur, it is shortened at its end until it does. Positions
        whose statistic reaches the window are reported.
        """
        text = np.argsort(-size, kind="stable")
        left, at = size[text], (start + size)[text]
        lo, hi, length = np.zeros(len(text), np.int64), np.full(len(text), self.n), np.zeros(len(text), np.int64)
        out = []
        for step in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -step, side="left"))
            text, at, left, lo, hi, length = text[:n], at[:n] - 1, left[:n], lo[:n], hi[:n], length[:n]
            full = np.flatnonzero(length == self.window)
            if len(full):
                begin = self.begin[self.window - 1]
                k = np.searchsorted(begin, lo[full], side="right")
                lo[full], hi[full], length[full] = begin[k - 1], np.append(begin, self.n)[k], self.window - 1
            code = codes[at]
            lost = code == 0
            lo[lost], hi[lost], length[lost] = 0, self.n, 0
            open_ = np.flatnonzero(~lost)
            while len(open_):
                a, b = self.extend(code[open_], lo[open_], hi[open_])
                ok = b > a
                good, open_ = open_[ok], open_[~ok]
                lo[good], hi[good] = a[ok], b[ok]
                length[good] += 1
                lo[open_], hi[open_], length[open_] = self.shortened(lo[open_], hi[open_])
            hit = np.flatnonzero(length == self.window)
            if len(hit):
                least = self.least[np.searchsorted(self.begin[self.window], lo[hit], side="right") - 1]
                out.append((text[hit], at[hit] - start[text[hit]], least))
        return out
