"""A run-compressed Burrows-Wheeler index of repetitive texts with sampled run ends.

Texts are laid end to end, each closed by a mark of its own that sorts before all bytes. The index keeps the runs
of the transform, for each the text position at its end, and the borders between suffixes that part before
``length`` bytes. ``stream`` reads texts from right to left and holds, for all of them at once, the interval
of the longest match of at most ``length`` bytes: it grows by a step of backward search, and gives up its last byte by
widening to the border one byte shorter. Where it is ``length`` long, its suffixes are all places of that string.
"""

from __future__ import annotations

import numpy as np

MARKS = 1 << 20


class RunIndex:
    """Index of texts given as one array of bytes and their sizes."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, length: int):
        if len(sizes) > MARKS:
            raise ValueError(f"more than {MARKS} texts")
        self.length, self.marks, self.sizes = length, len(sizes), np.asarray(sizes, np.int64)
        self.begin = np.cumsum(self.sizes + 1) - self.sizes - 1
        closing = self.begin + self.sizes
        self.n = int(self.sizes.sum()) + self.marks
        symbols = np.empty(self.n, np.int64)
        inside = np.ones(self.n, bool)
        inside[closing] = False
        symbols[inside] = flat.astype(np.int64) + self.marks
        symbols[closing] = np.arange(self.marks)
        self.symbols = symbols
        order, shorter = self._sorted(symbols, length)
        before = symbols[order - 1]  # the first suffix is preceded by the last mark
        heads = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        ends = np.r_[heads[1:], self.n] - 1
        self.run_start, self.run_symbol, self.run_end_at = heads, before[heads], order[ends]
        self.run_of = np.r_[np.repeat(np.arange(len(heads), dtype=np.int32), ends - heads + 1), np.int32(len(heads))]
        self.used = np.unique(symbols[inside])
        place = np.full(self.marks + 256, -1)
        place[self.used] = np.arange(len(self.used))
        self.place = place
        # for every byte that occurs, how many there are before each run
        byte = np.flatnonzero(self.run_symbol >= self.marks)
        counts = np.zeros((len(self.used), len(heads) + 1), np.int32)
        counts[place[self.run_symbol[byte]], byte + 1] = (ends - heads + 1)[byte]
        self.before_run = np.cumsum(counts, axis=1, dtype=np.int32, out=counts)
        self.smaller = np.searchsorted(np.sort(symbols), self.used).astype(np.int64)
        self.low = self._borders(shorter[length - 1])
        starts = np.flatnonzero(~shorter[length])
        self.first_place = np.minimum.reduceat(order, starts)
        self.class_of = (np.cumsum(~shorter[length]) - 1).astype(np.int32)

    @staticmethod
    def _sorted(symbols: np.ndarray, length: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Suffix order by doubling, and which neighbours in it share length - 1 and length symbols."""
        n = len(symbols)
        padded = np.r_[symbols, np.zeros(4, np.int64)]
        bits = int(max(1, int(symbols.max()))).bit_length()
        key = np.zeros(n, np.int64)
        for k in range(3):
            key = (key << bits) | padded[k : n + k]
        depth, ranks = 3, {}
        while True:
            order = np.argsort(key)
            ordered = key[order]
            new = np.r_[True, ordered[1:] != ordered[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            if depth < length:
                ranks[depth] = rank.astype(np.int32)
            if new.all():
                break
            far = np.r_[rank[depth:], np.full(min(depth, n), -1)][:n] + 1
            key, depth = rank * (n + 1) + far, depth * 2
        span = max(ranks) if ranks else 0
        same = {}
        for size in (length - 1, length):
            a, b = order[1:], order[:-1]
            shift = size - span
            equal = np.zeros(n, bool)
            if span and shift <= span:
                r = ranks[span]
                fits = (a + shift < n) & (b + shift < n)
                equal[1:] = (r[a] == r[b]) & fits & (r[np.minimum(a + shift, n - 1)] == r[np.minimum(b + shift, n - 1)])
            same[size] = equal
        return order, same

    @staticmethod
    def _borders(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row of each row's stretch of suffixes that share a prefix."""
        starts = np.flatnonzero(~same)
        sizes = np.diff(np.r_[starts, len(same)])
        return np.repeat(starts, sizes).astype(np.int32), np.repeat(starts + sizes - 1, sizes).astype(np.int32)

    def rank(self, rows: np.ndarray, column: np.ndarray) -> np.ndarray:
        """How often each row's symbol (by column) occurs in the transform before the row."""
        run = self.run_of[rows]
        inside = np.minimum(run, len(self.run_start) - 1)
        here = (run < len(self.run_start)) & (self.run_symbol[inside] == self.used[column])
        return self.before_run[column, run] + np.where(here, rows - self.run_start[inside], 0)

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Read all texts: (text, start, class) of every string of ``length`` bytes in them."""
        order = np.argsort(-self.sizes, kind="stable")
        sizes, begin = self.sizes[order], self.begin[order]
        shorter_lo, shorter_hi = self.low
        lo, hi, size = np.zeros(len(order), np.int64), np.full(len(order), self.n - 1), np.zeros(len(order), np.int64)
        lanes, starts, classes = [], [], []
        for k in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes, -k, side="left"))  # texts longer than k
            at = sizes[:live] - 1 - k
            c, a, b, s = self.place[self.symbols[begin[:live] + at]], lo[:live], hi[:live], size[:live]
            if k >= self.length:  # every live match is full
                a, b, s = shorter_lo[a], shorter_hi[b], self.length - 1
            lo[:live] = self.smaller[c] + self.rank(a, c)
            hi[:live] = self.smaller[c] + self.rank(b + 1, c) - 1
            size[:live] = s + 1
            if k + 1 >= self.length:
                lanes.append(order[:live])
                starts.append(at)
                classes.append(self.class_of[lo[:live]])
        if not lanes:
            none = np.zeros(0, np.int64)
            return none, none, none
        return np.concatenate(lanes), np.concatenate(starts), np.concatenate(classes)
