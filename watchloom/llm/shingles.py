"""Hashes of words and of word shingles over UTF-8 bytes, and MinHash values of shingle sets."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SHINGLE = 5
ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: the 64-bit golden ratio


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (multiply and shift twice)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _bytes_and_powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)
    powers = np.empty(1 << 12, np.uint64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        for i in range(1, len(powers)):
            powers[i] = powers[i - 1] * ODD
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    return table, powers, blank


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash for each word: a maximal run of bytes other than space and \\t to \\r."""
    table, powers, blank = _bytes_and_powers()
    raw = np.frombuffer(data, np.uint8)
    inside = ~blank[raw]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    first = np.cumsum(np.r_[True, np.diff(at) > 1]) - 1
    place = at - starts[first]
    with np.errstate(over="ignore"):
        # a word beyond the table of powers goes on with a second factor for every full turn
        turn = mixed((place >> 12).astype(np.uint64) + np.uint64(1)) | np.uint64(1) if place.max() >= len(powers) else np.uint64(1)
        parts = table[raw[at]] * powers[place & 4095] * turn
        sums = np.add.reduceat(parts, np.flatnonzero(np.r_[True, np.diff(first) > 0]))
    return mixed(sums)


def shingle_hashes(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """Different shingles of ``size`` words, sorted; a text of fewer words is one shingle, one without words has none."""
    words = word_hashes(data)
    if not len(words):
        return words
    n = min(size, len(words))
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            total = total * ODD + words[k : len(words) - n + 1 + k]
        return np.unique(mixed(total + np.uint64(n)))


@lru_cache(maxsize=4)
def _permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(1 << 63, size=count, dtype=np.uint64) | np.uint64(1), draw.integers(1 << 63, size=count, dtype=np.uint64)


def minhash(shingles: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """``count`` MinHash values (32 bits) of a set that isn't empty, in memory of bounded size."""
    factor, shift = _permutations(count, seed)
    best = np.full(count, np.iinfo(np.uint32).max, np.uint32)
    low, shifts = (factor >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (shift >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 2048):
            part = shingles[i : i + 2048]
            a, b = (part >> np.uint64(32)).astype(np.uint32), part.astype(np.uint32)
            # two halves under odd factors, folded and multiplied again
            h = a[None, :] * low[:, None]
            h ^= h >> np.uint32(15)
            h += b[None, :]
            h *= low[::-1, None]
            h ^= h >> np.uint32(13)
            h += shifts[:, None]
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(16)
            np.minimum(best, h.min(1), out=best)
    return best
