"""Content-chosen anchors: every string of ``length`` bytes has one, and equal strings have the same.

The anchor of a string is the leftmost of its ``GRAM``-byte substrings with the smallest hash
(a minimizer). Consecutive strings mostly share theirs, so there are few anchors, and two places can hold
the same string only if they hold the same anchor.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from watchloom.llm.shingles import ODD, mixed

GRAM = 32
PIECE = 1 << 16  # small enough for a core's cache


@lru_cache(maxsize=1)
def _bytes() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * ODD)


def gram_hashes(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of every substring of ``size`` bytes (a power of two), by doubling."""
    h, step, factor = _bytes()[raw], 1, int(ODD)
    with np.errstate(over="ignore"):
        while step < size:
            h = h[:-step] * np.uint64(factor) + h[step:]
            step, factor = step * 2, factor * factor % (1 << 64)
    return mixed(h)


def leftmost_smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Offset of the leftmost smallest value in every window of ``width``."""
    value, offset, span = h, np.zeros(len(h), np.uint8), 1
    while span < width:
        step = min(span, width - span)
        later = value[step:] < value[:-step]
        offset = np.where(later, offset[step:] + np.uint8(step), offset[:-step])
        value = np.minimum(value[:-step], value[step:])
        span += step
    return offset


def anchors(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first start, last start) of each anchor of some texts, laid end to end in ``raw``.

    Strings that start from first to last start have the anchor; none goes over the end of its text.
    """
    keys, at, first, last = [], [], [], []
    for low in range(0, len(raw) - length + 1, PIECE):
        part = raw[low : low + PIECE + length - 1]
        h = gram_hashes(part)
        chosen = np.arange(len(part) - length + 1) + leftmost_smallest((h >> np.uint64(32)).astype(np.uint32), length - GRAM + 1)
        inside = np.ones(len(chosen), bool)
        for end in (ends[(ends > low) & (ends < low + len(part))] - low).tolist():
            inside[max(0, end - length + 1) : end] = False
        starts = np.flatnonzero(inside)
        if len(starts):
            own = chosen[starts]
            new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)])
            keys.append(h[own[new]])
            at.append(own[new] + low)
            first.append(starts[new] + low)
            last.append(starts[np.r_[new[1:], len(own)] - 1] + low)
    if not keys:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    key, place, start, end = (np.concatenate(x) for x in (keys, at, first, last))
    # an anchor whose strings two pieces hold is one
    whole = np.r_[True, (place[1:] != place[:-1]) | (start[1:] != end[:-1] + 1)]
    closing = np.r_[np.flatnonzero(whole)[1:], len(whole)] - 1
    return key[whole], place[whole], start[whole], end[closing]


def range_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of raw[start:end] for each range, from one pass over the text."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(raw) + 1, ODD, np.uint64)) * np.uint64(pow(int(ODD), -1, 1 << 64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_bytes()[raw] * powers[:-1])])
        # moving every range to the highest power makes equal strings equal
        back = powers[len(raw) - end]
        return mixed((sums[end] - sums[start]) * back + (end - start).astype(np.uint64))
