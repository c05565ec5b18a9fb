"""Periodic runs of words: multi-scale minimizers seed long periods, direct lag scans cover short ones.

A run is a stretch of consecutive words with smallest period q (words q apart are equal)
and at least ``max(least, exponent * q)`` words that no neighbouring word extends. Periods up to
SHORT are read off direct comparisons at each lag. For periods from ``low`` to ``2 * low - 1`` (low = 16,
32, 64, ...) the hashes of grams of ``low / 2`` words are taken at the minima of windows as long:
inside a run the minima repeat at period distance, so the minimum of a run's first aligned window
has an equal one a period later. Pairs of equal minima at a distance of that scale are the
seeds; a checksum over two periods and the runs found so far thin them out, and each seed left is
extended word by word, so a hash never decides about a run. An aligned window has at most ``low`` partners,
which bounds the seeds of a scale by twice the number of words whatever the text is.

A document is worked on whole inside its task; documents are handled in groups of about
GROUP_WORDS words, longest first, so that a scale looks only at those long enough. No row is shuffled.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; equal rows
give equal results; an empty table gives an empty result; input columns called like an output are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.llm.common import words_of

SHORT = 15
GROUP_WORDS = 200_000
LEAST, EXPONENT = 6, 4
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
RUNS_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
BASE = np.uint64(0x9E3779B97F4A7C15)
Edit = Callable[[int | None, list[str]], list[str]]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class _Sums:
    """Checksums of any stretch from prefix sums: word i weighs BASE to the power of i."""

    def __init__(self, words: np.ndarray):
        n, back = len(words), np.uint64(pow(int(BASE), -1, 1 << 64))
        self.power, self.undo = np.full(n + 1, BASE), np.full(n + 1, back)
        self.power[0] = self.undo[0] = 1
        np.cumprod(self.power, out=self.power)
        np.cumprod(self.undo, out=self.undo)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(words.astype(np.uint64)) * self.power[:-1], out=self.sums[1:])

    def grams(self, size: int, end: int) -> np.ndarray:
        """Hash of the ``size`` words from each place before ``end - size``."""
        return _mixed((self.sums[size : end + 1] - self.sums[: end + 1 - size]) * self.undo[: end + 1 - size])

    def periodic(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether two periods from ``at`` equal the two that start one period later, by checksum."""
        here = self.sums[at + 2 * period] - self.sums[at]
        return here * self.power[period] == self.sums[at + 3 * period] - self.sums[at + period]


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each window of ``width`` (a power of two) values."""
    span = 1
    while span < width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return x


def lag_runs(words: np.ndarray, period: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of all maximal stretches with this period and at least ``least`` words."""
    equal = np.flatnonzero(words[period:] == words[:-period])
    if not len(equal):
        return equal, equal
    cut = np.flatnonzero(np.diff(equal) != 1) + 1
    first = np.r_[0, cut]
    length = np.diff(np.r_[first, len(equal)]) + period
    keep = length >= least
    return equal[first[keep]], length[keep]


def seeds(sums: _Sums, low: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of equal window minima ``low`` to ``2 * low - 1`` words apart, from aligned windows on."""
    width = low // 2
    grams = sums.grams(width, end)
    none = np.zeros(0, np.int64)
    blocks = len(grams) // width
    if blocks < 2:
        return none, none
    minima = _sliding(grams, width, np.minimum)
    # a place is a minimum if the largest of the windows' minima around it is its own value
    around = np.r_[np.zeros(width - 1, np.uint64), minima, np.zeros(width - 1, np.uint64)]
    place = np.flatnonzero(_sliding(around, width, np.maximum) == grams)
    first = grams[: blocks * width].reshape(blocks, width).argmin(1) + np.arange(blocks) * width
    order = np.argsort(grams[place], kind="stable")
    value, at = grams[place][order], place[order]
    group = np.r_[0, np.cumsum(value[1:] != value[:-1])]
    stride = end + 2 * low + 1
    keys = group * stride + at
    own = np.empty(len(order), np.int64)
    own[order] = group
    base = own[np.searchsorted(place, first)] * stride + first
    begin, stop = np.searchsorted(keys, base + low), np.searchsorted(keys, base + 2 * low)
    many = stop - begin
    x = np.repeat(first, many)
    nth = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
    return x, at[np.repeat(begin, many) + nth] - x


def _extended(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The maximal stretch with this period around ``at``: its start and its length."""
    right, step = at, 64
    while right + period < len(words):
        equal = words[right : right + step][: len(words) - right - period] == words[right + period : right + period + step]
        if not equal.all():
            right += int(equal.argmin())
            break
        right += len(equal)
        step *= 2
    left, step = at, 64
    while left:
        begin = max(0, left - step)
        equal = words[begin:left] == words[begin + period : left + period]
        if not equal.all():
            left -= int(equal[::-1].argmin())
            break
        left, step = begin, step * 2
    return left, right + period - left


def find_runs(docs: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """Arrays (document, start, length, period) of all runs, by document, start and period; words are numbers >= 0.

    ``exponent`` is at least 4: the seeds rely on four periods in a run.
    """
    if exponent < 4:
        raise ValueError("runs have at least four periods")
    order = sorted(range(len(docs)), key=lambda d: -len(docs[d]))
    sizes = np.array([len(docs[d]) for d in order], np.int64)
    starts = np.r_[0, np.cumsum(sizes + 1)]
    # a mark of its own follows every document, so nothing is equal across documents
    words = np.concatenate([x for k, d in enumerate(order) for x in (docs[d], [-1 - k])]) if docs else np.zeros(0, np.int64)
    words = words.astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def reach(size: int) -> int:
        return int(starts[np.count_nonzero(sizes >= size)])

    for period in range(1, SHORT + 1):
        need = max(least, exponent * period)
        if end := reach(need):
            s, n = lag_runs(words[:end], period, need)
            found.append((s, n, np.full(len(s), period)))
    low, sums = SHORT + 1, None
    while end := reach(max(least, exponent * low)):
        sums = sums or _Sums(words[:end])
        x, p = seeds(sums, low, end)
        inside = x + 3 * p <= end
        x, p = x[inside], p[inside]
        true = sums.periodic(x, p)
        x, p = x[true], p[true]
        if len(x):
            # where a run of a shorter period holds three periods, this one is a multiple of it
            s, n = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            by = np.argsort(s, kind="stable")
            ends = np.r_[0, np.maximum.accumulate((s + n)[by])]
            bare = ends[np.searchsorted(s[by], x, side="right")] < x + 3 * p
            x, p = x[bare], p[bare]
            got, last = [], (0, 0, 0)
            for i in np.lexsort((x, p)):
                at, period = int(x[i]), int(p[i])
                if period == last[2] and last[0] <= at and at + period <= last[0] + last[1]:
                    continue
                last = (*_extended(words, at, period), period)
                if last[1] >= max(least, exponent * period):
                    got.append(last)
            if got:
                found.append(tuple(np.array(c, np.int64) for c in zip(*got, strict=True)))
        low *= 2
    s, n, p = (np.concatenate([f[i] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for i in (0, 1, 2))
    # a multiple of a period has the very same stretch; the smallest one stays
    by = np.lexsort((p, n, s))
    s, n, p = s[by], n[by], p[by]
    new = np.r_[True, (s[1:] != s[:-1]) | (n[1:] != n[:-1])] if len(s) else np.zeros(0, bool)
    s, n, p = s[new], n[new], p[new]
    at = np.searchsorted(starts, s, side="right") - 1
    doc = np.array(order, np.int64)[at] if len(s) else s
    s = s - starts[at] if len(s) else s
    by = np.lexsort((p, s, doc))
    return doc[by], s[by], n[by], p[by]


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge)[:n] == 0


def _described(words: list[list[str]], least: int, exponent: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed texts of a group of documents."""
    coded = pa.array([w for own in words for w in own], pa.string()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    numbers = np.split(coded, np.cumsum([len(own) for own in words])[:-1])
    doc, start, length, period = find_runs(numbers, least, exponent)
    ends = np.searchsorted(doc, np.arange(len(words) + 1))
    texts = []
    for d, own in enumerate(words):
        a, b = ends[d], ends[d + 1]
        if a < b:
            own = [own[i] for i in np.flatnonzero(_kept(len(own), start[a:b], length[a:b], period[a:b]))]
        texts.append(" ".join(own))
    rows = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(RUNS_ARROW.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows).cast(RUNS_ARROW), pa.array(texts, pa.string())


def with_runs(df: DataFrame, text: str = "text", key: str = "doc_id", edit: Edit | None = None, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``df`` with ``runs`` (start, length, period by start and period) and ``collapsed``: the words that stay, joined by a space.

    ``edit`` may change a document's words, given the value of ``key``, before runs are looked for.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("runs", "collapsed")])
    schema = T.StructType([*kept.schema.fields, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: list[list[str]] = []
            begin, size = 0, 0
            for i in range(batch.num_rows):
                own = words_of(batch[text][i].as_py() or "")
                if edit:
                    own = edit(batch[key][i].as_py(), own)
                words.append(own)
                size += len(own)
                if size >= GROUP_WORDS or i + 1 == batch.num_rows:
                    part = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, *_described(words, least, exponent)], names=[*part.schema.names, "runs", "collapsed"])
                    begin, size, words = i + 1, 0, []

    return kept.mapInArrow(scan, schema)


def repeating_tail(doc_id: int | None, words: list[str]) -> list[str]:
    """Every tenth document by checksum gets a periodic tail: words from ``a`` on repeat the first ``p`` of them; a null id changes nothing."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def run_table(docs: DataFrame) -> DataFrame:
    """The narrow result for a documents table: counts, the run of greatest exponent, checksums."""
    found = with_runs(docs.select("doc_id", "text"), edit=repeating_tail)
    # exact comparison of length / period; runs come by start and period, so ties stay with the first
    best = "aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))"
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.expr(best).alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
