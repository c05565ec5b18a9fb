"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

The index holds test items in pieces of at most ``PIECE`` words. A posting's weight is its BM25
part divided by the piece's score for itself, so a piece found whole scores 1 and one threshold
serves all. Postings are grouped in blocks of ``BLOCK`` pieces with the block's largest weight
(block-max). Of each piece, the lightest postings that sum to at most ``SPARE`` are put aside; a
passage reaches a block only if the block maxima of its other terms and what the block put aside
could reach the threshold (the pivot test of WAND, for all passages of a batch at once). Pieces of
the blocks that pass are scored in full, so everything at or above the threshold is retrieved.
A retrieved item is confirmed where the passage's surroundings hold enough of the word
trigrams of its question and of its answer (its last sentence, or last third). A question or answer of
two words or one is looked for as such; an item of at most three words must stand there word for word. Such a short
item ("yes", a name) is reported wherever it stands, but the text counts as leaked only if it says nothing else.
Scripts that put no spaces between words (Chinese, Japanese, Thai and others) count each letter as a word.

Passages are windows of 2 * PIECE words, PIECE apart: every piece lies whole in one of them.
Items beyond ``max_words`` go to further indexes of that size, each a pass of its own.

Defined cases: a null or empty text leaks nothing; a null or wordless item is in no index;
equal items are each reported; without items nothing leaks; input columns called like an output are replaced; other columns pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE, BLOCK = 64, 8
K1, B = 1.2, 0.75
THRESHOLD, SPARE, OVERLAP = 0.5, 0.2, 0.5
CELLS = 4_000_000
DENSE = 8
BATCH_WORDS = 200_000
SHORT = 3
# Blocks of Thai and Lao, Myanmar, Khmer, kana, and Chinese characters.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
ASCII_WORD = re.compile(r"\w+")
WORD = re.compile(rf"(?=\w)[{UNSPACED}]|[^\W{UNSPACED}]+")
OUTPUTS = T.StructType(
    [
        T.StructField("n_items", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.LongType())),
        T.StructField("best_score", T.DoubleType()),
        T.StructField("leaked", T.BooleanType()),
    ]
)


def words_of(text: str | None) -> list[str]:
    return (ASCII_WORD if text.isascii() else WORD).findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before the last sentence and those of it; of one sentence, the first two thirds and the rest."""
    parts = [w for w in (words_of(x) for x in re.split(r"[.?!\n\u3002\uff01\uff1f]+", text)) if w]
    words = [w for p in parts for w in p]
    if len(parts) > 1 and len(parts[-1]) >= 3 and len(words) - len(parts[-1]) >= 3:
        return words[: -len(parts[-1])], parts[-1]
    cut = max(1, len(words) * 2 // 3)
    return words[:cut], words[cut:] or words


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def trigrams(words: list[str]) -> set[tuple[str, ...]]:
    return grams(words, min(3, len(words)))


def checks_of(text: str) -> tuple[set[tuple[str, ...]], ...]:
    """What confirms an item: n-grams of question and answer, n being 3 or as many words as there are; a very short item whole."""
    words = words_of(text)
    return (trigrams(words),) if len(words) <= SHORT else tuple(trigrams(w) for w in question_and_answer(text))


@dataclass
class Index:
    """Inverted index of some items; its size is bounded by ``max_words`` of the caller."""

    items: list[tuple[int, str]]
    terms: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        pieces: list[tuple[int, Counter]] = []
        for at, (_, text) in enumerate(self.items):
            words = words_of(text)
            for i in range(0, len(words), PIECE):
                # the rest of a long item is searched for as its last PIECE words
                part = words[i : i + PIECE] if i + PIECE <= len(words) or i == 0 else words[-PIECE:]
                pieces.append((at, Counter(part)))
        # pieces of similar vocabulary share blocks, so that block maxima stay close to the weights
        df = Counter(t for _, p in pieces for t in p)
        pieces.sort(key=lambda x: (max(x[1], key=lambda t: (df[t], t)), x[0]))
        self.terms = {t: i for i, t in enumerate(sorted(df))}
        n, mean = max(1, len(pieces)), sum(sum(p.values()) for _, p in pieces) / max(1, len(pieces))
        self.owner = np.array([at for at, _ in pieces], np.int64)
        self.pieces: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_blocks = -(-len(pieces) // BLOCK)
        self.aside = np.zeros(self.n_blocks)
        tops: dict[tuple[int, int], float] = {}
        for at, (_, p) in enumerate(pieces):
            size = sum(p.values())
            part = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)) for t, tf in p.items()}
            whole = sum(part.values())
            order = sorted(part, key=lambda t: (part[t], t))
            weights = np.array([part[t] / whole for t in order])
            ids = np.array([self.terms[t] for t in order])
            self.pieces.append((ids, weights))
            light = int(np.searchsorted(np.cumsum(weights), SPARE, side="right"))
            block = at // BLOCK
            self.aside[block] = max(self.aside[block], weights[:light].sum())
            for t, w in zip(ids[light:].tolist(), weights[light:].tolist(), strict=True):
                tops[t, block] = max(tops.get((t, block), 0.0), w)
        keys = sorted(tops)
        self.start = np.searchsorted(np.array([t for t, _ in keys], np.int64), np.arange(len(self.terms) + 1))
        self.block = np.array([b for _, b in keys], np.int64)
        self.top = np.array([tops[k] for k in keys])
        self.in_block = []
        for b in range(0, len(self.pieces), BLOCK):
            own = self.pieces[b : b + BLOCK]
            self.in_block.append((np.concatenate([i for i, _ in own]), np.concatenate([w for _, w in own]), np.cumsum([0, *(len(i) for i, _ in own[:-1])])))
        self.checks = [checks_of(text) for _, text in self.items]
        self.lengths = [len(words_of(text)) for _, text in self.items]


def leaks(index: Index, texts: list[str | None]) -> list[dict[int, float]]:
    """For each text the items (by place in the index) that are confirmed in it, with their best score."""
    found: list[dict[int, float]] = [{} for _ in texts]
    if not index.n_blocks:
        return found
    held: list[tuple[int, list[str]]] = []
    size = 0
    for i, text in enumerate(texts):
        held.append((i, words_of(text)))
        size += len(held[-1][1])
        if size > BATCH_WORDS:
            _search(index, held, found)
            held, size = [], 0
    _search(index, held, found)
    return found


def _search(index: Index, held: list[tuple[int, list[str]]], found: list[dict[int, float]]) -> None:
    get, parts, firsts, at = index.terms.get, [], [], 0
    for _, words in held:
        parts.append(np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)))
        firsts.append(at)
        at += max(1, -(-len(words) // PIECE))
    doc_of = np.repeat(np.arange(len(held)), np.diff([*firsts, at]))
    term = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    half = np.concatenate([np.arange(len(p)) // PIECE + f for p, f in zip(parts, firsts, strict=True)]) if parts else term
    known = term >= 0
    term, half = term[known], half[known]
    # window w covers halves w and w + 1 of one document
    earlier = half - 1
    same = (earlier >= 0) & (doc_of[np.maximum(earlier, 0)] == doc_of[half])
    keys = np.unique(np.concatenate([half, earlier[same]]) * len(index.terms) + np.concatenate([term, term[same]]))
    window, term = keys // len(index.terms), keys % len(index.terms)
    counts = index.start[term + 1] - index.start[term]
    edges = np.searchsorted(window, np.arange(at + 1))
    upto = np.r_[0, np.cumsum(counts)][edges]
    present = np.zeros(len(index.terms), bool)
    low = 0
    while low < at:
        # as many windows as have CELLS postings, at least one
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + CELLS, side="right")) - 1)
        for win, block in _reached(index, window, term, counts, slice(edges[low], edges[high]), low, high):
            own = term[edges[win] : edges[win + 1]]
            present[own] = True
            ids, weights, starts = index.in_block[block]
            scores = np.add.reduceat(np.where(present[ids], weights, 0.0), starts)
            present[own] = False
            for p in np.flatnonzero(scores >= THRESHOLD - 1e-9).tolist():
                doc, item, score = int(doc_of[win]), int(index.owner[block * BLOCK + p]), float(scores[p])
                mine = found[held[doc][0]]
                if score > mine.get(item, 0.0) and _confirmed(index, item, held[doc][1], (win - firsts[doc]) * PIECE):
                    mine[item] = score
        low = high


def _reached(index: Index, window: np.ndarray, term: np.ndarray, counts: np.ndarray, keys: slice, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Windows and blocks that pass the pivot test. Bounds are added up in a table of windows and blocks if postings fill it, else only where one falls."""
    counts = counts[keys]
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return iter(())
    places = np.arange(ends[-1]) - np.repeat(ends - counts - index.start[term[keys]], counts)
    cell = np.repeat(window[keys] - low, counts) * index.n_blocks + index.block[places]
    if (high - low) * index.n_blocks <= DENSE * len(cell):
        reach = np.bincount(cell, index.top[places])
        cells = np.flatnonzero(reach)
        reach = reach[cells]
    else:
        cells, of = np.unique(cell, return_inverse=True)
        reach = np.bincount(of, index.top[places])
    cells = cells[reach + index.aside[cells % index.n_blocks] >= THRESHOLD - 1e-9]
    return zip((cells // index.n_blocks + low).tolist(), (cells % index.n_blocks).tolist(), strict=True)


def _confirmed(index: Index, item: int, words: list[str], start: int) -> bool:
    around = index.lengths[item]
    near = words[max(0, start - around) : start + 2 * PIECE + around]
    return all(len(want & grams(near, len(next(iter(want))))) >= OVERLAP * len(want) for want in index.checks[item] if want)


def _counts(index: Index, item: int, text: str) -> bool:
    """A short item leaks only as the whole text."""
    return index.lengths[item] > SHORT or index.lengths[item] == len(words_of(text))


def build_indexes(items: DataFrame, max_words: int = 2_000_000) -> list[Index]:
    """Indexes over (item_id, text), each of at most ``max_words`` words or one item."""
    rows = items.where("text is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    out: list[Index] = []
    held: list[tuple[int, str]] = []
    size = 0
    for item_id, text in rows.toLocalIterator():
        n = len(words_of(text))
        if not n:
            continue
        if held and size + n > max_words:
            out.append(Index(held))
            held, size = [], 0
        held.append((item_id, text))
        size += n
    if held:
        out.append(Index(held))
    return out


def with_leaks(df: DataFrame, indexes: list[Index], text: str = "text") -> DataFrame:
    """``df`` with n_items, item_ids (ascending, nulls first) and best_score of the confirmed items, and whether the text leaked."""
    out = df.select(*[f"`{c}`" for c in df.columns if c not in OUTPUTS.names])
    out = out.withColumns({"n_items": F.lit(0).cast("long"), "item_ids": F.array().cast("array<long>"), "best_score": F.lit(0.0), "leaked": F.lit(False)})
    for index in indexes:
        out = out.mapInArrow(_pass_of(index, text), out.schema)
    return out


def _pass_of(index: Index, text: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part[text].to_pylist()
                got = leaks(index, texts)
                before = zip(part["item_ids"].to_pylist(), part["best_score"].to_pylist(), got, strict=True)
                merged = [(sorted([*ids, *(index.items[i][0] for i in g)], key=lambda x: (x is not None, x or 0)), max([best, *g.values()])) for ids, best, g in before]
                columns = {
                    "n_items": pa.array([len(m[0]) for m in merged], pa.int64()),
                    "item_ids": pa.array([m[0] for m in merged], part.schema.field("item_ids").type),
                    "best_score": pa.array([m[1] for m in merged], pa.float64()),
                    "leaked": pa.array([was or any(_counts(index, i, t) for i in g) for was, g, t in zip(part["leaked"].to_pylist(), got, texts, strict=True)], pa.bool_()),
                }
                yield pa.RecordBatch.from_arrays([columns.get(n, c) for n, c in zip(part.schema.names, part.columns, strict=True)], schema=part.schema)

    return search


def without_leaks(docs: DataFrame, indexes: list[Index], text: str = "text") -> DataFrame:
    """Rows of ``docs`` that do not leak, with their own columns whatever these are called."""
    own = [f"_{i}" for i in range(len(docs.columns))]
    clean = with_leaks(docs.toDF(*own), indexes, own[docs.columns.index(text)]).where(~F.col("leaked"))
    return clean.select(*own).toDF(*docs.columns)


def leak_table(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = with_leaks(docs.select("doc_id", "text"), build_indexes(items))
    return found.select("doc_id", "leaked", "n_items", "item_ids", "best_score")
