"""Language-model scores by logistic context mixing over the bits of words.

A text is its lower-cased words, each followed by a space, and one more space for its end; the model gives every
bit of those bytes a probability, so the probabilities of all texts add up to 1 at most.
Predictors of a bit are counts in contexts: the word so far (exact counts of the trie of all training words, or hashed
for the first HEAD bytes), the last 1, 2 and 3 bytes, the place in the word, and for the first HEAD
bytes also a class of the last short word and of the last word, each with the word so far. Weights chosen by
a gate (how much the two sharpest contexts have seen) mix their log odds; an adaptive probability
map refines the result. Contexts that have seen a single bit only speak by how often such histories went on. Weights are learnt online, batch of
nodes by batch, from all training words and heads, each bit seen with its own occurrence taken out of the counts; tasks' weights are averaged. While a text is read, its own
words so far adapt the model: a word that came up ``k`` times in ``t`` gets (k - DISCOUNT) / (t + STRENGTH), and the model keeps the rest.

How it is spread: documents are cut into blocks of about BLOCK_TOKENS words. Blocks list their distinct words; their counts
are added up over all blocks (the vocabulary, which grows with the corpus and is never gathered in one place) and
dealt out by the first bytes of the words, so that a task holds whole branches of the trie. A first few bytes
that more than HOT words share are dealt out by more bytes, and the nodes above come from the hashed counts. The distinct heads with their
classes are added up over all blocks likewise and dealt out by class and first byte. What depends on a word alone
is worked out once for a distinct word and sent back to the blocks that ask for it. Hashed counts (TABLES x SLOTS x 2 numbers, 56 MB) and weights
are of fixed size; they are the only model data in every task. Trie counts reach TRIE bytes deep; bytes after them are predicted by
the other contexts.

Defined cases: a null text is empty and consists of its end; rows with a null doc_id are scored, and neither held out nor learnt from;
equal rows get equal rows; an empty table gives an empty result; without training rows all counts are 0 and every bit is even; other columns
are not read. Scores depend on how documents are cut into tasks by a tiny amount, as the weights do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.llm import files
from watchloom.llm.common import by_key, stored
from watchloom.session import new_run_dir

BLOCK_TOKENS, PIECE_BYTES = 2_000_000, 4_000_000
HEAD, LONG_HEAD, TRIE = 3, 12, 48
HOT = 200_000
SLOT_BITS = 20
SLOTS, CHUNK = 1 << SLOT_BITS, 4096
TABLES = ("prefix", "order1", "order2", "order3", "place", "short", "last")
WORD_TABLES = 5  # those that depend on the word alone
PLAIN = (1, 4)  # those whose contexts are few enough to be slots themselves
SHORT_CLASSES, LAST_CLASSES = 32, 16
COUNT_GATES, SIDE_GATES = 12, 6
MAP_CONTEXTS, MAP_STEPS, HISTORIES = 64, 33, 32
SPACE = 32
RATE, KEEP, STEP = 0.03, 0.99, 4096
DISCOUNT, STRENGTH = 0.8, 100.0
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _base(*parts: np.ndarray | int) -> np.ndarray:
    """A checksum for each combination of parts."""
    h = np.full(1, 0x27D4EB2F165667C5, np.uint64)
    for i, part in enumerate(parts):
        h = (h ^ np.asarray(part).astype(np.uint64)) * ODD[i % 4]
        h = h ^ (h >> np.uint64(29))
    return h


def _slot(base: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The slot of a node of the byte that follows a context."""
    h = (base ^ node.astype(np.uint64)) * ODD[2]
    return (((h ^ (h >> np.uint64(31))) * ODD[0]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Words:
    """Words as one run of bytes; byte ``len`` of a word is the space that ends it."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.binary())
        self.data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else np.zeros(0, np.uint8)
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        self.at, self.size = ends[:-1], np.diff(ends)

    def byte(self, which: np.ndarray, j: int) -> np.ndarray:
        """Byte ``j`` of the words ``which``: a space before the first and after the last."""
        if j < 0 or not len(self.data):
            return np.full(len(which), SPACE, np.int64)
        inside = j < self.size[which]
        return np.where(inside, self.data[np.where(inside, self.at[which] + j, 0)], SPACE).astype(np.int64)

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Class of a word as a short one (0: it is not short) and as the last one, both from 1 on."""
        every = np.arange(len(self.at))
        code = (_base(*[self.byte(every, j) for j in range(8)], self.size) >> np.uint64(40)).astype(np.int64)
        short = np.where((self.size > 0) & (self.size <= 3), 1 + code % (SHORT_CLASSES - 1), 0)
        return short, 1 + code % (LAST_CLASSES - 1)


class Mixer:
    """Gated weights and the probability map; learns online."""

    def __init__(self, inputs: int):
        # the first predictor, the word so far, leads at the start, the more so the more it has seen
        lead = np.repeat(np.linspace(0.3, 0.9, COUNT_GATES), SIDE_GATES)
        self.weights = np.outer((1 - lead) / (inputs - 1), np.ones(inputs))
        self.weights[:, 0] = lead
        self.squares, self.steps = np.zeros_like(self.weights), np.zeros(len(self.weights))
        self.seen = np.zeros((MAP_CONTEXTS, MAP_STEPS, 2))
        # how often one-sided histories held and failed
        self.histories = np.zeros((inputs, 8, HISTORIES, 2))
        self.refined: np.ndarray | None = None

    def mixed(self, gate: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Log odds; ``x`` has a row for each predictor."""
        weights = self.weights.T.copy()
        odds = weights[0][gate] * x[0]
        for w, own in zip(weights[1:], x[1:], strict=True):
            odds += w[gate] * own
        return np.clip(odds, -15, 15)

    @staticmethod
    def cells(odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = (np.clip(odds, -7.999, 7.999) + 8) * 2
        low = place.astype(np.int64)
        return low, place - low

    def chance(self, gate: np.ndarray, x: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Probability of a 1."""
        odds = self.mixed(gate, x)
        p = 1 / (1 + np.exp(-odds))
        if self.refined is not None:
            low, part = self.cells(odds)
            p = (p + self.refined[context, low] * (1 - part) + self.refined[context, low + 1] * part) / 2
        return np.clip(p, 1e-6, 1 - 1e-6)

    def learn(self, gate: np.ndarray, x: np.ndarray, context: np.ndarray, bit: np.ndarray, n: np.ndarray) -> None:
        """Online steps on bits that occurred ``n`` times."""
        # nodes come in the order of words; steps take them spread over all
        steps = -(-len(gate) // STEP)
        for begin in range(steps):
            self._step(*(np.ascontiguousarray(v[..., begin::steps]) for v in (gate, x, context, bit, n)))

    def _step(self, gate: np.ndarray, x: np.ndarray, context: np.ndarray, bit: np.ndarray, n: np.ndarray) -> None:
        odds = self.mixed(gate, x)
        error = (bit - 1 / (1 + np.exp(-odds))) * n
        many = np.bincount(gate, n, len(self.weights))
        hit = np.flatnonzero(many)
        gradient = np.stack([np.bincount(gate, error * own, len(self.weights)) for own in x], 1)[hit] / many[hit, None]
        self.squares[hit] = KEEP * self.squares[hit] + (1 - KEEP) * gradient**2
        self.steps[hit] += 1
        size = np.sqrt(self.squares[hit] / (1 - KEEP ** self.steps[hit, None])) + 1e-3
        self.weights[hit] += RATE / np.sqrt(1 + self.steps[hit, None] / 100) * gradient / size
        low, part = self.cells(odds)
        np.add.at(self.seen.reshape(-1), (context * MAP_STEPS + low + (part > 0.5)) * 2 + bit, n)

    def rows(self, kind: int) -> list[tuple[int, int, int, float, float]]:
        """What this task has learnt as (kind, what, index, value, weight): averaged over tasks for weights, added up for the map."""
        out = [(kind, 0, i, float(w * s), float(s)) for i, (w, s) in enumerate(zip(self.weights.ravel(), np.repeat(self.steps, self.weights.shape[1]), strict=True)) if s]
        return out + [(kind, what, i, float(v), 1.0) for what, sums in ((1, self.seen), (2, self.histories)) for i, v in enumerate(sums.ravel()) if v]

    def settle(self, rows: list[tuple[int, int, float, float]]) -> None:
        """Take over (what, index, value, weight) of all tasks."""
        own = self.weights.ravel(), self.seen.ravel(), self.histories.ravel()
        for what, i, value, weight in rows:
            own[what][i] = value / weight if what == 0 else value
        level = 1 / (1 + np.exp(-(np.arange(MAP_STEPS) / 2 - 8)))
        self.refined = (self.seen[:, :, 1] + 8 * level) / (self.seen.sum(2) + 8)


class Model:
    """Hashed counts and a mixer for heads (first HEAD bytes) and one for the rest of a word."""

    def __init__(self, tables: np.ndarray | None = None):
        self.tables = tables
        self.mixers = (Mixer(len(TABLES)), Mixer(WORD_TABLES))
        self._worked_out: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def counts(self, k: int, slots: np.ndarray) -> np.ndarray:
        """Zeros and ones at slots; a pair is read as one number, which is faster than as a row of two."""
        table = self.tables[k]
        return table.view(f"c{2 * table.itemsize}")[:, 0][slots].view(table.dtype).reshape(-1, 2).T

    def worked_out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every slot: log odds of two-sided counts, sign and level of one-sided ones, and the total's power of two."""
        if self._worked_out is None:
            n0, n1 = self.tables[:, :, 0], self.tables[:, :, 1]
            odds, side = _spoken(n0, n1)
            self._worked_out = odds.astype(np.float32), side.astype(np.int8), _powers(n0 + n1).astype(np.int8)
        return self._worked_out


def _powers(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(n + 1)), COUNT_GATES - 1)


def _spoken(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log odds, 0) of a predictor that has seen both bits, (0, signed level) of one that has seen one bit only."""
    two = np.minimum(n0, n1) > 0
    return np.where(two, np.log((n1 + 0.4) / (n0 + 0.4)), 0), np.where(two, 0, np.sign(n1 - n0) * _levels(n0 + n1)).astype(np.int64)


def _levels(n: np.ndarray) -> np.ndarray:
    """Half powers of two."""
    return np.minimum(np.ceil(2 * np.log2(n + 1)), HISTORIES - 1).astype(np.int64)


def _inputs(spoken: list[tuple[np.ndarray, np.ndarray]], total: np.ndarray, t: int, histories: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Gate and log odds of the predictors, a row for each.

    A predictor that has seen both bits speaks by its counts; one that has seen a single bit only, by how often such a
    history went on at this place of a byte. The first predictor's total, whether it is such a history, and the place choose the gate.
    """
    columns = []
    for k, (odds, side) in enumerate(spoken):
        holds, fails = histories[k, t].T
        told = np.log((holds + 0.5) / (fails + 0.5))
        # by side: 0, 1, 2, ... and, counted from the end, ..., -2, -1
        columns.append(odds + np.r_[0, told[1:], -told[:0:-1]][side])
    first_odds, first_side = spoken[0]
    return _gate(total, (first_side != 0) | (total == 0), t), columns


def _gate(total: np.ndarray, one_sided: np.ndarray, t: int) -> np.ndarray:
    return total.astype(np.int64) * SIDE_GATES + one_sided * 3 + (0 if t == 0 else 1 if t < 3 else 2)


def _bits(model: Model, kind: int, slots: list[np.ndarray], exact: tuple[np.ndarray, np.ndarray] | None, use: np.ndarray | None, place: int, t: int, ones: np.ndarray, zeros: np.ndarray, learn: bool) -> np.ndarray | None:
    """Probability of a 1 at each node for bit ``t`` of byte ``place``, or (``learn``) a step on the ones and zeros seen there.

    ``exact`` (zeros, ones) stands in for the first table at the nodes of ``use``.
    """
    mixer = model.mixers[kind]
    context = np.full(len(ones), min(place, 7) * 8 + t)
    if not learn:
        odds, side, power = model.worked_out()
        spoken = [(odds[k][s], side[k][s].astype(np.int64)) for k, s in enumerate(slots)]
        total = power[0][slots[0]]
        if exact is not None:
            own = _spoken(*(e.astype(np.float64) for e in exact))
            spoken[0] = tuple(np.where(use, e, h) for e, h in zip(own, spoken[0], strict=True))
            total = np.where(use, _powers(exact[0] + exact[1]), total)
        return mixer.chance(*_inputs(spoken, total, t, mixer.histories), context)
    some = np.flatnonzero(zeros), np.flatnonzero(ones)
    at, bit = np.concatenate(some), np.repeat([0, 1], [len(v) for v in some])
    n = np.concatenate([zeros[some[0]], ones[some[1]]]).astype(np.float64)
    own = (1 - bit).astype(np.float32), bit.astype(np.float32)
    x = np.empty((len(slots), len(at)), np.float32)
    for k, s in enumerate(slots):
        if k or exact is None or not use.all():
            n0, n1 = model.counts(k, s[at])
        if k == 0 and exact is not None:
            n0, n1 = (e[at] if use.all() else np.where(use[at], e[at], h) for e, h in zip(exact, (n0, n1) if not use.all() else exact, strict=True))
        # the occurrence itself does not count
        n0, n1 = np.maximum(n0 - own[0], 0), np.maximum(n1 - own[1], 0)
        two = (n0 > 0) & (n1 > 0)
        x[k] = np.log((n1 + 0.4) / (n0 + 0.4))
        lone = np.flatnonzero(~two)
        level, side = _levels((n0 + n1)[lone]), np.sign(n1[lone] - n0[lone])
        # a history fails where the bit is not the one that it has seen
        failed, told = side * (2 * bit[lone] - 1) < 0, side != 0
        mixer.histories[k, t] += np.bincount((level * 2 + failed)[told], n[lone][told], HISTORIES * 2).reshape(-1, 2)
        holds, fails = mixer.histories[k, t].T
        x[k, lone] = side * np.log((holds + 0.5) / (fails + 0.5))[level]
        if k == 0:
            gate = _gate(_powers(n0 + n1), ~two, t)
    mixer.learn(gate, x, np.full(len(at), context[0] if len(context) else 0), bit, n)
    return None


def walk(words: Words, which: np.ndarray, group: np.ndarray, n: np.ndarray, first: int, last: int, model: Model, mode: str, split: np.ndarray | None = None, classes: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Go through bytes ``first`` to ``last - 1`` of items, every distinct branch once; returns log probabilities (mode ``score``).

    An item is word ``which`` in ``group`` (equal for items that share everything before byte ``first``), seen ``n`` times.
    ``classes`` (of short and last word before it) makes items heads. ``split``: from this byte on counts of branches are exact.
    Mode ``count`` fills the model's tables, ``learn`` its mixers.
    """
    heads = classes is not None
    out, live = np.zeros(len(which)), np.arange(len(which))
    for j in range(first, last):
        live = live[words.size[which[live]] >= j]
        if not len(live):
            break
        own, code = which[live], words.byte(which[live], j)
        edges, sample, back = np.unique(group[live] * 256 + code, return_index=True, return_inverse=True)
        total = np.bincount(back, n[live]).astype(np.int64)
        word = own[sample]
        before = [words.byte(word, j - k) for k in (1, 2, 3)]
        sharp = None if split is None else split[live][sample] <= j
        # where all counts are exact, the hashed prefix is not looked at
        so_far = np.zeros(len(word), np.uint64) if sharp is not None and sharp.all() else _prefix(words, word, j)
        place = np.full(len(edges), min(j, 20))
        state = None if not heads else [c[live][sample] for c in classes]
        # what a context needs is worked out once for all bits of the byte; ``count`` of heads fills the class tables alone
        bases = [_base(4 + k, s, so_far) for k, s in enumerate(state)] if heads else []
        bases = [None] * WORD_TABLES + bases if heads and mode == "count" else [_base(1, so_far), before[0] << 8, _base(2, *before[:2]), _base(3, *before), place << 8, *bases]
        lp = np.zeros(len(edges))
        for t in range(8):
            top = edges >> (8 - t)
            start = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
            bit = (edges >> (7 - t)) & 1
            node = ((edges[start] & 255) | 256) >> (8 - t)
            ones, every = np.add.reduceat(total * bit, start), np.add.reduceat(total, start)
            slots = [None if b is None else b[start] | node if k in PLAIN else _slot(b[start], node) for k, b in enumerate(bases)]
            if mode == "count":
                # word tables count the vocabulary, class tables count heads; the prefix table holds what is not exact
                for bit_seen, n_seen in ((0, every - ones), (1, ones)):
                    some = np.flatnonzero(n_seen)
                    for k in range(WORD_TABLES, len(TABLES)) if heads else range(WORD_TABLES):
                        at = some if k or sharp is None else some[~sharp[start][some]]
                        np.add.at(model.tables[k].reshape(-1), slots[k][at] * 2 + bit_seen, n_seen[at])
                continue
            exact = None if sharp is None else (every - ones, ones)
            p = _bits(model, 0 if heads else 1, slots, exact, None if sharp is None else sharp[start], j, t, ones, every - ones, mode == "learn")
            if p is not None:
                of = np.cumsum(np.r_[True, top[1:] != top[:-1]]) - 1
                lp += np.log(np.where(bit == 1, p[of], 1 - p[of]))
        out[live] += lp[back]
        fresh = np.zeros(len(which), np.int64)
        fresh[live] = back
        group, live = fresh, live[words.size[own] > j]
    return out


def _prefix(words: Words, which: np.ndarray, j: int) -> np.ndarray:
    """A checksum of the first ``j`` bytes."""
    h = np.full(len(which), j, np.uint64)
    for k in range(j):
        h = (h ^ words.byte(which, k).astype(np.uint64)) * ODD[1]
        h = h ^ (h >> np.uint64(31))
    return h


def tails(words: Words, n: np.ndarray, model: Model, mode: str) -> np.ndarray:
    """The bytes after the first TRIE ones: contexts of bytes and place alone, all places at once."""
    out = np.zeros(len(n))
    for w in np.flatnonzero(words.size >= TRIE):
        data = np.r_[words.data[words.at[w] + TRIE - 3 : words.at[w] + words.size[w]].astype(np.int64), SPACE]
        for begin in range(3, len(data), 200_000):
            code = data[begin : begin + 200_000]
            b1, b2, b3 = (data[begin - k : begin - k + len(code)] for k in (1, 2, 3))
            many, nothing = np.full(len(code), n[w]), np.zeros(len(code))
            two, three = _base(2, b1, b2), _base(3, b1, b2, b3)
            for t in range(8):
                node, bit = (code | 256) >> (8 - t), (code >> (7 - t)) & 1
                slots = [np.zeros(len(code), np.int64), (b1 << 8) | node, _slot(two, node), _slot(three, node), (20 << 8) | node]
                if mode == "count":
                    for k in range(1, WORD_TABLES):
                        np.add.at(model.tables[k], (slots[k], bit), n[w])
                    continue
                p = _bits(model, 1, slots, (nothing, nothing), np.ones(len(code), bool), TRIE, t, many * bit, many * (1 - bit), mode == "learn")
                if p is not None:
                    out[w] += np.log(np.where(bit == 1, p, 1 - p)).sum()
    return out


def _learns(doc_id: int | None) -> tuple[bool, bool]:
    """(learnt from, held out)"""
    if doc_id is None:
        return False, False
    held = zlib.crc32(str(doc_id).encode()) % 7 == 2
    return not held, held


BLOCK = pa.schema(
    [("block", pa.string()), ("words", pa.list_(pa.binary())), ("trained", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary())]
)
BLOCK_TYPE = "block string, words array<binary>, trained array<long>, doc_id array<long>, held array<boolean>, sizes array<long>, ids binary"


def _split(text: pa.Array) -> pa.ListArray:
    """The lower-cased words of texts, each text closed by an empty one."""
    low = pc.ascii_ltrim_whitespace(pc.ascii_lower(pc.fill_null(text.cast(pa.binary()).view(pa.string()), "")))
    # white space at the end makes the closing empty word; a text without words is that word already
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(pc.binary_length(low), 0), low, pc.binary_join_element_wise(low, " ", "")))


def cut_blocks(docs: DataFrame, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a block: its distinct words with their training counts, its documents, and their words as numbers."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
        """(doc_id, text) of about PIECE_BYTES, of a whole text at least."""
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(ends, PIECE_BYTES + (ends[begin - 1] if begin else 0), "right")))
                yield batch["doc_id"].slice(begin, end - begin), batch["text"].slice(begin, end - begin)
                begin = end

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId(), 0, 0
        keys, sizes, spelled, coded = [], [], [], []

        def block() -> pa.RecordBatch:
            # numbers within a piece become numbers within the block
            own = pa.chunked_array(spelled).dictionary_encode()
            ids = np.concatenate([own.chunk(i).indices.to_numpy()[c] for i, c in enumerate(coded)])
            words, docs, lengths = own.chunk(0).dictionary, pa.concat_arrays(keys), np.concatenate(sizes)
            learnt = np.array([_learns(k) for k in docs.to_pylist()], bool)
            # frequent words get small numbers, which pack well
            order = np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ids = rank[ids]
            trained = np.bincount(ids[np.repeat(learnt[:, 0], lengths)], minlength=len(order))
            listed = [words.take(pa.array(order)).cast(pa.binary()), pa.array(trained), docs, pa.array(learnt[:, 1]), pa.array(lengths)]
            for x in (keys, sizes, spelled, coded):
                x.clear()
            lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in listed]
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{made}"]), *lists, pa.array([pa.compress(ids.astype("<i4").tobytes(), "zstd", asbytes=True)], pa.binary())], schema=BLOCK)

        for ids, text in pieces(batches):
            split = _split(text)
            long = pc.list_value_length(split).to_numpy().astype(np.int64)
            begin = 0
            while begin < len(long):
                # a block ends with the text that fills it
                reach = held + np.cumsum(long[begin:])
                end = min(begin + int(np.searchsorted(reach, tokens)) + 1, len(long))
                own = split.slice(begin, end - begin).flatten().dictionary_encode()
                spelled.append(own.dictionary)
                coded.append(own.indices.to_numpy())
                keys.append(ids.slice(begin, end - begin))
                sizes.append(long[begin:end])
                held, begin = int(reach[end - begin - 1]), end
                if held >= tokens:
                    yield block()
                    made, held = made + 1, 0
        if keys:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, BLOCK_TYPE)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of numbers from 0 on, equal ones as they come, and where in it a new one begins."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")  # 16 bits at a time are sorted by their digits
    for shift in range(16, int(keys.max(initial=0)).bit_length(), 16):
        order = order[np.argsort((keys >> shift).astype(np.uint16)[order], kind="stable")]
    own = keys[order]
    return order, np.r_[True, own[1:] != own[:-1]][: len(own)]


def adapted(lp: np.ndarray, ids: np.ndarray, sizes: np.ndarray, discount: float = DISCOUNT, strength: float = STRENGTH) -> np.ndarray:
    """Log probabilities of tokens after a text's own words so far have been taken into account."""
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(ids))
    own = start * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(own, kind="stable")  # places rise within a word of a text
    fresh = np.r_[True, own[order][1:] != own[order][:-1]][: len(ids)]
    times = np.empty(len(ids), np.int64)
    times[order] = np.arange(len(ids)) - np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
    new = np.cumsum(times == 0) - (times == 0)
    kinds, before = new - new[start], at - start
    with np.errstate(divide="ignore"):
        own = np.log(np.maximum(times - discount, 0))
    return np.logaddexp(own, np.log(strength + discount * kinds) + lp) - np.log(before + strength)


def _ids(packed: bytes, sizes: np.ndarray) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 4 * int(sizes.sum()), "zstd", asbytes=True), "<i4")


def heads_of(words: Words, ids: np.ndarray, sizes: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct (class of short word, class of last word, head): representative words, classes, counts, and each token's place among them."""
    short_of, last_of = words.classes()
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(ids))
    latest = np.maximum.accumulate(np.where(short_of[ids] > 0, at, -1)) if len(ids) else at
    latest = np.r_[-1, latest[:-1]][: len(ids)]
    short = np.where(latest >= begin, short_of[ids[np.maximum(latest, 0)]], 0)
    last = np.where(at > begin, last_of[ids[np.maximum(at - 1, 0)]], 0)
    every = np.arange(len(words.at))
    head = np.minimum(words.size, HEAD)
    for j in range(HEAD):
        head = head * 256 + words.byte(every, j)
    kinds, own = np.unique(head, return_inverse=True)
    order, fresh = _distinct((short * LAST_CLASSES + last) * len(kinds) + own[ids])
    sample, back = order[fresh], np.empty(len(ids), np.int64)
    back[order] = np.cumsum(fresh) - 1
    n = np.bincount(back, weight, len(sample)).astype(np.int64)
    return ids[sample], short[sample], last[sample], n, back


def _walk_heads(words: Words, got: tuple[np.ndarray, ...], model: Model, mode: str) -> np.ndarray:
    which, short, last, n, _ = got
    return walk(words, which, short * LAST_CLASSES + last, n, 0, HEAD, model, mode, classes=(short, last))


def _teaching(spelled: pa.Array, ids: np.ndarray, docs: list[int | None], sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The heads of a block's training documents."""
    teach = np.array([_learns(k)[0] for k in docs], bool)
    return heads_of(Words(spelled), ids[np.repeat(teach, sizes)], sizes[teach])


def _walk_teaching(table: pa.Table, model: Model, mode: str) -> None:
    """Heads of whole classes (columns state, head, n)."""
    state, n = table["state"].to_numpy().astype(np.int64), table["n"].to_numpy()
    walk(Words(table["head"].combine_chunks()), np.arange(len(n)), state, n, 0, HEAD, model, mode, classes=(state // LAST_CLASSES, state % LAST_CLASSES))


def _walk_words(table: pa.Table, model: Model, mode: str) -> np.ndarray:
    """What follows the heads of whole branches of the vocabulary (columns word, n, stem, cut)."""
    words = Words(table["word"].combine_chunks())
    n, cut = table["n"].to_numpy(), table["cut"].to_numpy().astype(np.int64)
    every = np.arange(len(n))
    if mode == "count":
        walk(words, every, np.zeros(len(n), np.int64), n, 0, TRIE, model, "count", split=cut)
    out = tails(words, n, model, mode)
    if mode == "count":
        return out
    head = words.size * 0
    for j in range(HEAD):
        head = head * 256 + words.byte(every, j)
    far = np.flatnonzero(words.size >= HEAD)
    out[far] += walk(words, far, np.unique(head[far], return_inverse=True)[1], n[far], HEAD, TRIE, model, mode, split=cut[far])
    return out


def vocabulary(blocks: DataFrame) -> DataFrame:
    """(word, n, stem, cut) of all distinct words, whole branches of the trie together and in order."""
    entries = blocks.select(F.explode(F.arrays_zip("words", "trained")).alias("e")).select(F.col("e.words").alias("word"), F.col("e.trained").alias("n"))
    counted = stored(entries.groupBy("word").agg(F.sum("n").alias("n")), "mixlm-words", compression="zstd")
    short_stem = F.expr(f"substring(word, 1, {HEAD})")
    sizes = counted.groupBy(short_stem.alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    # at most one of HOT words is listed
    hot = [bytes(r["stem"]) for r in sizes.where(F.col("n") > HOT).collect()]
    cut = F.when(short_stem.isin(hot), LONG_HEAD).otherwise(HEAD) if hot else F.lit(HEAD)
    parts = max(1, counted.count() // HOT + 1)
    dealt = counted.withColumn("cut", cut.cast("int")).withColumn("stem", F.expr("substring(word, 1, cut)"))
    return stored(dealt.repartition(parts, "stem").sortWithinPartitions("stem", "word"), "mixlm-vocabulary", compression="zstd")


def teaching_heads(blocks: DataFrame) -> DataFrame:
    """(state, head, n) of all distinct heads of training texts: classes of the short and the last word before them, and their bytes."""
    schema = pa.schema([("state", pa.int32()), ("head", pa.binary()), ("n", pa.int64())])

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, sizes, ids, docs in zip(*(batch[c] for c in ("words", "sizes", "ids", "doc_id")), strict=True):
                long = sizes.values.to_numpy()
                which, short, last, n, _ = _teaching(words.values, _ids(ids.as_py(), long), docs.as_py(), long)
                head = pc.binary_slice(words.values, 0, HEAD).take(pa.array(which))
                yield from pa.table([pa.array(short * LAST_CLASSES + last, pa.int32()), head, pa.array(n, pa.int64())], schema=schema).to_batches(max_chunksize=50_000)

    listed = blocks.select("words", "sizes", "ids", "doc_id").mapInArrow(of_blocks, "state int, head binary, n long")
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = listed.repartition(parts, "state", F.expr("substring(head, 1, 1)"))
    counted = dealt.groupBy("state", F.expr("substring(head, 1, 1)").alias("first"), "head").agg(F.sum("n").alias("n"))
    return stored(counted.select("state", "head", "n").sortWithinPartitions("state", "head"), "mixlm-heads", compression="zstd")


def count_tables(heads: DataFrame, vocab: DataFrame) -> np.ndarray:
    """Hashed counts over all training words; a fixed number of slots reaches the driver."""

    def chunks(model: Model, tables: range) -> Iterator[pa.RecordBatch]:
        for t in tables:
            for c in range(0, SLOTS, CHUNK):
                part = model.tables[t, c : c + CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([c], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["t", "c", "data"])

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(np.zeros((len(TABLES), SLOTS, 2), np.int64))
        for table in by_key(batches, ["stem"]):
            _walk_words(table, model, "count")
        yield from chunks(model, range(WORD_TABLES))

    def of_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(np.zeros((len(TABLES), SLOTS, 2), np.int64))
        for table in by_key(batches, ["state"]):
            _walk_teaching(table, model, "count")
        yield from chunks(model, range(WORD_TABLES, len(TABLES)))

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group["data"].to_pylist())
        return pa.table({"t": group["t"][:1], "c": group["c"][:1], "data": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    kind = "t int, c int, data binary"
    parts = vocab.mapInArrow(of_words, kind).unionAll(heads.mapInArrow(of_heads, kind))
    out = np.zeros((len(TABLES), SLOTS, 2), np.float32)
    for r in parts.groupBy("t", "c").applyInArrow(add, kind).toLocalIterator():
        out[r["t"], r["c"] : r["c"] + CHUNK] = np.frombuffer(r["data"], "<f4").reshape(-1, 2)
    return out


_LOADED: dict[str, Model] = {}


def loaded(path: str) -> Model:
    """The model's tables from the shared folder, read and worked out once a worker; its mixers are new."""
    if path not in _LOADED:
        _LOADED.clear()
        with files.reading(path) as src:
            _LOADED[path] = Model(np.frombuffer(src.read(), "<f4").reshape(len(TABLES), SLOTS, 2))
    model = _LOADED[path]
    model.mixers = Model().mixers
    return model


def learn_mixers(heads: DataFrame, vocab: DataFrame, path: str) -> list[tuple]:
    """(kind, what, index, value, weight) over all tasks, learnt from all training words and heads; as many rows as there are weights and map cells."""
    kind = "kind int, what int, at int, value double, weight double"
    schema = pa.schema([("kind", pa.int32()), ("what", pa.int32()), ("at", pa.int32()), ("value", pa.float64()), ("weight", pa.float64())])

    def told(model: Model, which: int) -> Iterator[pa.RecordBatch]:
        if rows := model.mixers[which].rows(which):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for table in by_key(batches, ["stem"]):
            _walk_words(table, model, "learn")
        yield from told(model, 1)

    def of_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for table in by_key(batches, ["state"]):
            _walk_teaching(table, model, "learn")
        yield from told(model, 0)

    rows = vocab.mapInArrow(of_words, kind).unionAll(heads.mapInArrow(of_heads, kind))
    return [tuple(r) for r in rows.groupBy("kind", "what", "at").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight")).orderBy("kind", "what", "at").collect()]


def _settled(path: str, rows: list[tuple]) -> Model:
    model = loaded(path)
    for k, mixer in enumerate(model.mixers):
        mixer.settle([r[1:] for r in rows if r[0] == k])
    return model


def scored_words(vocab: DataFrame, path: str, learnt: list[tuple]) -> DataFrame:
    """(word, n, rest): the log probability of what follows each word's head."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("rest", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _settled(path, learnt)
        for table in by_key(batches, ["stem"]):
            yield from pa.table([table["word"].cast(pa.binary()), table["n"], pa.array(_walk_words(table, model, "score"))], schema=schema).to_batches(max_chunksize=10_000)

    return vocab.mapInArrow(score, "word binary, n long, rest double")


def lm_scores(docs: DataFrame, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row of ``docs``."""
    spark = docs.sparkSession
    blocks = stored(cut_blocks(docs, tokens), "mixlm-blocks", compression="zstd")
    vocab = vocabulary(blocks)
    heads = teaching_heads(blocks)
    n_all, n_words = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    path = f"{new_run_dir(spark, 'mixlm')}/tables.f4"
    with files.writing(path) as out:
        out.write(count_tables(heads, vocab).tobytes())
    learnt = learn_mixers(heads, vocab, path)
    words = scored_words(vocab, path, learnt)
    asked = blocks.select("block", F.posexplode("words").alias("at", "word"))
    answers = asked.join(words, "word").select(F.col("block").alias("asker"), "at", "word", "n", "rest")
    schema = T.StructType().add("doc_id", "long").add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double").add("bits_per_byte", "double")

    def score(key: tuple, block: pa.Table, answer: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        model = _settled(path, learnt)
        # a word of the block has one answer
        order = np.argsort(answer["at"].to_numpy())
        sizes = np.array(row["sizes"], np.int64)
        words, ids = Words(answer["word"].combine_chunks().take(pa.array(order))), _ids(row["ids"], sizes)
        got = heads_of(words, ids, sizes)
        lp = adapted(_walk_heads(words, got, model, "score")[got[4]] + answer["rest"].to_numpy()[order][ids], ids, sizes) / np.log(10)
        n, start = answer["n"].to_numpy()[order], np.cumsum(sizes) - sizes
        score = np.add.reduceat(lp, start)
        octets = np.add.reduceat(words.size[ids] + 1, start)
        return pa.table(
            {
                "doc_id": pa.array(row["doc_id"], pa.int64()),
                "held_out": pa.array(row["held"], pa.bool_()),
                "n_tokens": sizes,
                "n_known": np.add.reduceat((n > 0).astype(np.int64)[ids], start),
                "train_tokens": np.full(len(sizes), n_all),
                "base_score": np.add.reduceat(np.log10((n + 1) / (n_all + n_words + 1))[ids], start),
                "score": score,
                "bits_per_byte": -score * np.log2(10) / octets,
            }
        )

    return blocks.select("block", "doc_id", "held", "sizes", "ids").groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(score, schema)
