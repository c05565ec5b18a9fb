"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

Units are words. Punctuation inside a word is dropped and runs of single letters are joined,
so ``i.d.i.o.t`` and ``i d i o t`` are one unit; the kernel compares subsequences of three
characters that lie within five, each weighted by ``DECAY`` for every character skipped, so
inserted characters weaken a match without losing it. k(x, z) = <phi(x), phi(z)> / (n(x) n(z)) with n
fixed by the unit's length.

Labels belong to documents, so training is multi-instance: a toxic document holds at least
one toxic unit. The machine is fitted on all units that set toxic documents apart, then on the best
witnesses of each toxic document against clean units and the hardest of those, in the space of the
landmarks. As the kernel is a sum over subsequences, the fitted machine folds into one weight
per subsequence; scoring is a table look-up and covers every word of every text. A document's
score is the logistic of its highest unit.

Fitting reads at most ``sample`` labelled rows of each class (by hash of the id) and ``units``
different units of each; the rest reads all rows.

Defined cases: a null or empty text scores like one without toxic units; a label that is
null is not read, of several labels of a document the largest holds; without labels of both classes every
score is the share of label 1 (0 without labels); words over 16 characters are scored in
overlapping pieces; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = 64
START, DROPPED = 63, 255
DECAY = 0.6
GAPS = tuple((a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a + b <= 4)
PIECE = 16
TOP = 0x3000
CHUNK = 400_000


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code of each character: 0 white space, DROPPED punctuation, else a letter class."""
    codes = np.full(TOP + 1, DROPPED, np.uint8)
    for point in range(TOP):
        c = chr(point)
        if c.isspace():
            codes[point] = 0
        elif c.isalnum():
            low = c.lower()[0]
            codes[point] = ord(low) - 96 if "a" <= low <= "z" else 27 + int(low) if low.isascii() and low.isdigit() else 37 + ord(low) % 26
    return codes


def letters(text: str) -> np.ndarray:
    """Letter classes of a text between single white spaces and word starts; begins and ends with white space."""
    points = np.frombuffer(f" {text}  ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = letter_table()[np.minimum(points, TOP)]
    if (high := points >= TOP).any():
        codes = np.where(high, 37 + points % 26, codes).astype(np.uint8)
    codes = codes[codes != DROPPED]
    if len(codes) > 4:
        blank = codes == 0
        word = ~blank
        alone = np.zeros(len(codes), bool)  # words of one letter
        alone[1:-1] = word[1:-1] & blank[:-2] & blank[2:]
        between = np.zeros(len(codes), bool)
        between[1:-1] = blank[1:-1] & alone[:-2] & alone[2:]
        codes = codes[~between]
    return codes


@dataclass(frozen=True)
class Pieces:
    codes: np.ndarray
    ids: np.ndarray  # piece of each position, -1 outside
    starts: np.ndarray
    sizes: np.ndarray


def pieces(codes: np.ndarray, shift: int = 0) -> Pieces:
    """Cut words into units of at most PIECE letters; the white space before a word is its start mark."""
    codes = codes.copy()
    blank = codes == 0
    first = np.flatnonzero(blank[:-1] & ~blank[1:])
    codes[first] = START
    inside = codes != 0
    begins = np.zeros(len(codes), bool)
    begins[first] = True
    at = np.arange(len(codes))
    from_start = at - np.maximum.accumulate(np.where(begins, at, 0))
    cuts = begins | (inside & (from_start > 1) & ((from_start - 1 + shift) % PIECE == 0))
    starts = np.flatnonzero(cuts)
    ids = np.where(inside, np.cumsum(cuts) - 1, -1)
    return Pieces(codes, ids, starts, np.bincount(ids[inside], minlength=len(starts)))


@lru_cache(maxsize=1)
def norms() -> np.ndarray:
    """n(x) by number of positions, the start mark included."""
    size = np.arange(PIECE + 3)[:, None]
    span = np.array([a + b for a, b in GAPS])
    weight = DECAY ** (2.0 * (span - 2))
    return np.sqrt((np.maximum(size - span, 0) * weight).sum(1) + 1e-9).astype(np.float32)


def piece_scores(p: Pieces, weights: np.ndarray) -> np.ndarray:
    """Score of every unit without the bias."""
    if not len(p.starts):
        return np.zeros(0, np.float32)
    n, c = len(p.codes), p.codes.astype(np.int32)
    total = np.zeros(n, np.float32)
    for a, b in GAPS:
        if n > a + b:
            m = n - a - b
            key = (c[:m] * LETTERS + c[a : a + m]) * LETTERS + c[a + b :]
            total[:m] += np.where((p.ids[:m] == p.ids[a + b :]) & (p.ids[:m] >= 0), weights[key] * np.float32(DECAY ** (a + b - 2)), 0)
    sums = np.add.reduceat(np.where(p.ids >= 0, total, 0), p.starts)
    return sums / np.maximum(norms()[np.minimum(p.sizes, PIECE + 2)], 1e-3)


def text_parts(text: str) -> Iterator[str]:
    """A long text in parts of bounded size, cut at white space where there is some."""
    at = 0
    while len(text) - at > CHUNK:
        cut = max(text.rfind(" ", at + CHUNK // 2, at + CHUNK), text.rfind("\n", at + CHUNK // 2, at + CHUNK))
        end = cut + 1 if cut >= 0 else at + CHUNK
        yield text[at:end]
        at = end if cut >= 0 else end - PIECE
    yield text[at:]


@dataclass(frozen=True)
class Toxicity:
    """A fitted machine; of fixed size whatever it was fitted on."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """Highest unit score of each text; -1 without units."""
        out = np.full(len(texts), -1.0)
        held: list[np.ndarray] = []
        owner: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            for part in text_parts(text or ""):
                held.append(letters(part))
                owner.append(i)
                size += len(held[-1])
                if size > CHUNK:
                    self._fold(held, owner, out)
                    held, owner, size = [], [], 0
        if held:
            self._fold(held, owner, out)
        return out

    def _fold(self, held: list[np.ndarray], owner: list[int], out: np.ndarray) -> None:
        codes = np.concatenate(held)
        ends = np.cumsum([len(x) for x in held])
        for shift in (0, PIECE // 2):
            p = pieces(codes, shift)
            if shift and not (np.diff(np.append(p.starts, len(codes))) > PIECE // 2).any():
                break
            if len(p.starts):
                doc = np.asarray(owner)[np.searchsorted(ends, p.starts, side="right")]
                np.maximum.at(out, doc, piece_scores(p, self.weights) + self.bias)
            if not shift and (p.sizes <= PIECE - 1).all():
                break

    def probability(self, highest: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * highest + self.offset, -40, 40)))


def unit_set(text: str | None, most: int) -> list[bytes]:
    """Different units of a text as letter classes; the ``most`` with the lowest hash."""
    found: set[bytes] = set()
    for part in text_parts(text or ""):
        p = pieces(letters(part))
        for s, n in zip(p.starts.tolist(), p.sizes.tolist(), strict=True):
            if n > 3:
                found.add(p.codes[s : s + n].tobytes())
    return sorted(found, key=lambda u: (crc32(u), u))[:most]


def features(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence ids and weights of each unit, padded to one width."""
    wide = PIECE + 2
    codes = np.zeros((len(units), wide), np.int32)
    for i, u in enumerate(units):
        row = np.frombuffer(u, np.uint8)[:wide]
        codes[i, : len(row)] = row
    scale = 1 / np.maximum(norms()[(codes != 0).sum(1)], 1e-3)
    ids, weights = [], []
    for a, b in GAPS:
        m = wide - a - b
        last = codes[:, a + b :]
        ids.append((codes[:, :m] * LETTERS + codes[:, a : a + m]) * LETTERS + last)
        weights.append(np.where(last > 0, DECAY ** (a + b - 2), 0) * scale[:, None])
    return np.concatenate(ids, 1), np.concatenate(weights, 1).astype(np.float32)


class Landmarks:
    """Nystroem map: phi(x) = K_zz^(-1/2) k(z, x)."""

    def __init__(self, units: list[bytes]):
        self.ids, self.weights = features(units)
        known = np.unique(self.ids[self.weights > 0])
        self.row = np.zeros(LETTERS**3, np.int32)
        self.row[known] = np.arange(1, len(known) + 1)
        self.table = np.zeros((len(known) + 1, len(units)), np.float32)
        for t in range(self.ids.shape[1]):
            np.add.at(self.table, (self.row[self.ids[:, t]], np.arange(len(units))), self.weights[:, t])
        self.table[0] = 0
        values, vectors = np.linalg.eigh(self.kernel(units).astype(np.float64))
        keep = values > 1e-2
        self.half = vectors[:, keep] / np.sqrt(values[keep])

    def kernel(self, units: list[bytes]) -> np.ndarray:
        ids, weights = features(units)
        rows = self.row[ids]
        out = np.zeros((len(units), self.table.shape[1]), np.float32)
        for t in range(ids.shape[1]):
            out += weights[:, t, None] * self.table[rows[:, t]]
        return out

    def map(self, units: list[bytes]) -> np.ndarray:
        return np.concatenate([self.kernel(units[i : i + 2000]) @ self.half for i in range(0, len(units), 2000)]) if units else np.zeros((0, self.half.shape[1]))

    def folded(self, w: np.ndarray) -> np.ndarray:
        """Weight of each subsequence in the machine with ``w`` over the map."""
        out = np.zeros(LETTERS**3, np.float32)
        np.add.at(out, self.ids, self.weights * (self.half @ w)[:, None])
        return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps over the rows inside the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    hold = np.full(x1.shape[1], ridge)
    hold[-1] = 1e-6
    for _ in range(25):
        inside = y * (x1 @ w) < 1
        a = x1[inside]
        h = (a * cost[inside, None]).T @ a + np.diag(hold)
        new = np.linalg.solve(h, a.T @ (cost[inside] * y[inside]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope and offset of P(y = 1 | x), with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (target - p) - 1e-3 * w)
        size = np.abs(step).max()
        w = w + step * min(1, 2 / max(size, 1e-9))
        if size < 1e-6:
            break
    return float(w[0]), float(w[1])


def log_ratio(a: int, b: int, n_a: int, n_b: int) -> float:
    """Twice the log likelihood ratio of a unit's two document shares."""

    def part(k: int, n: int, p: float) -> float:
        return (k * np.log(p) if k else 0.0) + ((n - k) * np.log(1 - p) if n > k else 0.0)

    p = (a + b) / (n_a + n_b)
    if p >= 1:
        return 0.0
    return 2 * float(part(a, n_a, a / n_a) + part(b, n_b, b / n_b) - part(a, n_a, p) - part(b, n_b, p))


def fit_bags(bags: list[list[bytes]], labels: list[int], landmarks: int = 320, negatives: int = 10_000, rounds: int = 3) -> Toxicity | None:
    """Multi-instance training over documents as sets of units."""
    toxic = [b for b, y in zip(bags, labels, strict=True) if y == 1]
    clean = [b for b, y in zip(bags, labels, strict=True) if y == 0]
    if not toxic or not clean:
        return None
    pos, neg = Counter(u for b in toxic for u in b), Counter(u for b in clean for u in b)
    apart = {u for u, n in pos.items() if not neg[u] or n / len(toxic) > 8 * neg[u] / len(clean)}
    by_hash = lambda us: sorted(us, key=lambda u: (crc32(u), u))
    some_clean = by_hash(neg)[:negatives]
    excess = {u: log_ratio(pos[u], neg[u], len(toxic), len(clean)) for u in apart}
    frequent = sorted(apart, key=lambda u: (-excess[u], crc32(u), u))
    # seeds: units that chance would hardly give once among all units; with little data, the foremost
    sure = [u for u in frequent if excess[u] > 2 * np.log(2.0 * len(pos))]
    seeds = sure if len(sure) >= 5 else frequent[:20]
    chosen = list(dict.fromkeys([*frequent[: landmarks * 2 // 5], *by_hash(apart)[: landmarks // 5], *some_clean[: landmarks * 2 // 5]]))
    if not apart or len(chosen) < 2:
        return None
    space = Landmarks(chosen)
    candidates = [sorted((u for u in b if u in apart), key=lambda u: (-excess[u], crc32(u), u))[:200] for b in toxic]
    witness = Counter({u: pos[u] for u in seeds})
    hard: list[bytes] = []
    every_clean = list(neg)
    weights, bias = np.zeros(LETTERS**3, np.float32), 0.0
    for _ in range(rounds):
        units = sorted(witness)
        rest = list(dict.fromkeys(some_clean + hard))
        x = space.map(units + rest)
        y = np.r_[np.ones(len(units)), -np.ones(len(rest))]
        cost = np.r_[np.array([witness[u] for u in units]), np.ones(len(rest))]
        cost[: len(units)] *= len(rest) / max(cost[: len(units)].sum(), 1e-9)
        w, bias = svm(x, y, cost)
        weights = space.folded(w)
        scored = unit_scores(every_clean, weights)
        hard = [every_clean[i] for i in np.argsort(-scored, kind="stable")[: negatives // 4]]
        again = Counter()
        for c in candidates:
            if c:
                s = unit_scores(c, weights)
                again.update(c[i] for i in np.argsort(-s, kind="stable")[:3] if s[i] + bias > 0)
        witness = again or witness
    highest = np.array([unit_scores(b, weights).max() + bias if b else -1.0 for b in bags])
    slope, offset = logistic(np.maximum(highest, -1.0), np.array(labels))
    return Toxicity(weights, bias, slope, offset)


def unit_scores(units: list[bytes], weights: np.ndarray) -> np.ndarray:
    out = []
    for i in range(0, len(units), 20_000):
        ids, own = features(units[i : i + 20_000])
        out.append((weights[ids] * own).sum(1))
    return np.concatenate(out) if out else np.zeros(0)


def learns(doc_id: Column) -> Column:
    """Rows that may teach: all but every fifth id by checksum."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 2500, units: int = 2000) -> tuple[Toxicity | None, float]:
    """The machine (None without both classes) and the share of label 1 among the rows it learnt from."""
    known = labels.where(F.col("toxic").isin(0, 1) & learns(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(sample)
        picked = part if picked is None else picked.unionAll(part)
    rows = picked.collect()  # at most 2 * sample ids
    chosen = docs.sparkSession.createDataFrame(rows, known.schema)
    schema = pa.schema([("toxic", pa.int32()), ("doc_id", pa.int64()), ("units", pa.list_(pa.binary()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_arrays(
                    [b["toxic"].slice(i, 1).cast(pa.int32()), b["doc_id"].slice(i, 1).cast(pa.int64()), pa.array([unit_set(b["text"][i].as_py(), units)], schema.field("units").type)], schema=schema
                )

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    # of rows with one doc_id the least units teach, so the driver gets at most 2 * sample rows
    units_of = joined.mapInArrow(cut, "toxic int, doc_id long, units array<binary>").groupBy("doc_id", "toxic").agg(F.min("units").alias("units"))
    got = units_of.toArrow().sort_by("doc_id")
    marks = got["toxic"].to_pylist()
    return fit_bags([[bytes(u) for u in x] for x in got["units"].to_pylist()], marks), float(np.mean(marks)) if marks else 0.0


def with_toxicity(df: DataFrame, model: Toxicity | None, base: float = 0.0, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``df`` with a score of 0 to 1 in ``name``; all its other columns are kept."""
    kept = df.select(*[f"`{c}`" for c in df.columns if c != name])
    if model is None:
        return kept.withColumn(name, F.lit(float(base)))
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                p = model.probability(model.highest(part[text].to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*part.schema.names, name])

    return kept.mapInArrow(score, schema)


def without_toxic(docs: DataFrame, model: Toxicity | None, base: float = 0.0, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``least``, with their own columns whatever these are called."""
    own = [f"_{i}" for i in range(len(docs.columns))]
    scored = with_toxicity(docs.toDF(*own), model, base, own[docs.columns.index(text)])
    return scored.where(F.col("toxicity") < least).select(*own).toDF(*docs.columns)


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model, base = fit_toxicity(docs, labels)
    scored = with_toxicity(docs.select("doc_id", "text"), model, base)
    # only the score leaves the worker's batch for the result
    return scored.select(
        "doc_id", (~learns(F.col("doc_id")) & F.col("doc_id").isNotNull()).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )
