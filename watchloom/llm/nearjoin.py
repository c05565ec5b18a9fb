"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. Equal texts are one node. MinHash values in bands propose
pairs; a pair counts in its first common band. Its MinHash values are then compared a block at a
time, and it is dropped once the posterior probability (uniform prior) of a similarity of at least ``LEAST``
falls below ``TOLERANCE``. What is left is verified on the shingle sets.

Pairs of sparse buckets are verified by a join. A bucket with more than ``DENSE`` survivors for
each member is verified where its members are: their sets are gathered in work items of bounded
size, which give link counts and connecting edges instead of pairs.

Result: one row per document with its class (smallest doc_id reachable by links), its number of
links (other documents linked directly, equal texts included) and whether it stays.

Defined cases: words are runs of bytes other than space and \\t to \\r, compared as they are; a text of
one to four words is one shingle; a null text or one without words links with nothing, not even its
like; rows with one doc_id and different texts are different documents; a null doc_id
names a class only if all are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.buckets import dealt, group_ids, pairs_within, shared_keys, spanning
from watchloom.llm.common import by_key, stored
from watchloom.llm.graph import components
from watchloom.llm.shingles import minhash, mixed, shingle_hashes
from watchloom.session import option

LEAST = 0.8
BANDS, ROWS = 30, 5
STEP = 30
TOLERANCE = 1e-6
DENSE = 16
BATCH_BYTES = 4 << 20  # of texts or shingle sets that a worker gets at once; rows alone do not bound a batch
SKETCH = "node binary, codes array<long>, sketch binary"


@lru_cache(maxsize=8)
def needed_matches(values: int, step: int, least: float, tolerance: float) -> tuple[tuple[int, int], ...]:
    """(compared, matches needed): with fewer, P(similarity >= least | matches) < tolerance."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(step, values + 1, step):
        need = 0
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[grid >= least].sum() >= tolerance * weight.sum():
                need = m
                break
        out.append((n, need))
    return tuple(out)


def bayes_kept(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Places of the pairs that no comparison has ruled out."""
    open_, matches, done = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    for n, need in needed_matches(sketch.shape[1], STEP, least, TOLERANCE):
        matches[open_] += (sketch[i[open_], done:n] == sketch[j[open_], done:n]).sum(1)
        open_, done = open_[matches[open_] >= need], n
        if not len(open_):
            break
    return open_


def nodes_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and node (128 bits of the text's checksum; none without a text) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))).alias("node"))


def sketched(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, codes of its bands, MinHash values in 16 bits) of each text with words; equal texts give equal rows."""
    schema = pa.schema([("node", pa.binary()), ("codes", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, codes, sketches = [], [], []
            for node, body in zip(batch["node"].to_pylist(), batch["body"].to_pylist(), strict=True):
                shingles = shingle_hashes(body)
                if not len(shingles):
                    continue
                values = minhash(shingles, BANDS * ROWS)
                band = np.zeros(BANDS, np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for column in values.reshape(BANDS, ROWS).T:
                    band = mixed(band ^ column.astype(np.uint64))
                nodes.append(node)
                codes.append(band.view(np.int64))
                sketches.append(values.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(codes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema=schema)

    body = F.col(f"`{text}`").cast("binary")
    return docs.where(body.isNotNull()).select(F.unhex(F.md5(body)).alias("node"), body.alias("body")).mapInArrow(work, SKETCH)


FOUND = pa.schema([("node", pa.binary()), ("other", pa.binary()), ("links", pa.int64()), ("band", pa.int32()), ("code", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("chunk", pa.int32())])
FOUND_SQL = "node binary, other binary, links long, band int, code long, lo int, hi int, chunk int"
KEY = ["band", "code"]


class Members:
    """Columns of some work items as arrays."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        self.node = np.array(t["node"].to_pylist(), dtype=object)
        self.band, self.code, self.lo, self.hi, self.chunk, self.n = (t[c].to_numpy() for c in ("band", "code", "lo", "hi", "chunk", "n"))
        self.codes = t["codes"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        self.sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint16).reshape(len(t), -1)
        self.group = group_ids([self.band, self.code, self.lo, self.hi])
        self.starts = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]])

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of all groups, some at a time: those of small groups together, those of a large one in strips."""
        ends = np.r_[self.starts[1:], len(self.group)]
        small = ends - self.starts <= 32
        at = np.flatnonzero(small[self.group])
        for a in range(0, len(at), 20_000):
            cut = at[a : a + 20_000]
            i, j = pairs_within(self.group[cut])
            yield cut[i], cut[j]
            # pairs of a group that the cut parts
            edge = a + 20_000
            if edge < len(at) and self.group[at[edge - 1]] == self.group[at[edge]]:
                own = at[self.group[at] == self.group[at[edge]]]
                left, right = own[own < at[edge]], own[own >= at[edge]]
                yield np.repeat(left, len(right)), np.tile(right, len(left))
        for s, e in zip(self.starts[~small].tolist(), ends[~small].tolist(), strict=True):
            for a in range(s, e - 1, 128):
                strip = np.arange(a, min(e, a + 128))
                i, j = np.repeat(strip, e - a), np.tile(np.arange(a, e), len(strip))
                yield i[i < j], j[i < j]

    def candidates(self, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that meet here for the first time, from both sides of their work item, and pass the Bayesian test."""
        for i, j in self.batches():
            keep = (self.lo[i] == self.hi[i]) | (self.chunk[i] != self.chunk[j])
            i, j = i[keep], j[keep]
            for a in range(0, len(i), 100_000):
                p, q = i[a : a + 100_000], j[a : a + 100_000]
                first = (self.codes[p] == self.codes[q]).argmax(1) == self.band[p]
                p, q = p[first], q[first]
                kept = bayes_kept(self.sketch, p, q, least)
                if len(kept):
                    yield p[kept], q[kept]


def propose(items: DataFrame, least: float) -> DataFrame:
    """Rows with ``other`` are pairs to verify; rows with ``band`` are members of dense work items."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, [*KEY, "lo", "hi"]):
            m = Members(table)
            sizes = np.bincount(m.group)
            held_i, held_j, kept = [], [], np.zeros(len(sizes), np.int64)
            for i, j in m.candidates(least):
                kept += np.bincount(m.group[i], minlength=len(sizes))
                open_ = kept[m.group[i]] <= DENSE * sizes[m.group[i]]
                held_i.append(i[open_])
                held_j.append(j[open_])
            dense = kept > DENSE * sizes
            if held_i:
                i, j = np.concatenate(held_i), np.concatenate(held_j)
                sparse = ~dense[m.group[i]]
                i, j = i[sparse], j[sparse]
                for a in range(0, len(i), 50_000):
                    p, q = i[a : a + 50_000], j[a : a + 50_000]
                    yield _rows(len(p), node=m.node[p], other=m.node[q])
            at = np.flatnonzero(dense[m.group])
            for a in range(0, len(at), 50_000):
                p = at[a : a + 50_000]
                yield _rows(len(p), node=m.node[p], band=m.band[p], code=m.code[p], lo=m.lo[p], hi=m.hi[p], chunk=m.chunk[p])

    return dealt(items, KEY).mapInArrow(work, FOUND_SQL)


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type) for f in FOUND], schema=FOUND)


def similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of at least ``least``; shingles of a single member need no count."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts[place] > 1
    owner, place = owner[common], (np.cumsum(counts > 1) - 1)[place[common]]
    both = np.zeros(len(i), np.float32)
    width = max(64, 8_000_000 // max(1, len(sets)))
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    used = np.unique(np.concatenate([i, j]))
    row = np.full(len(sets), -1)
    row[used] = np.arange(len(used))
    for low in range(0, int(place.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(place, [low, low + width])
        mark = np.zeros((len(sets), width), np.float32)
        mark[owner[a:b], place[a:b] - low] = 1
        mark = mark[used]
        for s in range(0, len(used), 512):
            block = mark[s : s + 512] @ mark.T
            here = np.flatnonzero((row[i] >= s) & (row[i] < s + 512))
            both[here] += block[row[i[here]] - s, row[j[here]]]
    return both >= least * (sizes[i] + sizes[j] - both) - 1e-6


def verify_dense(items: DataFrame, least: float) -> DataFrame:
    """(node, links, other): counts of verified links, and edges that connect as they do."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, [*KEY, "lo", "hi"]):
            for part in _whole_groups(table):
                m = Members(part)
                sets = [np.array(s, dtype=np.int64) for s in part["shingles"].to_pylist()]
                found = [(i, j) for i, j in m.candidates(least)]
                if not found:
                    continue
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                keep = similar(sets, i, j, least)
                i, j = i[keep], j[keep]
                links = np.bincount(i, m.n[j], minlength=len(m.node)) + np.bincount(j, m.n[i], minlength=len(m.node))
                some = np.flatnonzero(links)
                yield _rows(len(some), node=m.node[some], links=links[some].astype(np.int64))
                k = spanning(i, j, len(m.node))
                yield _rows(len(k), node=m.node[i[k]], other=m.node[j[k]])

    return dealt(items, KEY).mapInArrow(work, FOUND_SQL)


def _whole_groups(table: pa.Table, members: int = 4096) -> Iterator[pa.Table]:
    """The table in runs of whole work items of about ``members`` rows."""
    group = group_ids([table[c].to_numpy() for c in (*KEY, "lo", "hi")])
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist()
    low = 0
    for s in [*starts[1:], len(group)]:
        if s - low >= members or s == len(group):
            yield table.slice(low, s - low)
            low = s


def shingle_sets(docs: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """(node, shingles) of the wanted nodes, from one of the documents that have the text."""
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_hashes(b).view(np.int64) for b in part["body"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["node"], pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    body = F.col(f"`{text}`").cast("binary")
    each = docs.where(body.isNotNull()).select(F.unhex(F.md5(body)).alias("node"), body.alias("body"))
    return each.join(nodes, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(work, "node binary, shingles array<long>")


def stored_by_parts(df: DataFrame, label: str) -> DataFrame:
    """``stored`` for rows whose texts or sets pass through a worker."""
    with option(df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        return stored(df, label)


def classes(docs: DataFrame, least: float = LEAST, text: str = "text") -> DataFrame:
    """One row per different text with words: node, n (rows that have it), least_id, links, component (null alone) and class_id."""
    rows = nodes_of(docs, text)
    known = stored_by_parts(sketched(docs, text).dropDuplicates(["node"]), "sketches")
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least_id"))
    nodes = stored(counts.join(known.select("node"), "node", "left_semi"), "text-nodes")
    keys = known.select("node", F.posexplode("codes").alias("band", "code"))
    members = shared_keys(keys, KEY).join(known, "node").join(nodes.select("node", "n"), "node")
    proposed = stored(propose(members, least), "candidates")
    pairs = proposed.where("other is not null").select("node", "other")
    dense = proposed.where("band is not null").select("node", *KEY, "lo", "hi", "chunk")
    wanted = pairs.select("node").unionAll(pairs.select("other")).unionAll(dense.select("node")).distinct()
    sets = stored_by_parts(shingle_sets(docs, wanted, text), "shingle-sets")
    own, others = sets.select("node", F.col("shingles").alias("s1")), sets.select(F.col("node").alias("other"), F.col("shingles").alias("s2"))
    common = F.size(F.array_intersect("s1", "s2"))
    sparse = pairs.join(own, "node").join(others, "other").where(common >= F.lit(least) * (F.size("s1") + F.size("s2") - common) - 1e-6).select("node", "other")
    sparse = stored(sparse, "verified")
    in_dense = dense.join(known, "node").join(nodes.select("node", "n"), "node").join(sets, "node")
    grouped = stored_by_parts(verify_dense(in_dense, least), "verified")
    edges = sparse.unionAll(grouped.where("other is not null").select("node", "other"))
    sizes = nodes.select(F.col("node").alias("other"), "n")
    each = sparse.unionAll(sparse.select(F.col("other").alias("node"), F.col("node").alias("other")))
    links = each.join(sizes, "other").select("node", F.col("n").alias("links")).unionAll(grouped.where("links is not null").select("node", "links"))
    links = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(edges, "node", "other")
    smallest = joined.join(nodes, "node").groupBy("component").agg(F.min("least_id").alias("class_id"))
    named = joined.join(smallest, "component").select("node", "component", "class_id")
    return nodes.join(links, "node", "left").join(named, "node", "left")


def near_texts(docs: DataFrame, least: float = LEAST, text: str = "text") -> DataFrame:
    known = classes(docs, least, text)
    known = known.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("class_id", "least_id").alias("class_id"))
    out = nodes_of(docs, text).join(known, "node", "left")
    own_class = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", own_class.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("doc_id") == own_class, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, least: float = LEAST, text: str = "text") -> DataFrame:
    """``docs`` with one row of each class, the one of its smallest doc_id (the smallest checksum of those); rows without words stay."""
    known = stored(classes(docs, least, text).select("node", "least_id", F.coalesce("component", "node").alias("component")), "text-classes")
    chosen = known.groupBy("component").agg(F.min_by("node", F.struct(F.coalesce("least_id", F.lit((1 << 63) - 1)), "node")).alias("_first"))
    marked = known.join(chosen, "component").select(F.col("node").alias("_node"), F.col("least_id").alias("_least"), (F.col("node") == F.col("_first")).alias("_chosen"))
    each = docs.withColumn("_own", F.unhex(F.md5(F.col(f"`{text}`").cast("binary")))).join(marked, F.col("_own") == F.col("_node"), "left")
    one = each.where(F.col("_chosen") & F.col("doc_id").eqNullSafe(F.col("_least"))).dropDuplicates(["_own"])
    return one.unionAll(each.where(F.col("_node").isNull())).select(*docs.columns)
