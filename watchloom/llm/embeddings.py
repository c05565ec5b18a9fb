"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

Each table rotates a vector by sign flips and Hadamard transforms, ``FUNCTIONS`` times over; a
function's value is the axis (with sign) nearest to the rotated vector. A vector enters the bucket
of its values and, of the next-best axes, those ``PROBES`` buckets that cost least. Members of a
bucket are compared by cosine in double precision; a pair counts in the first bucket
that both are in. Equal vectors are folded to one with a count before hashing.

Output per row of the input: vec_id, n_links, component_id, kept. Rows link within one label and
one length only.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, or whose
label is null, links with nothing and is its own component; equal rows are links of each other;
a null vec_id is a row that can be linked but never names a component that has other ids; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.llm.buckets import dealt, group_ids, pairs_within, shared_keys, spanning
from watchloom.llm.common import by_key, stored
from watchloom.llm.graph import components

TABLES, FUNCTIONS, PROBES = 10, 3, 4
LEAST = 0.93
SEED = 93
STRIP = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, whose length is a power of two; keeps lengths of vectors."""
    n, shape, h = x.shape[-1], x.shape, 1
    while h < n:
        y = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(shape)
        h *= 2
    return x / np.sqrt(n)


def codes_of(x: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(vectors, tables, probes + 1) bucket codes; the first is the vector's own bucket."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, wide), np.float32)
    padded[:, :d] = x
    out = np.zeros((n, tables, probes + 1), np.int64)
    draw = np.random.default_rng(seed)
    for t in range(tables):
        values, costs = [], []
        for _ in range(functions):
            turned = padded
            for _ in range(3):
                turned = hadamard(turned * draw.choice(np.float32([-1, 1]), wide))
            size = np.abs(turned)
            k = min(probes + 1, wide)
            top = np.argpartition(-size, k - 1, axis=1)[:, :k] if k < wide else np.tile(np.arange(wide), (n, 1))
            height = np.take_along_axis(size, top, 1)
            order = np.argsort(-height, axis=1, kind="stable")
            top, height = np.take_along_axis(top, order, 1), np.take_along_axis(height, order, 1)
            sign = np.take_along_axis(turned, top, 1) < 0
            values.append(top * 2 + sign)
            costs.append((height[:, :1] - height) ** 2)
        code, cost = values[0], costs[0]
        for v, c in zip(values[1:], costs[1:], strict=True):
            code = (code[:, :, None] * (2 * wide) + v[:, None, :]).reshape(n, -1)
            cost = (cost[:, :, None] + c[:, None, :]).reshape(n, -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, : probes + 1]
            code, cost = np.take_along_axis(code, best, 1), np.take_along_axis(cost, best, 1)
        got = code[:, : probes + 1]
        out[:, t, : got.shape[1]] = got
        out[:, t, got.shape[1] :] = got[:, :1]
    return out + np.arange(tables, dtype=np.int64)[None, :, None] * (1 << 40)


def fold_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """Every row with its ``node``: rows of one label and equal usable vectors share it, others have none."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    good = F.col(f"`{label}`").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    plain = F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))  # one zero
    usable = F.coalesce(good, F.lit(False))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.when(usable, plain).alias("vec"), F.when(usable, F.col(f"`{label}`").cast("string")).alias("label"))
    # numbers hold no comma and their count comes first, so a label may hold anything
    text = F.concat_ws(",", F.size("vec").cast("string"), F.col("vec").cast("array<string>"), F.col("label"))
    return rows.withColumn("node", F.when(F.col("vec").isNotNull(), F.unhex(F.md5(text))))


def hashed(nodes: DataFrame) -> DataFrame:
    """(node, label, n, vec, codes) of unit vectors."""
    schema = T.StructType([*nodes.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array(v, dtype=np.float64) for v in batch["vec"].to_pylist()]
            codes: list = [None] * len(lists)
            sizes = np.array([len(v) for v in lists])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = np.stack([lists[i] for i in at])
                x /= np.abs(x).max(1, keepdims=True)  # so that no square over- or underflows
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                for i, c, u in zip(at.tolist(), codes_of(x).reshape(len(at), -1), x, strict=True):
                    codes[i], lists[i] = c, u
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"vec": pa.array(lists, pa.list_(pa.float64())), "codes": pa.array(codes, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return nodes.mapInArrow(work, schema)


def compared(rows: DataFrame, least: float) -> DataFrame:
    """Links inside work items: (node, links) partial counts, and (node, other) edges that connect as they do."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, ["label", "code", "lo", "hi"]):
            yield from compare_groups(t.combine_chunks(), least)

    return dealt(rows, ["label", "code"]).mapInArrow(work, "node binary, links long, other binary")


OUT = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("other", pa.binary())])


def matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(flat), -1)


def compare_groups(t: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    node = np.array(t["node"].to_pylist(), dtype=object)
    label = np.unique(np.array(t["label"].to_pylist()), return_inverse=True)[1]
    code, lo, hi, chunk, n, dim = (t[c].to_numpy() for c in ("code", "lo", "hi", "chunk", "n", "dim"))
    group = group_ids([label, code, lo, hi])
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    small = ends - starts <= 16
    for d in np.unique(dim):
        at = np.flatnonzero(small[group] & (dim == d))
        if len(at):
            i, j = pairs_within(group[at])
            if len(i):
                own = t.take(pa.array(at))
                yield from _links(own, node[at], code[at], lo[at], hi[at], chunk[at], n[at], i, j, least)
    for s, e in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
        for d in np.unique(dim[s:e]):
            at = s + np.flatnonzero(dim[s:e] == d)
            own = t.take(pa.array(at))
            x = matrix(own["vec"], np.float64)
            found_i, found_j = [], []
            for a in range(0, len(at), STRIP):
                i, j = np.nonzero(x[a : a + STRIP] @ x.T >= least - 1e-12)
                keep = i + a < j
                found_i.append(i[keep] + a)
                found_j.append(j[keep])
                if sum(map(len, found_i)) > 500_000:
                    yield from _links(own, node[at], code[at], lo[at], hi[at], chunk[at], n[at], np.concatenate(found_i), np.concatenate(found_j), least)
                    found_i, found_j = [], []
            if found_i:
                yield from _links(own, node[at], code[at], lo[at], hi[at], chunk[at], n[at], np.concatenate(found_i), np.concatenate(found_j), least)


def _links(own: pa.Table, node, code, lo, hi, chunk, n, i: np.ndarray, j: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Of pairs i, j: those that are near, meet here for the first time and lie on both sides of the work item."""
    across = (lo[i] == hi[i]) | (chunk[i] != chunk[j])
    i, j = i[across], j[across]
    x, codes = matrix(own["vec"], np.float64), matrix(own["codes"], np.int64)
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), 50_000):
        p, q = i[a : a + 50_000], j[a : a + 50_000]
        near = np.einsum("ij,ij->i", x[p], x[q]) >= least
        if near.any():
            keep[a : a + 50_000][near] = first_shared(codes, p[near], q[near]) == code[p[near]]
    i, j = i[keep], j[keep]
    if len(i):
        links = np.bincount(i, n[j], minlength=len(node)) + np.bincount(j, n[i], minlength=len(node))
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(node[some], pa.binary()), pa.array(links[some].astype(np.int64)), pa.nulls(len(some), pa.binary())], schema=OUT)
        k = spanning(i, j, len(node))
        yield pa.RecordBatch.from_arrays([pa.array(node[i[k]], pa.binary()), pa.array(np.zeros(len(k), np.int64)), pa.array(node[j[k]], pa.binary())], schema=OUT)


def first_shared(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest code that both of each pair have; codes grow with the table's number."""
    best = np.full(len(i), np.iinfo(np.int64).max)
    width = PROBES + 1
    open_ = np.arange(len(i))
    for t in range(0, codes.shape[1], width):
        if not len(open_):
            break
        a, b = codes[i[open_], t : t + width], codes[j[open_], t : t + width]
        shared = np.where((a[:, :, None] == b[:, None, :]).any(2), a, np.iinfo(np.int64).max).min(1)
        best[open_] = shared
        open_ = open_[shared == np.iinfo(np.int64).max]
    return best


def near_vectors(vectors: DataFrame, least: float = LEAST, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    rows = fold_vectors(vectors, vec_id, embedding, label)
    folded = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    nodes = stored(hashed(folded.withColumn("dim", F.size("vec"))), "vector-codes")
    keys = nodes.select("label", "node", F.explode(F.array_distinct("codes")).alias("code"))
    items = shared_keys(keys, ["label", "code"]).join(nodes.select("node", "vec", "codes", "n", "dim"), "node")
    found = stored(compared(items, least), "vector-links")
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null"), "node", "other")
    smallest = joined.join(nodes.select("node", "least_id"), "node").groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = joined.join(smallest, "component").select("node", "component_id")
    known = nodes.select("node", "n", "least_id").join(counts, "node", "left").join(named, "node", "left")
    known = known.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    linked = rows.select("vec_id", "node").join(known, "node", "left")
    own = F.coalesce("component_id", "vec_id")
    return linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
