"""Exact removal of repeated strings over all documents by run-length indexes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of smaller
order (doc_id, then the text's checksum), or earlier in the same one.

1. Every text is cut into anchors with the strings that hang on them (``anchors``). Of an anchor with the
   same surroundings only the first of a batch travels, the others are known to be repeats.
2. Anchors meet by hash. One that occurs once is dropped: its strings are unique. Of equal surroundings all
   but the first are repeats as a whole. Where an anchor has several surroundings, those are asked for.
3. Documents answer with the bytes. Strings that are there twice by hash are put into run-length indexes
   (``runindex``) of bounded size; streaming them gives the class of each string, and those that are
   not the first place of their class are repeats. The index decides, not the hash.
4. Documents meet their ranges, join them, drop the bytes and report.

Only step 3 holds what different documents write around one anchor in one task: the different
surroundings, each at most 2 * LENGTH bytes; equal ones have met in 2.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` keep all; a null doc_id comes last; rows with
equal doc_id and text are the same document and get the same result; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.anchors import anchors, range_hashes
from watchloom.llm.common import by_key, stored
from watchloom.llm.runindex import RunIndex

LENGTH = 100
BATCH = 3 << 20
SPANS = 1 << 20
BLOCK = 300_000
LAST = (1 << 63) - 1
#: An anchor with its surroundings; seen is 1 for one that another of the same batch precedes.
ANCHOR = np.dtype([("key", "<u8"), ("around", "<u8"), ("order", "<i8"), ("crc", "<u4"), ("lo", "<u4"), ("size", "<u2"), ("seen", "u1")])
RANGE = np.dtype([("order", "<i8"), ("crc", "<u4"), ("lo", "<u4"), ("hi", "<u4")])
ASKED = np.dtype([("key", "<u8"), ("order", "<i8"), ("crc", "<u4"), ("lo", "<u4"), ("hi", "<u4")])
PARTS_SQL = "part int, kind int, data binary"
PARTS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
BODIES_SQL = "part int, head binary, body binary"
BODIES = pa.schema([("part", pa.int32()), ("head", pa.binary()), ("body", pa.binary())])
RANGES, QUESTIONS = 0, 1


def packed(part: np.ndarray, kind: int, records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Records as one binary value for each part."""
    if len(records):
        order = np.argsort(part, kind="stable")
        part, records = part[order], records[order]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        values = [planes(x) for x in np.split(records, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(np.full(len(cuts), kind, np.int32)), pa.array(values, pa.binary())], schema=PARTS)


def planes(records: np.ndarray) -> bytes:
    """Records with the first bytes of all together, then the second ones: small numbers then compress to nothing."""
    return np.ascontiguousarray(np.ascontiguousarray(records).view(np.uint8).reshape(len(records), -1).T).tobytes()


def unpacked(values, kind: np.dtype) -> np.ndarray:
    """All records of some ``planes``."""
    rows = [np.frombuffer(v.as_py(), np.uint8).reshape(kind.itemsize, -1).T for v in values]
    return np.ascontiguousarray(np.concatenate([np.zeros((0, kind.itemsize), np.uint8), *rows])).view(kind).reshape(-1)


def document_part(records: np.ndarray, parts: int) -> np.ndarray:
    return (records["order"] % parts + records["crc"]) % parts


def keyed(docs: DataFrame, parts: int, text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"))
    rows = rows.withColumns({"order": F.coalesce("doc_id", F.lit(LAST)), "crc": F.crc32("body")})
    return rows.withColumn("part", F.pmod(F.pmod("order", F.lit(parts)) + F.col("crc"), F.lit(parts)).cast("int"))


def cut_anchors(rows: DataFrame, parts: int, length: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for b in batches:
            for order, crc, body in zip(b["order"].to_pylist(), b["crc"].to_pylist(), b["body"], strict=True):
                text = body.as_py()
                if len(text) >= length:
                    held.append((order, crc, text))
                    size += len(text)
                if size > BATCH:
                    yield from _anchored(held, parts, length)
                    held, size = [], 0
        if held:
            yield from _anchored(held, parts, length)

    return rows.select("order", "crc", "body").mapInArrow(work, PARTS_SQL)


def _anchored(held: list[tuple[int, int, bytes]], parts: int, length: int) -> Iterator[pa.RecordBatch]:
    held.sort(key=lambda x: x[:2])
    raw = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
    ends = np.cumsum([len(x[2]) for x in held])
    key, _, first, last = anchors(raw, ends, length)
    doc = np.searchsorted(ends, first, side="right")
    begin = np.r_[0, ends[:-1]][doc]
    out = np.zeros(len(key), ANCHOR)
    out["key"], out["around"] = key, range_hashes(raw, first, last + length)
    out["order"], out["crc"] = np.array([x[0] for x in held], np.int64)[doc], np.array([x[1] for x in held], np.uint32)[doc]
    out["lo"], out["size"] = first - begin, last + length - first
    # places rise, so the first of equal ones is the earliest; equal documents are not repeats of each other
    both = out["key"] ^ (out["around"] * np.uint64(3))
    order = np.argsort(both, kind="stable")
    same = np.r_[False, both[order][1:] == both[order][:-1]]
    heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    lead = out[order[heads]]
    later = same & ~((lead["order"] == out["order"][order]) & (lead["crc"] == out["crc"][order]) & (lead["lo"] == out["lo"][order]))
    out["seen"][order] = later
    yield from packed((out["key"] % np.uint64(parts)).astype(np.int64), 0, out)


def meet(found: DataFrame, parts: int) -> DataFrame:
    """Ranges that are repeats (kind RANGES) and surroundings that are asked for (kind QUESTIONS), by document part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, ["part"]):
            all_ = unpacked(table["data"], ANCHOR)
            for own in np.split(all_, _cuts(table, ANCHOR.itemsize)):
                yield from _met(own, parts)

    return found.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(work, PARTS_SQL)


def _cuts(table: pa.Table, width: int) -> np.ndarray:
    """Where the records of one part end and those of the next begin."""
    part = table["part"].to_numpy()
    sizes = np.array([len(x.as_py()) // width for x in table["data"]])
    return np.cumsum(sizes)[:-1][part[1:] != part[:-1]]


def _met(a: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    seen = a["seen"] == 1
    removed = [a[seen]]
    a = a[~seen]
    order = np.argsort(a["key"], kind="stable")
    key = a["key"][order]
    twice = np.zeros(len(key), bool)
    twice[1:] = key[1:] == key[:-1]
    twice[:-1] |= twice[1:]
    a = a[order[twice]]
    if len(a):
        order = np.lexsort((a["lo"], a["crc"], a["order"], a["around"], a["key"]))
        a = a[order]
        new_key = np.r_[True, a["key"][1:] != a["key"][:-1]]
        new = new_key | np.r_[True, a["around"][1:] != a["around"][:-1]]
        head = a[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
        first = (head["order"] == a["order"]) & (head["crc"] == a["crc"]) & (head["lo"] == a["lo"])
        removed.append(a[~first])
        kinds = np.bincount(np.cumsum(new_key) - 1, new)
        asked = a[first & (kinds[np.cumsum(new_key) - 1] > 1)]
        # of equal rows of a document one question is enough
        fresh = np.r_[True, (asked[["key", "order", "crc", "lo"]][1:] != asked[["key", "order", "crc", "lo"]][:-1])] if len(asked) else np.zeros(0, bool)
        yield from _records(asked[fresh], ASKED, QUESTIONS, parts)
    for x in removed:
        yield from _records(x, RANGE, RANGES, parts)


def _records(a: np.ndarray, kind: np.dtype, number: int, parts: int) -> Iterator[pa.RecordBatch]:
    out = np.zeros(len(a), kind)
    for n in kind.names:
        out[n] = a["lo"] + a["size"] if n == "hi" and "size" in a.dtype.names else a[n]
    yield from packed(document_part(out, parts), number, out)


def by_document(records: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    order = np.lexsort((records["lo"], records["crc"], records["order"]))
    records = records[order]
    cuts = np.flatnonzero(np.r_[True, (records["order"][1:] != records["order"][:-1]) | (records["crc"][1:] != records["crc"][:-1])]) if len(records) else []
    return {(int(x["order"][0]), int(x["crc"][0])): x for x in np.split(records, cuts[1:])} if len(records) else {}


def _joined(table: pa.Table, kind: np.dtype) -> np.ndarray:
    return unpacked(table["data"], kind)


def answers(rows: DataFrame, questions: DataFrame, parts: int) -> DataFrame:
    """The asked bytes, packed by the part of their anchor."""

    def work(docs: pa.Table, asked: pa.Table) -> pa.Table:
        wanted, done, heads = by_document(_joined(asked, ASKED)), set(), []
        bodies: list[bytes] = []
        for order, crc, body in zip(docs["order"].to_pylist(), docs["crc"].to_pylist(), docs["body"], strict=True):
            if (order, crc) in wanted and (order, crc) not in done:
                done.add((order, crc))
                text, own = body.as_py(), wanted[order, crc]
                heads.append(own)
                bodies += [text[lo:hi] for lo, hi in zip(own["lo"].tolist(), own["hi"].tolist(), strict=True)]
        if not heads:
            return BODIES.empty_table()
        head = _stacked(heads, ASKED)
        part = (head["key"] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, head = part[order], head[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
        pieces = [(int(part[a]), head[a:b].tobytes(), b"".join(bodies[i] for i in order[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*pieces, strict=True), BODIES, strict=True)], schema=BODIES)

    # all columns, as in ``reported``: the same exchange of the texts then serves both
    return rows.groupBy("part").cogroup(questions.groupBy("part")).applyInArrow(work, BODIES_SQL)


def repeats(bodies: DataFrame, parts: int, length: int) -> DataFrame:
    """Ranges of asked surroundings that the indexes show to be repeats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, ["part"]):
            part = table["part"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
                head = np.frombuffer(b"".join(x.as_py() for x in table["head"][a:b]), ASKED)
                raw = np.frombuffer(b"".join(x.as_py() for x in table["body"][a:b]), np.uint8)
                for own, spans in by_anchor(head, raw):
                    yield from _records(repeated(own, spans, length), RANGE, RANGES, parts)

    return bodies.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(work, PARTS_SQL)


def by_anchor(head: np.ndarray, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole anchors of about SPANS bytes together: equal strings have one anchor, and the windows of a few anchors take little memory."""
    size = (head["hi"] - head["lo"]).astype(np.int64)
    begin = np.cumsum(size) - size
    order = np.argsort(head["key"], kind="stable")
    key, before = head["key"][order], np.cumsum(size[order]) - size[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    block = before[first] // SPANS
    cuts = first[np.r_[True, block[1:] != block[:-1]]].tolist()
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        own = order[a:b]
        n = size[own]
        yield head[own], raw[np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def repeated(head: np.ndarray, raw: np.ndarray, length: int) -> np.ndarray:
    """ASKED records narrowed to the ranges that are repeats among ``head``."""
    size = (head["hi"] - head["lo"]).astype(np.int64)
    begin = np.cumsum(size) - size
    # spans whose every string is there more than once by hash
    windows = size - length + 1
    owner = np.repeat(np.arange(len(head)), windows)
    start = np.repeat(begin - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    hashes = range_hashes(raw, start, start + length)
    order = np.argsort(hashes)
    ordered = hashes[order]
    same = np.zeros(len(order), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    same[:-1] |= same[1:]
    twice = np.zeros(len(order), bool)
    twice[order] = same
    at = np.flatnonzero(twice)
    if not len(at):
        return np.zeros(0, ASKED)
    new = np.r_[True, (np.diff(at) > 1) | (owner[at][1:] != owner[at][:-1])]
    first, last = at[new], at[np.r_[np.flatnonzero(new)[1:], len(at)] - 1]
    span = np.zeros(len(first), ASKED)
    for n in ("key", "order", "crc"):
        span[n] = head[n][owner[first]]
    shift = head["lo"][owner[first]].astype(np.int64) - begin[owner[first]]
    span["lo"], span["hi"] = start[first] + shift, start[last] + length + shift
    raw_lo, raw_hi = start[first], start[last] + length
    # earliest first, so that the first place of a class is its earliest
    order = np.lexsort((span["lo"], span["crc"], span["order"], span["key"]))
    span, raw_lo, raw_hi = span[order], raw_lo[order], raw_hi[order]
    # a span like an earlier one of its anchor repeats as a whole
    name = range_hashes(raw, raw_lo, raw_hi) ^ span["key"]
    order = np.argsort(name, kind="stable")
    same = np.r_[False, name[order][1:] == name[order][:-1]]
    lead = span[order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]]
    own = span[order]
    other = same & ~((lead["order"] == own["order"]) & (lead["crc"] == own["crc"]) & (lead["lo"] == own["lo"]))
    out = [own[other]]
    first_one = np.sort(order[~same])
    span, raw_lo, raw_hi = span[first_one], raw_lo[first_one], raw_hi[first_one]
    # blocks end between anchors
    new_key = np.r_[True, span["key"][1:] != span["key"][:-1]]
    group = np.cumsum(new_key) - 1
    members = np.bincount(group)
    alone = members[group] == 1  # nothing left to compare with
    span, raw_lo, raw_hi, group = span[~alone], raw_lo[~alone], raw_hi[~alone], group[~alone]
    filled = np.cumsum(raw_hi - raw_lo + 1)
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    low = 0
    for k, head in enumerate(heads.tolist()):
        end = int(heads[k + 1]) if k + 1 < len(heads) else len(group)
        if filled[end - 1] - (filled[low - 1] if low else 0) >= BLOCK or end == len(group):
            out.append(_streamed(span[low:end], raw, raw_lo[low:end], raw_hi[low:end], length))
            low = end
    return _stacked(out, ASKED)


def _stacked(parts: list[np.ndarray], kind: np.dtype) -> np.ndarray:
    """Concatenation of records as bytes (NumPy compares the fields of structured types one by one)."""
    return np.frombuffer(b"".join(np.ascontiguousarray(x).tobytes() for x in parts), kind)


def _streamed(span: np.ndarray, raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Runs of strings that are not the first place of their class in the index of raw[lo:hi]."""
    size = hi - lo
    flat = raw[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())]
    index = RunIndex(flat, size, length)
    text, start, classes = index.stream()
    late = index.first_place[classes] < index.begin[text] + start
    text, start = text[late], start[late]
    if not len(text):
        return span[:0]
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    cut = np.r_[True, (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)]
    last = np.r_[np.flatnonzero(cut)[1:], len(text)] - 1
    found = span[text[cut]].copy()
    found["hi"] = span["lo"][text[cut]] + start[last] + length
    found["lo"] = span["lo"][text[cut]] + start[cut]
    return found


REPORT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
REPORT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def reported(rows: DataFrame, ranges: DataFrame, with_text: bool) -> DataFrame:
    def work(docs: pa.Table, found: pa.Table) -> pa.Table:
        cuts = by_document(_joined(found, RANGE))
        out: list[tuple] = []
        for doc_id, order, crc, body in zip(docs["doc_id"].to_pylist(), docs["order"].to_pylist(), docs["crc"].to_pylist(), docs["body"], strict=True):
            text, own = body.as_py(), cuts.get((order, crc))
            kept, removed, spans = text, 0, 0
            if own is not None:
                lo, hi = own["lo"].astype(np.int64), np.maximum.accumulate(own["hi"].astype(np.int64))
                new = np.r_[True, lo[1:] > hi[:-1]]
                starts, stops = lo[new].tolist(), hi[np.r_[np.flatnonzero(new)[1:], len(lo)] - 1].tolist()
                kept = b"".join(text[a:b] for a, b in zip([0, *stops], [*starts, len(text)], strict=True))
                removed, spans = len(text) - len(kept), len(starts)
            out.append((doc_id, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        if not out:
            return REPORT.empty_table()
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), REPORT, strict=True)], schema=REPORT)

    return rows.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(work, REPORT_SQL)


def without_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", parts: int | None = None, with_text: bool = True) -> DataFrame:
    """Per document doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes that are kept.

    ``parts`` (the session's shuffle partitions) is into how many pieces anchors and documents are dealt.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs, parts, text)
    met = stored(meet(cut_anchors(rows, parts, length), parts), "repeat-anchors")
    shuffled = rows.repartition(parts, "part")
    bodies = answers(shuffled, met.where(F.col("kind") == QUESTIONS), parts)
    ranges = met.where(F.col("kind") == RANGES).unionAll(repeats(bodies, parts, length))
    out = reported(shuffled, ranges, with_text)
    return out if with_text else out.drop("kept")
