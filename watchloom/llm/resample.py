"""Importance resampling towards a target: hashed n-gram counts of raw and target texts weigh documents, Gumbel noise draws.

Separators collapse to one space, and one overlapped regular expression scan gives every span of 1 to
``most`` words between boundaries; the CRC of a span's bytes is its bucket. Documents keep their buckets in a
stored table (16 or 32 bits a feature), so texts are scanned once. Bucket counts are added up per task
and then over all, which leaves ``buckets`` rows; only those reach the driver, as the gains.

The draw sorts by (score, doc_id) into range partitions, which are written; a row's rank is its place in its
partition after a prefix sum over partition sizes. Rows that share both keys are spread by their place in
the stored table, so no group has to stay in one task.

Defined cases: a null text has no words, no features and weight 0; a null doc_id is drawn by the
hash of ``7:`` alone and comes after other ids in ties; equal rows share every value but the rank; an empty table
gives an empty result; with an empty target or corpus its counts are 0; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchloom.llm.common import stored

BUCKETS = 10_000
MOST_WORDS = 2
LEAST_WORDS = 20
SHARE = (25, 100)
SEED = 7
# texts from so many bytes on are scanned match by match, to bound memory
AT_ONCE = 4_000_000
# digits, lower-case letters and everything beyond ASCII are word bytes; A-Z fall to a-z
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_GAPS = regex.compile(rb"  +")


def span_patterns(most: int) -> list[regex.Pattern]:
    """For each n, runs of n words after a space and before one, in a text of words with single spaces around them."""
    return [regex.compile(rb" [^ ]++" + rb" [^ ]++" * (n - 1) + rb"(?= )") for n in range(1, most + 1)]


def folded(text: str | None) -> bytes:
    """The text's words in lower case with one space before, between and after them."""
    return _GAPS.sub(b" ", b" " + (text or "").encode().translate(_FOLD) + b" ")


def spans(text: bytes, pattern: regex.Pattern) -> Iterable[bytes]:
    """All runs of words that the pattern has in a folded text, repeats included; each starts with the space before it."""
    if len(text) < AT_ONCE:
        return pattern.findall(text, overlapped=True)
    return (m[0] for m in pattern.finditer(text, overlapped=True))


def feature_buckets(text: str | None, patterns: list[regex.Pattern], buckets: int) -> tuple[int, np.ndarray]:
    """Number of words and the bucket of each feature."""
    words, crc = folded(text), zlib.crc32
    codes = [np.fromiter((crc(x[1:]) for x in spans(words, p)), np.int64) % buckets for p in patterns]
    return len(codes[0]), np.concatenate(codes)


def with_buckets(df: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, features) of a table with doc_id and text; ``features`` are packed bucket numbers."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("features", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = span_patterns(most)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [feature_buckets(t.as_py(), patterns, buckets) for t in part["text"]]
                packed = pa.array([codes.astype(kind).tobytes() for _, codes in got], pa.binary())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([n for n, _ in got], pa.int64()), packed], schema=schema)

    return df.mapInArrow(scan, "doc_id long, n_words long, features binary")


def _codes(packed: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a batch and how many each row has."""
    width = np.dtype(kind).itemsize
    many = np.array([0 if x is None else len(x) // width for x in packed.to_pylist()], np.int64)
    return np.frombuffer(b"".join(x or b"" for x in packed.to_pylist()), kind).astype(np.int64), many


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows lie in each bucket; ``buckets`` rows reach the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_codes(batch["features"], kind)[0], minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], names=["bucket", "n"])

    rows = features.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target and raw shares, floored."""
    buckets, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64
    )


def with_weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a row's features, 0 without any."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, many = _codes(batch["features"], kind)
            before = np.r_[0, np.cumsum(gain[codes])]
            ends = np.cumsum(many)
            total = before[ends] - before[ends - many]
            weight = np.where(many > 0, total // np.maximum(many, 1), 0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_words"], pa.array(many), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel_milli(doc_id: Column, seed: int = SEED) -> Column:
    """Reproducible Gumbel noise in thousandths, floored, from a hash of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def with_ranks(scored: DataFrame, eligible: Column, share: tuple[int, int] = SHARE) -> DataFrame:
    """``scored`` (written rows with score and doc_id) with ``rank`` of the drawn rows: the highest scores, ties to smaller ids."""
    names = scored.columns
    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_tie")]
    dealt = scored.where(eligible).withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # partition number and place in the partition, as they were written
    placed = stored(dealt.select(*names, F.monotonically_increasing_id().alias("_place")), "resample-order")
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_in"))
    # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_base"), F.sum("_in").over(Window.partitionBy(F.lit(0))).alias("_all"))
    rank = F.col("_base") + place + 1
    drawn = F.floor(F.lit(share[0]) * F.col("_all") / F.lit(share[1]))
    ranked = placed.withColumn("_part", part).join(F.broadcast(bases), "_part").select(*names, F.when(rank <= drawn, rank).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS, least: int = LEAST_WORDS, share: tuple[int, int] = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every row of ``docs``."""
    features = stored(with_buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), most, buckets), "resample-features")
    wanted = with_buckets(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), most, buckets)
    weighed = with_weights(features, gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets)))
    scored = stored(weighed.withColumn("score", F.col("weight") + gumbel_milli(F.col("doc_id"), seed)), "resample-scores")
    return with_ranks(scored, F.col("n_words") >= least, share)


def resample_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")
