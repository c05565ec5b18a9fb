"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Law ``rows``: shard counts differ by one at most; shard and slot follow from a row's
permuted number alone (``shard = p % shards``, ``slot = p div shards``).

Rows are numbered in hash order: equal rows are folded to one with a count, hash buckets
are numbered by a prefix sum over bucket totals and rows inside a bucket by a window. The
bucket table has a fixed number of rows and is the only broadcast.

Defined cases: nulls in any column count as values; equal rows get different numbers and
are interchangeable; an empty table gives an empty result; columns of the input that are
called like an output are replaced. Columns must be groupable (no maps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from watchloom.llm.common import utf8_bytes

BUCKETS = 4096
ROUNDS = 4
WALK = 64
OUTPUTS = ("row_no", "shuffled_no", "shard", "slot")


def number_rows(df: DataFrame, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``row_no`` (0, 1, 2, ... in hash order) and ``n_rows`` (their count)."""
    names = [c for c in df.columns if c not in OUTPUTS]
    parts = [x for c in names for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    folded = (
        df.select(*[f"`{c}`" for c in names])
        .groupBy(*[f"`{c}`" for c in names])
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_h", F.xxhash64(F.lit(seed), *parts))
        .withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    totals = (
        folded.groupBy(F.col("_b").alias("_bucket"))
        .agg(F.sum("_n").alias("_in"))
        .select("_bucket", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_base"), F.sum("_in").over(whole).alias("n_rows"))
    )
    inside = Window.partitionBy("_b").orderBy("_h", *[F.col(f"`{c}`") for c in names]).rowsBetween(Window.unboundedPreceding, -1)
    placed = folded.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return (
        placed.join(F.broadcast(totals), F.col("_b") == F.col("_bucket"))
        .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        .select(*[f"`{c}`" for c in names], (F.col("_base") + F.col("_at") + F.col("_i")).alias("row_no"), "n_rows")
    )


def feistel(number: Column, wide: Column, high: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """One pass of the permutation of 0 .. wide * high - 1, written as (left, right) = (number % wide, number div wide)."""
    whole = number - F.pmod(number, wide)
    state = F.struct(F.pmod(number, wide).alias("l"), (whole / wide).cast("long").alias("r"))

    def turn(now: Column, k: Column) -> Column:
        left = F.pmod(now["l"] + F.pmod(F.xxhash64(F.lit(seed), k, now["r"]), wide), wide)
        right = F.pmod(now["r"] + F.pmod(F.xxhash64(F.lit(seed), k + 1000, left), high), high)
        return F.struct(left.alias("l"), right.alias("r"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, turn)
    return end["r"] * wide + end["l"]


def permuted(number: Column, size: Column, seed: int) -> Column:
    """A permutation of 0 .. size - 1 by cycle walking.

    The domain ``wide * high`` exceeds ``size`` by less than ``wide``, so a walk that leaves the
    range comes back after a step or two; one longer than WALK steps stops the job with an error.
    """
    wide = F.greatest(F.ceil(F.sqrt(size.cast("double"))).cast("long"), F.lit(1).cast("long"))
    high = F.ceil(size.cast("double") / wide).cast("long")
    first = feistel(number, wide, high, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda p, _: F.when(p < size, p).otherwise(feistel(p, wide, high, seed)))
    checked = F.when(walked < size, walked).otherwise(F.raise_error(F.lit("the cycle walk is too long; use another seed")).cast("long"))
    return F.when(first < size, first).otherwise(checked)


def shuffled_shards(df: DataFrame, shards: int = 24, seed: int = 2024) -> DataFrame:
    """``df`` with row_no, shuffled_no, shard and slot; the same rows and seed give the same result."""
    numbered = number_rows(df, seed)
    out = numbered.withColumn("shuffled_no", permuted(F.col("row_no"), F.col("n_rows"), seed))
    return out.withColumns(
        {"shard": F.pmod("shuffled_no", F.lit(shards)).cast("int"), "slot": F.expr(f"shuffled_no div {int(shards)}").cast("long")}
    ).drop("n_rows")


def shard_table(docs: DataFrame, shards: int = 24, seed: int = 2024) -> DataFrame:
    """The narrow result for a documents table: sizes, checksums, law, shard and slot."""
    narrow = docs.select(
        "doc_id", (utf8_bytes(F.col("text")) + 8).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    )
    placed = shuffled_shards(narrow, shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard")
    )
