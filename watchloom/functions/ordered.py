"""Exact order statistics and running totals that never gather one group in one task.

Rows are first folded to (keys, value) counts, so repeated values collapse on the
map side. Values then fall into order-preserving buckets whose totals are small;
only the bucket that holds a wanted rank is looked at value by value.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE = 64  # buckets per octave: at most 2 * 1100 * 64 * 2 of them exist for doubles
FINE = 65536


def value_bucket(value: Column, per_octave: int = COARSE) -> Column:
    """Bucket number that never decreases as the value grows; null becomes 0."""
    v = value.cast("double")
    top = 1100 * per_octave
    size = F.floor(F.log2(F.abs(v)) * F.lit(float(per_octave))) + F.lit(top)
    far = F.lit(3 * top).cast("bigint")
    return F.coalesce(
        F.when(F.isnan(v) | (v == float("inf")), far)
        .when(v == float("-inf"), -far)
        .when(v > 0, size)
        .when(v < 0, -size),
        F.lit(0).cast("bigint"),
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Rows (or the sum of ``weight``) of each value."""
    return df.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))


def rank_targets(buckets: DataFrame, keys: Sequence[str], bucket: str, ranks: dict[str, Column]) -> DataFrame:
    """For each wanted rank: the bucket that holds it and the rank left inside it.

    ``buckets`` has one row per (keys, bucket) with count ``_c``. A rank expression
    may use ``_n``, the group's row count; a null rank selects nothing.
    """
    upto = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    wanted = F.array(*[F.struct(F.lit(name).alias("_rid"), k.cast("bigint").alias("_k")) for name, k in ranks.items()])
    return (
        buckets.withColumn("_upto", F.sum("_c").over(upto))
        .withColumn("_n", F.sum("_c").over(whole))
        .withColumn("_want", F.explode(wanted))
        .where(_holds(F.col("_want._k")))
        .select(*keys, bucket, "_n", F.col("_want._rid").alias("_rid"), _left(F.col("_want._k")).alias("_k"))
    )


def pick_ranked(candidates: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value at rank ``_k`` among ``candidates`` (keys, _rid, _k, _n, value, _c)."""
    upto = Window.partitionBy(*keys, "_rid").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        candidates.withColumn("_upto", F.sum("_c").over(upto)).where(_holds(F.col("_k"))).select(*keys, "_rid", "_n", value)
    )


def _holds(k: Column) -> Column:
    return (k > F.col("_upto") - F.col("_c")) & (k <= F.col("_upto"))


def _left(k: Column) -> Column:
    return k - F.col("_upto") + F.col("_c")


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], weight: str | None = None) -> DataFrame:
    """One row per key: the values at the given 1-based ranks and ``_n``, nulls left out."""
    hist = value_counts(df.where(F.col(value).isNotNull()), keys, value, weight)
    hist = hist.withColumn("_b0", value_bucket(F.col(value))).withColumn("_b1", value_bucket(F.col(value), FINE))
    coarse = rank_targets(hist.groupBy(*keys, "_b0").agg(F.sum("_c").alias("_c")), keys, "_b0", ranks)
    near = hist.join(coarse, [*keys, "_b0"])
    upto = Window.partitionBy(*keys, "_rid").orderBy("_b1").rowsBetween(Window.unboundedPreceding, 0)
    fine = (
        near.groupBy(*keys, "_rid", "_k", "_b1")
        .agg(F.sum("_c").alias("_c"))
        .withColumn("_upto", F.sum("_c").over(upto))
        .where(_holds(F.col("_k")))
        .select(*keys, "_rid", "_b1", _left(F.col("_k")).alias("_k"))
    )
    picked = pick_ranked(near.drop("_k").join(fine, [*keys, "_rid", "_b1"]), keys, value)
    return picked.groupBy(*keys).agg(
        F.max("_n").alias("_n"), *[F.max(F.when(F.col("_rid") == name, F.col(value))).alias(name) for name in ranks]
    )


def low_rank(n: Column, q: float) -> Column:
    """1-based rank of sorted[int(n*q) - 1], clamped to the first value; q counts as the decimal that it is written as."""
    exact = Fraction(str(q))
    times = n.cast("decimal(38,0)") * F.lit(exact.numerator)
    return F.when(n > 0, F.greatest(F.floor(times / F.lit(exact.denominator)).cast("bigint"), F.lit(1)))


def rank_percentile(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str, weight: str | None = None) -> DataFrame:
    return ranked_values(df, keys, value, {name: low_rank(F.col("_n"), q)}, weight).drop("_n")


def interpolated_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str, weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantile over the non-null values, exact at any size."""
    at = (F.col("_n") - 1) * F.lit(float(q))
    ends = ranked_values(df, keys, value, {"_lo": F.floor(at) + 1, "_hi": F.least(F.floor(at) + 2, F.col("_n"))}, weight)
    t = at - F.floor(at)
    gap = F.col("_hi") - F.col("_lo")
    nearer_low = F.col("_lo") + gap * t
    nearer_high = F.col("_hi") - gap * (F.lit(1.0) - t)
    return ends.select(*keys, F.when(t < 0.5, nearer_low).otherwise(nearer_high).alias(name))


def running_before(hist: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """Add ``<s>_before``: the sum of ``s`` over all smaller values of the same key.

    ``hist`` has one row per (keys, value). Totals climb coarse bucket, fine bucket,
    value; each window spans one bucket, so a single hot key is spread over many tasks.
    """
    def before(s: str, part: Sequence[str], order: str) -> Column:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(s).over(w), F.lit(0))

    rows = hist.withColumn("_b0", value_bucket(F.col(value))).withColumn("_b1", value_bucket(F.col(value), FINE))
    fine = rows.groupBy(*keys, "_b0", "_b1").agg(*[F.sum(s).alias(s) for s in sums])
    coarse = fine.groupBy(*keys, "_b0").agg(*[F.sum(s).alias(s) for s in sums])
    coarse = coarse.select(*keys, "_b0", *[before(s, keys, "_b0").alias(f"{s}_c") for s in sums])
    fine = fine.select(*keys, "_b0", "_b1", *[before(s, [*keys, "_b0"], "_b1").alias(f"{s}_f") for s in sums])
    starts = fine.join(coarse, [*keys, "_b0"]).select(
        *keys, "_b0", "_b1", *[(F.col(f"{s}_c") + F.col(f"{s}_f")).alias(f"{s}_start") for s in sums]
    )
    local = rows.select("*", *[before(s, [*keys, "_b0", "_b1"], value).alias(f"{s}_local") for s in sums])
    return local.join(starts, [*keys, "_b0", "_b1"]).select(
        *hist.columns, *[(F.col(f"{s}_start") + F.col(f"{s}_local")).alias(f"{s}_before") for s in sums]
    )
