"""Stored, mergeable distinct counts: one HyperLogLog sketch a minute, united for any longer span.

Sketches are Spark's (Apache DataSketches) HLL binaries. They are built with partial aggregation before the
shuffle, so a hot host costs one sketch a task, and a stored minute is read instead of its events. With ``lg_k`` bits
the relative standard error of an estimate is 1.04 / sqrt(2 ** lg_k), of a union a little more; ``error_bound`` gives
three of those, and counts below 2 ** lg_k / 16 come out nearly exact.

Defined cases: a null source or host is ``unknown``, as in the features; events without a time are left out; null and empty values are not
counted, and a minute that has nothing else has an estimate of 0; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 12


def error_bound(lg_k: int = LG_K) -> float:
    """Relative error that an estimate of a union stays within (three standard errors)."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def minute_sketches(events: DataFrame, value: str = "src_ip", keys: Sequence[str] = ("source", "host"), seconds: int = 60, lg_k: int = LG_K) -> DataFrame:
    """(keys, at, n, sketch): a sketch of the different values of each key and window of ``seconds``; ``at`` is its start."""
    rows = events.where(F.col("ts").isNotNull()).select(
        *[F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(k) for k in keys], F.window("ts", f"{seconds} seconds")["start"].alias("at"), F.nullif(F.col(value).cast("string"), F.lit("")).alias("_v")
    )
    return rows.groupBy(*keys, "at").agg(F.count("_v").alias("n"), F.hll_sketch_agg("_v", lg_k).alias("sketch"))


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Replace the days that ``sketches`` holds, under ``date=…``."""
    days = sketches.withColumn("date", F.to_date("at"))
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def read_sketches(spark: SparkSession, path: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Stored sketches whose window starts at or after ``since`` and before ``until``; other days are not read."""
    rows = spark.read.parquet(path)
    if since is not None:
        rows = rows.where((F.col("date") >= F.to_date(since)) & (F.col("at") >= since))
    if until is not None:
        rows = rows.where((F.col("date") <= F.to_date(until)) & (F.col("at") < until))
    return rows.drop("date")


def united(sketches: DataFrame, keys: Sequence[str], name: str = "estimate") -> DataFrame:
    """Unite sketches per key: ``sketch`` and its estimate."""
    out = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))
    return out.withColumn(name, F.hll_sketch_estimate("sketch"))


def sliding_distinct(sketches: DataFrame, keys: Sequence[str], seconds: int, slide: int, name: str = "estimate") -> DataFrame:
    """(keys, window_end, estimate): different values in the ``seconds`` before each multiple of ``slide``.

    Both are multiples of the stored window; a stored sketch goes into the ``seconds / slide`` windows that hold it.
    """
    end = F.window("at", f"{seconds} seconds", f"{slide} seconds")["end"]
    return united(sketches.withColumn("window_end", end), [*keys, "window_end"], name).select(*keys, "window_end", name)


def last_distinct(spark: SparkSession, path: str, now: Column, seconds: int, keys: Sequence[str] = ("source", "host"), name: str = "estimate") -> DataFrame:
    """(keys, estimate) over the ``seconds`` before ``now``, from stored sketches alone."""
    since = now - F.make_dt_interval(secs=F.lit(seconds))
    return united(read_sketches(spark, path, since, now), list(keys), name).select(*keys, name)


__all__ = ["error_bound", "last_distinct", "minute_sketches", "read_sketches", "sliding_distinct", "united", "write_sketches"]
