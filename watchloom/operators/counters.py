"""Rates and deltas of cumulative counters and cumulative histograms.

A point holds the running total of its series since the series started. A total that falls
means that the series started anew (a reset): what it shows then was counted since. The growth between two
neighbouring points is spread evenly over the time between them, so that windows which no point falls into, and windows
whose borders lie between points, get their share (the age of a counter within the window). After a silence of more than
``stale`` seconds nothing is known of when the growth came about; it counts in the window of the later point.
The first point of a series says nothing of the time before it and has no growth.

Points of one (series, window) are folded first: neighbours inside a window give the growth inside, and the
first and last point stay. Windows of a series are linked by those, so the second window function sees one row a series and window,
and a busy series is spread over its windows.

Defined cases: points without a time or with a null value (any of them, in a histogram) are left out; points of one instant
count in the order of their values; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.columns import epoch
from watchloom.operators.timeseries import histogram_quantile


def _growth(now: Sequence[Column], before: Sequence[Column]) -> tuple[Column, list[Column]]:
    """Whether the series started anew, and by how much each value grew. All values of a point start anew together."""
    reset = F.lit(False)
    for a, b in zip(now, before, strict=True):
        reset = reset | (a < b)
    return reset, [F.when(reset, a).otherwise(a - b) for a, b in zip(now, before, strict=True)]


def counter_growth(points: DataFrame, series: Sequence[str], seconds: int, values: Sequence[str] = ("value",), stale: int | None = None) -> DataFrame:
    """(series, at, values, resets): growth of each value in each window that any of it falls into.

    ``at`` is the window's start, ``resets`` the number of restarts seen at points of the window.
    """
    series, values = list(series), list(values)
    stale = 10 * seconds if stale is None else stale
    known = points.where(F.col("ts").isNotNull())
    for v in values:
        known = known.where(F.col(v).isNotNull())
    when = epoch("ts")
    rows = known.select(*series, when.alias("_t"), F.floor(when / seconds).alias("_slot"), *[F.col(v).cast("double").alias(v) for v in values])

    # inside a window
    order = Window.partitionBy(*series, "_slot").orderBy("_t", *values)
    reset, grown = _growth([F.col(v) for v in values], [F.lag(v).over(order) for v in values])
    inside = rows.select(*series, "_slot", "_t", *values, F.coalesce(reset, F.lit(False)).alias("_reset"), *[F.coalesce(g, F.lit(0.0)).alias(f"_in_{v}") for v, g in zip(values, grown, strict=True)])
    point = F.struct("_t", *values)
    folded = inside.groupBy(*series, "_slot").agg(
        F.min(point).alias("_first"), F.max(point).alias("_last"), F.count_if("_reset").alias("_resets"), *[F.sum(f"_in_{v}").alias(f"_in_{v}") for v in values]
    )
    # a total that falls within one instant is no reset there, so the last point is the largest of the last instant

    # from the last point of a window to the first of the next one that has points
    chain = Window.partitionBy(*series).orderBy("_slot")
    linked = folded.withColumn("_prev", F.lag("_last").over(chain))
    reset, grown = _growth([F.col(f"_first.{v}") for v in values], [F.col(f"_prev.{v}") for v in values])
    begin, end = F.col("_prev._t"), F.col("_first._t")
    linked = linked.withColumn("_reset", F.coalesce(reset, F.lit(False))).withColumn("_link", F.when(F.col("_prev").isNotNull(), F.array(*grown)))
    whole = F.lit(1.0)
    span = end - begin
    slots = F.sequence(F.floor(begin / seconds), F.col("_slot"))
    part = F.transform(
        slots, lambda s: F.struct(s.alias("slot"), ((F.least(end, (s + 1) * F.lit(float(seconds))) - F.greatest(begin, s * F.lit(float(seconds)))) / span).alias("share"))
    )
    # growth inside the window goes along as a part of its own
    links = F.when(F.col("_link").isNull(), F.array().cast("array<struct<slot:bigint,share:double>>")).when(
        (span > stale) | (span <= 0), F.array(F.struct(F.col("_slot").alias("slot"), whole.alias("share")))
    ).otherwise(part)
    spread = linked.select(*series, F.explode(links).alias("_p"), "_link").select(
        *series, F.col("_p.slot").alias("_slot"), F.lit(0).cast("bigint").alias("_resets"), *[(F.col("_link")[i] * F.col("_p.share")).alias(v) for i, v in enumerate(values)]
    )
    own = linked.select(*series, "_slot", (F.col("_resets") + F.col("_reset").cast("bigint")).alias("_resets"), *[F.col(f"_in_{v}").alias(v) for v in values])
    return (
        own.unionByName(spread)
        .groupBy(*series, "_slot")
        .agg(*[F.sum(v).alias(v) for v in values], F.sum("_resets").alias("resets"))
        .select(*series, F.timestamp_seconds(F.col("_slot") * seconds).alias("at"), *values, "resets")
    )


def align_counter(points: DataFrame, series: Sequence[str], seconds: int, how: str = "rate", value: str = "value", stale: int | None = None) -> DataFrame:
    """(series, at, aligned) of cumulative points: ``delta`` or ``rate`` (per second), to be reduced with ``reduce_series``."""
    per = {"delta": 1.0, "rate": float(seconds)}[how]
    grown = counter_growth(points, series, seconds, [value], stale)
    return grown.select(*series, "at", (F.col(value) / F.lit(per)).alias("aligned"))


def histogram_deltas(points: DataFrame, series: Sequence[str], by: Sequence[str], seconds: int, bounds: Sequence[float], stale: int | None = None) -> DataFrame:
    """(by, at, le_0 …, total, sum): what cumulative histograms (columns le_0 …, total, sum) took in per window, added up over the series of a group."""
    cells = [f"le_{i}" for i in range(len(bounds))]
    grown = counter_growth(points, series, seconds, [*cells, "total", "sum"], stale)
    return grown.groupBy(*by, "at").agg(*[F.sum(c).alias(c) for c in [*cells, "total", "sum"]])


def delta_quantile(points: DataFrame, series: Sequence[str], by: Sequence[str], seconds: int, bounds: Sequence[float], q: float, name: str, stale: int | None = None) -> DataFrame:
    """A quantile of what each window took in, from cumulative histograms; null for a window that took in nothing."""
    rows = histogram_deltas(points, series, by, seconds, bounds, stale)
    return rows.select(*by, "at", histogram_quantile(bounds, q).alias(name), "total")
