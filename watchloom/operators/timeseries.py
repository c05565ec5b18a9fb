"""Metric alignment, cross-series reduction, histograms and sustained conditions.

Points are (series columns, ts, value). Alignment is a grouped aggregate with
map-side combine; later steps see one row per series and window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.columns import epoch, share
from watchloom.functions.ordered import interpolated_quantile, rank_percentile

# Histogram bounds in seconds.
REQUEST_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
QUERY_BOUNDS = (0.001, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0)
JOB_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)


def align(points: DataFrame, series: Sequence[str], seconds: int, how: str, value: str = "value") -> DataFrame:
    """One row per series and window start with ``aligned``: rate, count, mean, sum or max."""
    ways = {
        "rate": F.count(F.lit(1)) / F.lit(float(seconds)),
        "count": F.count(F.lit(1)).cast("double"),
        "mean": F.avg(value),
        "sum": F.sum(value),
        "max": F.max(value),
    }
    return (
        points.withColumn("at", F.window("ts", f"{seconds} seconds")["start"]).groupBy(*series, "at").agg(ways[how].alias("aligned"))
    )


def reduce_series(aligned: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Combine series per window: sum, max, mean, or a percentile such as p95."""
    if how.startswith("p"):
        return interpolated_quantile(aligned, [*by, "at"], "aligned", float(how[1:]) / 100, "reduced")
    ways = {"sum": F.sum, "max": F.max, "mean": F.avg}
    return aligned.groupBy(*by, "at").agg(ways[how]("aligned").alias("reduced"))


def histogram(points: DataFrame, by: Sequence[str], bounds: Sequence[float], value: str = "value") -> DataFrame:
    """Cumulative counts per bound as columns le_0 … le_k-1, with total and sum."""
    return points.groupBy(*by).agg(
        *[F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)],
        F.count(value).alias("total"),
        F.sum(value).alias("sum"),
    )


def histogram_rows(hist: DataFrame, by: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """The same histogram as (labels, le, cumulative) rows, '+Inf' last."""
    cells = [F.struct(F.lit(repr(b)).alias("le"), F.col(f"le_{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("cumulative")))
    return hist.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.le", "c.cumulative")


def histogram_quantile(bounds: Sequence[float], q: float) -> Column:
    """Quantile of a ``histogram`` row: linear inside the bucket, the last bound beyond it."""
    want = F.col("total") * F.lit(float(q))
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low = float(bounds[i - 1]) if i else 0.0
        before = F.col(f"le_{i - 1}") if i else F.lit(0)
        inside = F.col(f"le_{i}") - before
        value = F.lit(low) + F.lit(float(bounds[i]) - low) * (want - before) / F.nullif(inside, F.lit(0))
        out = F.when(F.col(f"le_{i}") >= want, F.coalesce(value, F.lit(low))).otherwise(out)
    return F.when(F.col("total") > 0, out)


def sustained_below(
    points: DataFrame, series: Sequence[str], threshold: float = 0.75, seconds: int = 300, duration: int = 3600, value: str = "value"
) -> DataFrame:
    """Runs of consecutive windows whose mean stays below the threshold long enough.

    A window without points breaks the run. The window function sees one row per
    series and window, so its groups are bounded by the length of the period.
    """
    low = align(points, series, seconds, "mean", value).where(F.col("aligned") < threshold)
    slot = F.floor(epoch("at") / seconds)
    island = slot - F.row_number().over(Window.partitionBy(*series).orderBy("at"))
    return (
        low.withColumn("island", island)
        .groupBy(*series, "island")
        .agg(F.min("at").alias("from"), F.max("at").alias("last"), F.count(F.lit(1)).alias("windows"), F.max("aligned").alias("highest"))
        .where(F.col("windows") * seconds >= duration)
        .select(*series, "from", (F.col("last") + F.expr(f"interval {seconds} seconds")).alias("until"), "windows", "highest")
    )


def any_condition(*firing: DataFrame, series: Sequence[str]) -> DataFrame:
    """OR of several conditions: series for which at least one holds."""
    out = None
    for i, df in enumerate(firing):
        part = df.select(*series, F.lit(i).alias("condition"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*series).agg(F.sort_array(F.collect_set("condition")).alias("conditions"))


def counters(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def gauge_last(points: DataFrame, series: Sequence[str], tie: str, value: str = "value") -> DataFrame:
    """Last value per series; ``tie`` orders points of the same instant."""
    return points.groupBy(*series).agg(F.max_by(value, F.struct("ts", tie)).alias("last_value"), F.max("ts").alias("last_ts"))


def traffic_summary(requests: DataFrame, by: Sequence[str], latency: str = "latency_ms", status: str = "status", q: float = 0.99) -> DataFrame:
    """Requests, p99 response time (rank pick) and failure ratio per group."""
    # one pass: counts per latency, null latency as one cell, hold both the totals and the ranks
    cells = requests.groupBy(*by, latency).agg(F.count(F.lit(1)).alias("_cell"), F.count_if(F.col(status) >= 400).alias("_failed"))
    totals = cells.groupBy(*by).agg(F.sum("_cell").alias("n"), share(F.sum("_failed"), F.sum("_cell")).alias("fail_ratio"))
    return totals.join(rank_percentile(cells, by, latency, q, "p99", "_cell"), list(by), "left")
