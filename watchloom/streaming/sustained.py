"""Sustained conditions on a stream: windows below a limit, joined to runs by session windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sustained_below(points: DataFrame, series: Sequence[str], threshold: float = 0.75, seconds: int = 300, duration: int = 3600, value: str = "value", delay: str = "10 minutes") -> DataFrame:
    """The runs of the batch operator of this name, each emitted once no later point can belong to it.

    Means are taken in windows with a watermark; a low window is an event of a session that ends when the next window is
    not low. State is one row a series and open window, and one a running session. Points after the watermark, and
    points without a time, are left out.
    """
    mean = points.where(F.col("ts").isNotNull()).withWatermark("ts", delay).groupBy(*series, F.window("ts", f"{seconds} seconds").alias("w")).agg(F.avg(value).alias("aligned"))
    low = mean.where(F.col("aligned") < threshold).withColumn("at", F.window_time("w"))
    # a window time is a microsecond before the window's end, and the next one comes ``seconds`` later
    gap = seconds + 1
    runs = low.groupBy(*series, F.session_window("at", f"{gap} seconds").alias("run")).agg(F.count(F.lit(1)).alias("windows"), F.max("aligned").alias("highest"))
    micro = F.expr("interval 1 microsecond")
    return runs.where(F.col("windows") * seconds >= duration).select(
        *series,
        (F.col("run.start") + micro - F.expr(f"interval {seconds} seconds")).alias("from"),
        (F.col("run.end") + micro - F.expr(f"interval {gap} seconds")).alias("until"),
        "windows",
        "highest",
    )
