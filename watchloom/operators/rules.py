"""Statistical rules over feature series, in batch.

A series is one value per window for one (source, host), so a busy host adds no
more rows to its series than a quiet one: the group size is bounded by the number
of windows in the period, whatever the traffic. Threshold rules need no history
and run without a shuffle.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import accumulate
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.columns import nonzero
from watchloom.schema import TIME_FORMAT

HISTORY = 360  # values kept per series, the current one included
WARM_UP = 30  # values a z-score needs
TINY = 1e-9
DETECTOR = "streaming-statistical"
SERIES = ("source", "host")
TYPES = ("threshold", "zscore", "rate_of_change", "ewma")
SHIPPED = Path(__file__).with_name("rules.yaml")


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    type: str
    severity: str = "MEDIUM"
    op: str = ">"
    value: float = 0.0
    threshold: float = 0.0
    threshold_pct: float = 0.0
    alpha: float = 0.3
    deviation_sigma: float = 3.0

    @classmethod
    def from_dict(cls, raw: dict) -> Rule:
        known = {k: raw[k] for k in cls.__dataclass_fields__ if k in raw}
        for k in ("value", "threshold", "threshold_pct", "alpha", "deviation_sigma"):
            if k in known:
                known[k] = float(known[k])
        return cls(**known)


def load_rules(path: str | Path = SHIPPED) -> list[Rule]:
    import yaml

    rules = [Rule.from_dict(r) for r in yaml.safe_load(Path(path).read_text())["rules"]]
    for problem in rule_problems(rules):
        warnings.warn(problem, stacklevel=2)
    return rules


def rule_problems(rules: Iterable[Rule]) -> list[str]:
    """Configuration that is legal but cannot do what it says."""
    out = []
    for r in rules:
        if r.type not in TYPES:
            out.append(f"{r.name}: unknown type {r.type!r} never fires")
        if r.type == "ewma" and r.deviation_sigma >= 1 / math.sqrt(r.alpha):
            bound = 1 / math.sqrt(r.alpha)
            out.append(f"{r.name}: the variance includes the current deviation, so |z| <= {bound:.3f} and sigma {r.deviation_sigma:g} is never exceeded")
        if r.type == "threshold" and r.op not in (">", "<"):
            out.append(f"{r.name}: op {r.op!r} is read as '<'")
    return out


def long_series(features: DataFrame, metrics: Sequence[str], order: str = "window_end", keys: Sequence[str] = SERIES) -> DataFrame:
    """(keys, order, metric, value): one row per metric value that is neither null nor NaN."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return (
        features.select(*[F.coalesce(F.col(k), F.lit("unknown")).alias(k) for k in keys], order, F.explode(pairs).alias("p"))
        .select(*keys, order, "p.metric", "p.value")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )


def threshold_fires(rule: Rule, value: Column) -> Column:
    return value > rule.value if rule.op == ">" else value < rule.value


def with_zscore(series: DataFrame, part: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """Add ``n`` and ``z`` over the last HISTORY values, the current one included."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(-(HISTORY - 1), 0)
    spread = F.coalesce(nonzero(F.stddev_pop(value).over(w), TINY), F.lit(TINY))
    return series.withColumn("n", F.count(value).over(w)).withColumn("z", (F.col(value) - F.avg(value).over(w)) / spread)


def with_change(series: DataFrame, part: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """Add ``change_pct`` against the value before; null for the first value."""
    prev = nonzero(F.lag(value).over(Window.partitionBy(*part).orderBy(*order)), TINY)
    return series.withColumn("change_pct", F.abs(F.col(value) - prev) / F.abs(prev) * F.lit(100.0))


def smoothed(values: np.ndarray, alpha: float, start: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variance and z after every value of a series; both already include it.

    ``start`` is the last (mean, variance) of what came before. Both are running blends
    of what is seen with what was known, in the order of the series.
    """
    if not len(values):
        return values, values, values
    mean0, var0 = start if start is not None else (values[0], 0.0)

    def blend(seen: np.ndarray, known: float) -> np.ndarray:
        return np.fromiter(accumulate((alpha * seen).tolist(), lambda old, new: new + (1 - alpha) * old, initial=known), float, len(seen) + 1)[1:]

    mean = blend(values, mean0)
    away = values - mean
    var = blend(away * away, var0)
    spread = np.sqrt(var)
    return mean, var, away / np.where(spread == 0, TINY, spread)


def with_ewma(series: DataFrame, part: Sequence[str], order: Sequence[str], alpha: float = 0.3, value: str = "value") -> DataFrame:
    """Add ``ewma_mean``, ``ewma_var`` and ``ewma_z``: a recurrence, so one pass per series."""
    from pyspark.sql import types as T

    extra = ("ewma_mean", "ewma_var", "ewma_z")
    schema = T.StructType(list(series.schema.fields) + [T.StructField(c, T.DoubleType()) for c in extra])
    order = list(order)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(**dict(zip(extra, smoothed(pdf[value].to_numpy(dtype=float), alpha), strict=True)))

    return series.groupBy(*part).applyInPandas(walk, schema)


def evaluate_rules(features: DataFrame, rules: Sequence[Rule], order: str = "window_end", noise_floor: float = 0.0) -> DataFrame:
    """Fired rules as anomaly rows: ts, rule, metric, value, source, host, severity, detector.

    Each kind of rule reads ``features`` on its own, so pass a stored table rather
    than a plan that aggregates the events again.

    ``noise_floor`` is the least absolute deviation an EWMA rule reports; the
    default 0 keeps the compatible behaviour, which can fire on rounding noise.
    """
    part = [*SERIES, "metric"]
    by_type = {t: [r for r in rules if r.type == t] for t in TYPES}
    hits: list[DataFrame] = []

    def metrics(rs: Sequence[Rule]) -> list[str]:
        return sorted({r.metric for r in rs})

    def report(rows: DataFrame, rs: Sequence[Rule], fires) -> None:
        fired = F.array(*[
            F.when((F.col("metric") == r.metric) & fires(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rs
        ])
        hits.append(
            rows.withColumn("hit", F.explode(F.array_compact(fired))).select(
                F.col(order).alias("ts"), F.col("hit.rule").alias("rule"), "metric", "value", *SERIES, F.col("hit.severity").alias("severity"), F.lit(DETECTOR).alias("detector")
            )
        )

    if by_type["threshold"]:
        rs = by_type["threshold"]
        report(long_series(features, metrics(rs), order), rs, lambda r: threshold_fires(r, F.col("value")))
    stepped = by_type["zscore"] + by_type["rate_of_change"]
    if stepped:
        rows = with_change(with_zscore(long_series(features, metrics(stepped), order), part, [order]), part, [order])

        def fires(r: Rule) -> Column:
            if r.type == "zscore":
                return (F.col("n") >= WARM_UP) & (F.abs("z") > r.threshold)
            return F.coalesce(F.col("change_pct") > r.threshold_pct, F.lit(False))

        report(rows, stepped, fires)
    for alpha in sorted({r.alpha for r in by_type["ewma"]}):
        rs = [r for r in by_type["ewma"] if r.alpha == alpha]
        rows = with_ewma(long_series(features, metrics(rs), order), part, [order], alpha)
        loud = F.abs(F.col("value") - F.col("ewma_mean")) >= noise_floor
        report(rows, rs, lambda r: (F.abs("ewma_z") > r.deviation_sigma) & loud)
    if not hits:
        none = F.lit(None)
        return features.where(F.lit(False)).select(
            F.col(order).alias("ts"), none.cast("string").alias("rule"), none.cast("string").alias("metric"), none.cast("double").alias("value"),
            *SERIES, none.cast("string").alias("severity"), none.cast("string").alias("detector"),
        )
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out


def fired_per_record(features: DataFrame, anomalies: DataFrame, order: str = "window_end") -> DataFrame:
    """Every record with the names of the rules it fired and their number (at most all rules)."""
    keys = [*SERIES, order]
    records = features.select(*keys, F.lit(None).cast("string").alias("rule"))
    hits = anomalies.select(*SERIES, F.col("ts").alias(order), "rule")
    return records.unionByName(hits).groupBy(*keys).agg(F.sort_array(F.collect_list("rule")).alias("fired"), F.count("rule").alias("n"))


def emit(anomalies: DataFrame) -> dict[str, DataFrame]:
    """The three forms an anomaly is sent out in: topic message, log row, metric point."""
    body = F.to_json(F.struct("ts", "rule", "metric", "value", *SERIES, "severity", "detector"), {"timestampFormat": TIME_FORMAT})
    return {
        "topic": anomalies.select(F.col("source").alias("key"), body.alias("value")),
        "log": anomalies.select("ts", F.coalesce("severity", F.lit("INFO")).alias("severity"), body.alias("payload")),
        "metric": anomalies.select(
            F.lit("streaming/anomalies").alias("metric_type"),
            F.create_map(F.lit("rule"), F.col("rule"), F.lit("source"), F.coalesce("source", F.lit("unknown"))).alias("labels"),
            F.lit(1).cast("bigint").alias("value"),
            F.date_trunc("second", "ts").alias("end_time"),
        ),
    }
