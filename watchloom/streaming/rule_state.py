"""Keyed rule state for streams: per (source, host) the recent values of each metric."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from watchloom.operators.rules import DETECTOR, HISTORY, TINY, WARM_UP, Rule, smoothed

ANOMALY_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("rule", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("detector", T.StringType()),
    ]
)
_VALUE = T.StructType([T.StructField("value", T.DoubleType())])
_EWMA = T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("var", T.DoubleType())])


class RuleProcessor(StatefulProcessor):
    """Applies all rules to the feature rows of one series as they arrive.

    History is kept once per metric however many rules read it: at most HISTORY
    values, plus two numbers for each smoothing factor in use.
    """

    def __init__(self, rules: Sequence[Rule], order: str = "window_end") -> None:
        self.rules = list(rules)
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        past = sorted({r.metric for r in self.rules if r.type in ("zscore", "rate_of_change")})
        smooth = sorted({(r.metric, r.alpha) for r in self.rules if r.type == "ewma"})
        self.past = {m: handle.getListState(f"past_{m}", _VALUE) for m in past}
        self.smooth = {k: handle.getValueState(f"smooth_{k[0]}_{i}", _EWMA) for i, k in enumerate(smooth)}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
        found = [hits for metric in sorted({r.metric for r in self.rules}) for hits in self._hits(metric, batch)]
        parts = [
            pd.DataFrame({"ts": hit[self.order], "rule": r.name, "metric": r.metric, "value": hit[r.metric].astype(float), "source": key[0], "host": key[1], "severity": r.severity, "detector": DETECTOR})
            for r, hit in found
            if len(hit)
        ]
        yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame([], columns=ANOMALY_SCHEMA.fieldNames())

    def _hits(self, metric: str, batch: pd.DataFrame) -> Iterator[tuple[Rule, pd.DataFrame]]:
        """Each rule of the metric with the rows on which it fires; moves the state past the batch."""
        known = batch[batch[metric].notna()]
        new = known[metric].to_numpy(dtype=float)
        past = np.array([row[0] for row in self.past[metric].get()], dtype=float) if metric in self.past else np.zeros(0)
        seen = np.concatenate([past, new])
        z, smooth_z = np.zeros(0), {}
        if metric in self.past and len(new):
            self.past[metric].put([(float(x),) for x in seen[-HISTORY:]])
            z = recent_z(seen, len(new))
        for (name, alpha), state in self.smooth.items():
            if name == metric and len(new):
                mean, var, smooth_z[alpha] = smoothed(new, alpha, tuple(state.get()) if state.exists() else None)
                state.update((float(mean[-1]), float(var[-1])))
        measures = {
            "threshold": lambda r: new - r.value if r.op == ">" else r.value - new,
            "zscore": lambda r: np.abs(z) - r.threshold,
            "rate_of_change": lambda r: changes(seen, len(new)) - r.threshold_pct,
            "ewma": lambda r: np.abs(smooth_z[r.alpha]) - r.deviation_sigma,
        }
        for rule in self.rules:
            if rule.metric == metric and rule.type in measures and len(new):
                yield rule, known[np.nan_to_num(measures[rule.type](rule), nan=-1.0) > 0]

    def close(self) -> None:
        pass


def recent_z(seen: np.ndarray, last: int) -> np.ndarray:
    """z of each of the ``last`` values within the HISTORY values that end with it; NaN below WARM_UP values."""
    windows = sliding_window_view(np.concatenate([np.full(HISTORY - 1, np.nan), seen]), HISTORY)[-last:]
    count = (~np.isnan(windows)).sum(1)
    spread = np.nanstd(windows, axis=1)
    z = (seen[-last:] - np.nanmean(windows, axis=1)) / np.where(spread == 0, TINY, spread)
    return np.where(count >= WARM_UP, z, np.nan)


def changes(seen: np.ndarray, last: int) -> np.ndarray:
    """Per cent by which each of the ``last`` values differs from the one before it; NaN for the very first."""
    before = np.concatenate([[np.nan], seen[:-1]])[-last:]
    before = np.where(before == 0, TINY, before)
    return np.abs((seen[-last:] - before) / before) * 100
