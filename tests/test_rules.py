import random
import warnings
from datetime import datetime, timedelta

import numpy as np
import pytest
from plain import hits
from pyspark.sql import functions as F

from watchloom.operators.rules import (
    Rule,
    emit,
    evaluate_rules,
    fired_per_record,
    load_rules,
    rule_problems,
    smoothed,
)

START = datetime(2026, 1, 1)


def series(spark, values, metric="m", host="h"):
    rows = [("lb", host, START + timedelta(minutes=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"source string, host string, window_end timestamp, {metric} double")


def fired_at(spark, rule, values):
    out = evaluate_rules(series(spark, values, rule.metric), [rule]).collect()
    return sorted(int((r.ts - START).total_seconds() // 60) for r in out)


def test_limits_are_strict_and_other_operators_mean_below(spark):
    rule = Rule("r", "rate_4xx", "threshold", value=3.5)
    assert fired_at(spark, rule, [3.5, 7.25, -1.0, 3.51]) == [1, 3]
    assert fired_at(spark, Rule("r", "m", "threshold", op=">=", value=3.5), [3.5, 7.25, -1.0]) == [2]


def test_outlier_waits_for_thirty_values(spark):
    rule = Rule("r", "bytes_p99", "zscore", threshold=3.3)
    steady = [float(12 + i % 3) for i in range(64)]
    assert fired_at(spark, rule, [*steady, 900.0]) == [64]
    assert fired_at(spark, rule, [*steady[:28], 900.0]) == [] and fired_at(spark, rule, [*steady[:29], 900.0]) == [29]


def test_zscore_forgets_old_values(spark):
    rule = Rule("r", "m", "zscore", threshold=4.0)
    values = [0.0, 1e6] + [float(i % 7) for i in range(400)] + [50.0]
    assert 402 in fired_at(spark, rule, values)


def test_jumps_in_either_direction(spark):
    rule = Rule("r", "entropy_path", "rate_of_change", threshold_pct=60)
    assert fired_at(spark, rule, [4.0, 6.0, 2.0, 9.0, 9.0]) == [2, 3]
    assert fired_at(spark, Rule("r", "m", "rate_of_change", threshold_pct=101), [0.0, 0.0, 2.5, 2.5]) == [2]  # from 0 to 0 counts as 100 %


def test_ewma_bound_and_firing(spark):
    never = Rule("r", "m", "ewma", alpha=0.3, deviation_sigma=3)
    can = Rule("r", "m", "ewma", alpha=0.05, deviation_sigma=3)
    step = [1.0] * 40 + [100.0]
    assert fired_at(spark, never, step) == []
    assert 40 in fired_at(spark, can, step)
    values = np.array([0.0] * 30 + [1e9])
    assert np.abs(smoothed(values, 0.3)[2]).max() <= 0.3**-0.5 + 1e-9
    first, rest = smoothed(values[:12], 0.3), smoothed(values[12:], 0.3, tuple(x[11] for x in smoothed(values[:12], 0.3)[:2]))
    assert all(np.array_equal(np.concatenate(p), w) for p, w in zip(zip(first, rest, strict=True), smoothed(values, 0.3), strict=True))


def test_ewma_noise_floor(spark):
    rule = Rule("r", "m", "ewma", alpha=0.3, deviation_sigma=1.5)
    noisy = series(spark, [0.1] * 3 + [0.3] + [0.1] * 3)
    loud = evaluate_rules(noisy, [rule], noise_floor=1e-6).count()
    assert loud <= evaluate_rules(noisy, [rule]).count()


def test_unknown_type_never_fires(spark):
    rule = Rule("r", "m", "magic")
    assert fired_at(spark, rule, [1.0, 2.0]) == []
    assert any("unknown type" in p for p in rule_problems([rule]))


def test_shipped_rules():
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        rules = load_rules()
    assert [(r.name, r.metric, r.type, r.severity) for r in rules] == [
        ("error_rate_spike", "rate_5xx", "threshold", "HIGH"),
        ("distinct_ip_burst", "distinct_ips", "threshold", "HIGH"),
        ("latency_z_spike", "p99_latency", "zscore", "MEDIUM"),
        ("auth_fail_burst", "auth_failure_rate", "rate_of_change", "HIGH"),
        ("4xx_creep", "rate_4xx", "ewma", "LOW"),
    ]
    assert any("4xx_creep" in str(w.message) for w in seen)


RULES = [
    Rule("hi", "m", "threshold", value=6),
    Rule("lo", "m", "threshold", op="<", value=-6),
    Rule("z", "m", "zscore", threshold=2.5),
    Rule("roc", "m", "rate_of_change", threshold_pct=300),
    Rule("e1", "m", "ewma", alpha=0.05, deviation_sigma=2.5),
    Rule("e2", "k", "ewma", alpha=0.5, deviation_sigma=1.2),
]


def random_features(seed, n=450):
    rng = random.Random(seed)
    rows = []
    for source, host in (("lb", "a"), ("lb", "b"), ("app", "a")):
        for i in range(n if host == "a" else 40):
            m = rng.choice([None, 0.0, rng.gauss(0, 3), rng.gauss(0, 3), rng.gauss(0, 3)])
            rows.append((source, host, START + timedelta(minutes=i), m, rng.expovariate(1)))
    return rows


def plain_hits(rows):
    want = set()
    for rule in RULES:
        series_of = {}
        for source, host, ts, m, k in sorted(rows, key=lambda r: r[2]):
            if (m if rule.metric == "m" else k) is not None:
                series_of.setdefault((source, host), []).append((ts, m if rule.metric == "m" else k))
        for key, points in series_of.items():
            want |= {(*key, points[i][0], rule.name) for i in hits(rule, [v for _, v in points])}
    return want


def test_all_rules_match_plain_python(spark):
    rows = random_features(11)
    df = spark.createDataFrame(rows, "source string, host string, window_end timestamp, m double, k double")
    got = evaluate_rules(df, RULES)
    assert {(r.source, r.host, r.ts, r.rule) for r in got.collect()} == plain_hits(rows)
    per = fired_per_record(df, got)
    assert per.count() == len(rows)
    assert per.agg(F.sum("n")).first()[0] == got.count()
    assert per.where(F.size("fired") != F.col("n")).count() == 0


def test_threshold_rules_do_not_shuffle(spark):
    df = series(spark, [1.0, 9.0])
    plan = evaluate_rules(df, [RULES[0], RULES[1]])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_emitted_forms(spark):
    forms = emit(evaluate_rules(series(spark, [9.0]), [RULES[0]]))
    assert '"rule":"hi"' in forms["topic"].first().value
    assert forms["log"].first().severity == "MEDIUM"
    point = forms["metric"].first()
    assert point.value == 1 and point.labels == {"rule": "hi", "source": "lb"}


@pytest.mark.parametrize("rules", [[], [Rule("r", "m", "nope")]])
def test_no_usable_rule_gives_an_empty_result(spark, rules):
    assert evaluate_rules(series(spark, [1.0]), rules).count() == 0
