import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from watchloom.operators import evaluate as E

SCHEMA = "is_anomaly int, anomaly_score double"


def data(seed, n=1000):
    rng = random.Random(seed)
    return [(int(rng.random() < 0.1), rng.choice([round(rng.gauss(0, 1), 1), rng.gauss(0, 1)])) for _ in range(n)]


def plain_auc(rows):
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_match_plain_python(spark, seed):
    import numpy as np

    rows = data(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    cut = np.quantile([s for _, s in rows], 0.99)
    tp = sum(1 for y, s in rows if s > cut and y)
    fp = sum(1 for y, s in rows if s > cut and not y)
    fn = sum(1 for y, s in rows if s <= cut and y)
    got = E.f1_at_quantile(df).first()
    assert (got.f1, got.precision, got.recall, got.n) == pytest.approx((2 * tp / (2 * tp + fp + fn), tp / (tp + fp), tp / (tp + fn), 1000))
    top = [y for y, s in rows if s >= cut]
    assert E.precision_at_top(df).first().precision_top1pct == pytest.approx(sum(top) / len(top))
    assert E.roc_auc(df, score="anomaly_score").first().auc == pytest.approx(plain_auc(rows))


def test_ties_at_the_cut(spark):
    df = spark.createDataFrame([(1, 1.0)] * 10, SCHEMA)
    assert E.f1_at_quantile(df).first().f1 == 0.0  # nothing is above the quantile
    assert E.precision_at_top(df).first().precision_top1pct == 1.0  # everything reaches it


def test_empty_and_single_class(spark):
    none = spark.createDataFrame([], SCHEMA)
    got = E.f1_at_quantile(none).first()
    assert (got.f1, got.n, got.note) == (0.0, 0, "nothing to evaluate")
    assert tuple(E.precision_at_top(none).first()) == (0.0, 0)
    assert tuple(E.roc_auc(none, score="anomaly_score").first()) == (0.0, 0)
    assert E.roc_auc(spark.createDataFrame([(1, 1.0), (1, 2.0)], SCHEMA), score="anomaly_score").first().auc == 0.0
    assert tuple(E.roc_auc(none.drop("is_anomaly"), score="anomaly_score").first()) == (0.0, 0)


def test_gate(spark):
    metrics = spark.createDataFrame([("rcf-metrics", "f1", 0.7), ("iforest-logs", "precision_top1pct", 0.79)], "detector string, metric string, value double")
    out = {r.detector: r for r in E.gate(metrics, E.detector_table(spark)).withColumn("text", E.verdict_text()).collect()}
    assert out["rcf-metrics"].passed and out["rcf-metrics"].text.startswith("REGISTERED")
    assert out["iforest-logs"].text == "GATE_FAILED precision_top1pct=0.79 op=>= thr=0.8"
    assert out["lstm-ae-traces"].value == 0.0 and not out["lstm-ae-traces"].passed
    low = E.Detector("d", "loss", 0.5, "daily", "00:00", op="<=")
    assert E.gate(metrics, E.detector_table(spark, [low])).first().passed


def test_registry(spark):
    verdicts = spark.createDataFrame([("d", "f1", 0.9, True), ("e", "f1", 0.1, False)], "detector string, metric string, value double, passed boolean")
    rows = E.register_passed(verdicts, F.lit("p"), F.lit("2026-01-01").cast("timestamp"))
    assert [r.detector for r in rows.collect()] == ["d"]
    reg = spark.createDataFrame([("d", 1, datetime(2026, 1, 1)), ("d", 2, datetime(2026, 1, 2)), ("e", 1, datetime(2026, 1, 1))], "detector string, version int, created timestamp")
    assert sorted((r.detector, r.version) for r in E.served_versions(reg).collect()) == [("d", 2), ("e", 1)]


@pytest.mark.parametrize(
    "now, cadence, at, want",
    [
        ("2026-01-05 01:00:00", "daily", "02:00", "2026-01-04 02:00:00"),
        ("2026-01-05 02:00:00", "daily", "02:00", "2026-01-05 02:00:00"),
        ("2026-01-10 20:29:59", "weekly", "20:30", "2026-01-03 20:30:00"),  # a Saturday
        ("2026-01-10 20:30:00", "weekly", "20:30", "2026-01-10 20:30:00"),
        ("2026-01-12 00:00:00", "weekly", "21:00", "2026-01-10 21:00:00"),
    ],
)
def test_last_fire(spark, now, cadence, at, want):
    df = spark.range(1).select(E.last_fire(F.lit(now).cast("timestamp"), F.lit(cadence), F.lit(at)).alias("t"))
    assert str(df.first().t) == want


def test_retrain_due(spark):
    runs = spark.createDataFrame([("rcf-metrics", datetime(2026, 1, 5, 3)), ("iforest-logs", datetime(2026, 1, 5, 2, 15))], "detector string, finished timestamp")
    due = {r.detector: r.due for r in E.retrain_due(runs, E.detector_table(spark), F.lit("2026-01-05 12:00:00").cast("timestamp")).collect()}
    assert due == {"rcf-metrics": False, "iforest-logs": True, "lstm-ae-traces": True, "log-embedding-anomaly": True}


def test_catalogue_names():
    d = {x.name: x for x in E.DETECTORS}
    assert d["rcf-metrics"].pipeline_name == "rcf-metrics-dev-pipeline" and d["rcf-metrics"].endpoint_name == "rcf-metrics-dev"
    assert d["iforest-logs"].path("models") == "/dev/models/iforest-logs/" and d["iforest-logs"].path("eval") == "/dev/eval/"


def test_input_validation(spark, tmp_path):
    spark.range(150).write.parquet(str(tmp_path / "ok"))
    report = E.validate_input(spark.read.parquet(str(tmp_path / "ok")))
    assert report["n_rows"] == 150 and report["n_files"] >= 1
    with pytest.raises(ValueError, match="at least 100"):
        E.validate_input(spark.read.parquet(str(tmp_path / "ok")).limit(5))
    with pytest.raises(ValueError, match="no input"):
        E.validate_input(spark.createDataFrame([], "id long"))
