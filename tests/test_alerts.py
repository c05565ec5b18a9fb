import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from watchloom.operators import alerts as A

T0 = datetime(2026, 1, 1)


def scored(spark, rows):
    return spark.createDataFrame(rows, "source string, host string, ts timestamp, anomaly_score double, model_flag boolean")


def make_alerts(spark, n=20):
    rows = [(f"a{i:02d}", T0 + timedelta(minutes=i), "d", "HIGH" if i % 5 == 0 else "LOW", float(i), "lb" if i % 2 else "app", "h", "{}") for i in range(n)]
    return spark.createDataFrame(rows, "id string, ts timestamp, detector string, severity string, score double, source string, host string, explanation string")


def test_routing_and_decision(spark):
    df = scored(spark, [("lb", "h", T0, 3.0, False), ("lb", "h", T0, 2.9, False), ("app", "h", T0, 0.1, True), ("gke", "h", T0, 9.0, True), ("nginx", "h", T0, None, None)])
    out = {(r.source, r.anomaly_score): r for r in A.route_and_decide(df, A.routing_table(spark)).collect()}
    assert out[("lb", 3.0)].is_anomaly and not out[("lb", 2.9)].is_anomaly
    assert out[("app", 0.1)].is_anomaly and out[("app", 0.1)].detector == "log-embedding-anomaly"
    gke = out[("gke", 9.0)]
    assert (gke.detector, gke.score, gke.is_anomaly) == ("no-endpoint", 0.0, False)
    assert out[("nginx", None)].score == 0.0


def test_scored_alerts_have_no_low(spark):
    df = scored(spark, [("lb", "a", T0, 5.0, False), ("lb", "b", T0, 0.2, True), ("lb", "c", T0, 1.0, False)])
    out = A.alerts_from_scores(A.route_and_decide(df, A.routing_table(spark))).collect()
    assert sorted((r.host, r.severity) for r in out) == [("a", "HIGH"), ("b", "MEDIUM")]
    assert len({r.id for r in out}) == 2


def test_anomaly_payloads(spark):
    rows = [("x", None, "", "7", None, None), ("", T0, None, None, 3.5, "lb"), (None, T0, "LOW", "bad", 9.0, "lb"), ("y", T0, None, None, None, "lb")]
    df = spark.createDataFrame(rows, "id string, ts timestamp, severity string, score string, value double, source string")
    now = F.lit("2030-01-01").cast("timestamp")
    a, b, c, d = A.alerts_from_anomalies(df, now).collect()
    assert (a.id, a.severity, a.score, a.source, str(a.ts)) == ("x", "HIGH", 7.0, "unknown", "2030-01-01 00:00:00")
    assert (b.severity, b.score, b.detector) == ("MEDIUM", 3.5, "streaming-statistical") and len(b.id) == 32
    assert (c.severity, c.score) == ("LOW", 0.0)
    assert (d.severity, d.score, d.rule, d.explanation) == ("LOW", 0.0, None, "{}")


def test_list_limits_before_or_after_filters(spark):
    al = make_alerts(spark)
    assert [r.id for r in A.list_alerts(al, severity="HIGH", limit=6).collect()] == ["a15"]
    assert [r.id for r in A.list_alerts(al, severity="HIGH", limit=2, pushdown=True).collect()] == ["a15", "a10"]
    since = F.lit(T0 + timedelta(minutes=18))
    assert {r.id for r in A.list_alerts(al, since=since, source="lb").collect()} == {"a19"}
    with pytest.raises(ValueError):
        A.list_alerts(al, limit=1001)
    plan = A.list_alerts(al, limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_get_and_explain(spark):
    al = make_alerts(spark).withColumn("explanation", F.lit(json.dumps({"top_features": [{"name": "f"}], "baseline": {"f": 1}, "observed": {"f": 9}})))
    assert A.get_alert(al, "a03").count() == 1 and A.get_alert(al, "zz").count() == 0
    assert A.get_alerts(al, spark.createDataFrame([("a01",), ("a01",), ("zz",)], "id string")).count() == 1
    rows = A.explain_alert(al, "a03").collect()
    assert sorted(r.similar_id for r in rows) == ["a15", "a17", "a19"]
    assert json.loads(rows[0].baseline) == {"f": 1}
    assert sorted(r.similar_id for r in A.explain_alert(al, "a03", pushdown=True).collect()) == ["a11", "a13", "a15", "a17", "a19"]


def test_similar_alerts_limit_groups_before_the_shuffle(spark):
    plan = A.similar_alerts(make_alerts(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_top_features_and_document(spark):
    from watchloom.schema import FEATURE_COLUMNS

    def row(host, **over):
        return ("lb", host, T0, *[over.get(c, 1.0 if host == "x" else 3.0) for c in FEATURE_COLUMNS])

    schema = "source string, host string, window_end timestamp, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    f = spark.createDataFrame([row("x"), row("y"), row("z", p99_latency=900.0, rate_5xx=50.0)], schema)
    top = A.explain_top_features(f, A.baselines(f), k=2).where("host = 'z'").orderBy("rank").collect()
    assert {r.name for r in top} == {"p99_latency", "rate_5xx"} and [r.rank for r in top] == [1, 2]
    doc = A.explanation_json(A.explain_top_features(f, A.baselines(f), k=2), ["host"]).where("host = 'z'").first().explanation
    assert json.loads(doc)["observed"] == {"p99_latency": 900.0, "rate_5xx": 50.0}


def test_feedback(spark):
    fb = spark.createDataFrame(
        [("a00", "true_positive", T0), ("a00", "false_positive", T0 + timedelta(1)), ("a01", "true_positive", T0), ("a02", "maybe", T0), ("a03", "ignored", T0)],
        "alert_id string, label string, ts timestamp",
    )
    assert A.valid_feedback(fb).count() == 4 and A.rejected_feedback(fb).count() == 1
    p = A.detector_precision(make_alerts(spark), fb).first()
    assert (p.tp, p.fp, p.ignored, p.precision) == (1, 1, 1, 0.5)


def test_health_and_tiles(spark):
    al = make_alerts(spark)
    now = F.lit(T0 + timedelta(minutes=23, seconds=19))
    h = {r.source: r for r in A.source_health(al, now).collect()}
    assert h["lb"].lag_sec == 259 and h["lb"].fresh and h["app"].lag_sec == 319 and not h["app"].fresh
    t = A.console_tiles(al, F.lit(T0 + timedelta(minutes=70))).first()
    assert (t.total, t.high, t.medium, t.detectors) == (9, 1, 0, 1)
    assert tuple(A.console_tiles(al.limit(0), now).first()) == (0, 0, 0, 0)


def test_counters_and_points(spark):
    d = A.route_and_decide(scored(spark, [("lb", "h", T0, 9.0, False), ("lb", "h", T0, 9.0, False), ("gke", "h", T0, 9.0, True)]), A.routing_table(spark))
    assert {(r.source, r.is_anomaly): r.n for r in A.score_counters(d).collect()} == {("lb", "true"): 2, ("gke", "false"): 1}
    assert {r.labels["detector"] for r in A.score_points(d).collect()} == {"iforest-logs", "no-endpoint"}


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "id string, ingest_seq long, v string")
    new = spark.createDataFrame([("a", 2, "y", 1), ("c", 2, "z", 1)], "id string, ingest_seq long, v string, extra int")
    out = A.upsert(old, new)
    assert sorted((r.id, r.v, r.extra) for r in out.collect()) == [("a", "y", 1), ("b", "x", None), ("c", "z", 1)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_required_columns(spark):
    al = make_alerts(spark, 4).withColumn("score", F.when(F.col("id") != "a01", F.col("score")))
    good, bad = A.anomaly_rows(al)
    assert good.count() == 3 and bad.first().id == "a01" and "date" in good.columns


def test_ids_tell_nulls_and_separators_apart(spark):
    from watchloom.functions.columns import stable_id

    rows = [(None, "x", "r"), ("x", None, "r"), ("x", "r", None), ("a|b", "c", ""), ("a", "b|c", ""), ("a\\", "|b|c", ""), ("\\N", "x", "r")]
    ids = [r.i for r in spark.createDataFrame(rows, "a string, b string, c string").select(stable_id("a", "b", "c").alias("i")).collect()]
    assert len(set(ids)) == len(rows)


def test_named_routes_move_no_row(spark):
    df = spark.range(10).select(F.lit("lb").alias("source"), F.lit("h").alias("host"), F.lit(4.0).alias("anomaly_score"), F.lit(True).alias("model_flag"), F.lit(T0).alias("ts"), F.col("id").alias("event_id"))
    routed = A.route_and_decide(df)
    assert "Exchange" not in routed._jdf.queryExecution().executedPlan().toString()
    by_table = A.route_and_decide(df, A.routing_table(spark))
    assert sorted(map(tuple, routed.collect())) == sorted(map(tuple, by_table.select(routed.columns).collect()))
    assert A.alerts_from_scores(routed).select("id").distinct().count() == 10
