import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from watchloom.operators.features import security_features
from watchloom.sources import generators, lake


def write(path, name, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text)


EVENT = json.dumps({"ts": "2026-01-01T00:00:00Z", "source": "lb", "host": "h", "message": "m", "status": 200, "attrs": {"a": {"b": 1}}})


def test_ndjson_scan(spark, tmp_path):
    write(tmp_path / "raw", "a.jsonl", EVENT + "\n\n" + EVENT + "\n")
    write(tmp_path / "raw" / "sub", "b.json", EVENT + "\n")
    write(tmp_path / "raw", "c.txt", "not an event\n")
    rows = lake.read_events(spark, str(tmp_path / "raw")).collect()
    assert len(rows) == 3 and json.loads(rows[0].attrs["a"]) == {"b": 1} and rows[0].latency_ms is None


def test_malformed_lines(spark, tmp_path):
    write(tmp_path / "raw", "a.json", EVENT + "\n{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        lake.read_events(spark, str(tmp_path / "raw")).collect()
    good, bad = lake.split_corrupt(lake.read_events(spark, str(tmp_path / "raw"), strict=False).cache())
    assert good.count() == 1 and [r[0] for r in bad.collect()] == ["{broken"]


def test_partitions_prune_the_scan(spark, tmp_path):
    ev = generators.seed_events(spark, 300)
    lake.write_raw_events(ev, str(tmp_path / "raw"))
    back = lake.read_events(spark, str(tmp_path / "raw"), partitioned=True)
    assert back.count() == 300
    one = back.where("source = 'lb'")
    assert 0 < one.count() < 300
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan


def test_feature_table(spark, tmp_path):
    out = str(tmp_path / "f")
    f = security_features(generators.seed_events(spark, 300))
    assert lake.write_features(f.limit(0), out) is False
    assert lake.write_features(f, out) and lake.write_features(f, out)  # the same days again
    assert lake.read_features(spark, out).count() == f.count()
    spark.createDataFrame([], f.schema).write.parquet(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no features"):
        lake.read_features(spark, str(tmp_path / "none"))


def alert_rows(spark, *rows):
    return spark.createDataFrame(rows, "id string, ts timestamp, detector string, source string, score double, severity string, host string, explanation string")


def test_anomalies_table(spark, tmp_path):
    day = datetime(2026, 1, 1)
    df = alert_rows(spark, ("a", day, "d", "lb", 1.0, "LOW", None, None), ("b", day, "d", "lb", None, "LOW", None, None), ("c", datetime(2026, 1, 2), "d", "lb", 1.0, "LOW", "h", "{}"))
    lake.append_anomalies(df, str(tmp_path / "t"), str(tmp_path / "q"))
    assert lake.read_anomalies(spark, str(tmp_path / "t")).count() == 2
    assert [r.id for r in spark.read.parquet(str(tmp_path / "q")).collect()] == ["b"]
    recent = lake.read_anomalies(spark, str(tmp_path / "t"), "2026-01-02")
    assert [r.id for r in recent.collect()] == ["c"]
    assert "PartitionFilters: [isnotnull(date" in recent._jdf.queryExecution().executedPlan().toString()


def test_alert_store_keeps_the_newest_row(spark, tmp_path):
    store = str(tmp_path / "alerts")
    a = spark.createDataFrame([("a", "x"), ("b", "x")], "id string, v string")
    b = spark.createDataFrame([("a", "y")], "id string, v string")

    def stored():
        return sorted((r.id, r.v) for r in lake.read_alerts(spark, store).collect())

    lake.write_alert_batch(a, store, 0)
    assert lake.latest_snapshot(spark, store) is None and stored() == [("a", "x"), ("b", "x")]
    for _ in range(2):
        lake.write_alert_batch(b, store, 1)
    assert stored() == [("a", "y"), ("b", "x")]
    first = lake.compact_alerts(spark, store)
    assert first.endswith("snapshot=0") and lake.latest_snapshot(spark, store).endswith("snapshot=0")
    assert stored() == [("a", "y"), ("b", "x")]
    lake.write_alert_batch(spark.createDataFrame([("b", "z"), ("c", "z")], "id string, v string"), store, 2)
    assert lake.compact_alerts(spark, store).endswith("snapshot=1")
    assert stored() == [("a", "y"), ("b", "z"), ("c", "z")]


def test_retention(spark):
    df = spark.createDataFrame([("2026-01-01",), ("2026-01-02",), ("2026-01-02",), ("2026-04-01",)], "d string").select(F.to_date("d").alias("date"))
    today = F.lit("2026-04-02").cast("timestamp")
    assert df.where(lake.kept("date", today)).count() == 3  # 90 days back is still kept
    assert [(str(r.date), r.rows) for r in lake.expired_days(df, today).collect()] == [("2026-01-01", 1)]


def test_feedback_and_metrics_files(spark, tmp_path):
    fb = spark.createDataFrame([("a", "ignored"), ("b", "nope")], "alert_id string, label string")
    lake.append_feedback(fb, str(tmp_path / "fb"))
    assert spark.read.parquet(str(tmp_path / "fb")).count() == 1
    lake.write_metrics(spark.createDataFrame([("d", 0.5)], "detector string, f1 double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().f1 == 0.5


def test_seeded_events(spark):
    a = generators.seed_events(spark, 2000)
    assert a.exceptAll(generators.seed_events(spark, 2000)).count() == 0
    s = a.agg(F.avg("latency_ms"), F.stddev("latency_ms"), F.min("latency_ms"), F.min("bytes"), F.max("bytes"), F.count_distinct("host")).first()
    assert 77 < s[0] < 83 and 27 < s[1] < 33 and s[2] >= 1.0 and s[3] >= 200 and s[4] <= 50000 and s[5] == 50
    share = a.where("status = 200").count() / 2000
    assert 0.52 < share < 0.62
    assert {r.source for r in a.select("source").distinct().collect()} == set(generators.SOURCES)


@pytest.mark.parametrize("kind, status", [("ddos", 503), ("brute_force", 401), ("slow_loris", 200)])
def test_attacks_are_labelled(spark, kind, status):
    base = generators.seed_events(spark, 50)
    ts = F.lit("2026-06-20 10:00:00").cast("timestamp")
    mixed = generators.inject_attack(base, generators.attack_like(spark.range(20), "id", ts, kind))
    bad = mixed.where("is_anomaly = 1").collect()
    assert len(bad) == 20 and mixed.count() == 70
    assert {(r.status, r.host, r.message) for r in bad} == {(status, "edge-attack", f"injected-{kind}")}
    with pytest.raises(ValueError):
        generators.attack_like(spark.range(1), "id", ts, "other")
