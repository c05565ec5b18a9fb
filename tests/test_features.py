import random
from datetime import datetime, timedelta

import pytest
from plain import features as plain_features
from pyspark.sql import functions as F

from watchloom.functions.ordered import interpolated_quantile, rank_percentile, running_before, value_bucket
from watchloom.operators.features import (
    column_entropy,
    column_percentile,
    distinct_clients_sketch,
    event_totals,
    feature_matrix,
    security_features,
)
from watchloom.schema import FEATURE_COLUMNS

SCHEMA = "ts timestamp, source string, host string, status int, latency_ms double, bytes bigint, src_ip string, path string"


def random_events(n, seed, hot=0.4):
    rng = random.Random(seed)
    start = datetime(2026, 1, 1)
    rows = []
    for _ in range(n):
        host = "hot" if rng.random() < hot else rng.choice(["a", "b", None])
        rows.append(dict(
            ts=start + timedelta(seconds=rng.randint(0, 1800), microseconds=rng.randint(0, 999999)),
            source=rng.choice(["lb", "app", None]),
            host=host,
            status=rng.choice([None, 200, 200, 301, 401, 403, 404, 499, 500, 503, 599, 600]),
            latency_ms=rng.choice([None, 0.0, 5.0, rng.uniform(0, 500), rng.uniform(0, 5), -1.0]),
            bytes=rng.choice([None, 0, rng.randint(1, 10**6)]),
            src_ip=rng.choice([None, "", "1.1.1.1", f"10.0.0.{rng.randint(0, 9)}"]),
            path=rng.choice([None, "", "/", f"/p{rng.randint(0, 5)}"]),
        ))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


def compare(got, want):
    got = {(r.source, r.host, r.window_end): tuple(r[c] for c in FEATURE_COLUMNS) for r in got.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


@pytest.mark.parametrize("seed", [1, 2])
def test_minute_buckets_match_plain_python(spark, seed):
    rows = random_events(600, seed)
    compare(security_features(frame(spark, rows)), plain_features(rows, 300))


def test_tumbling_windows_match_plain_python(spark):
    rows = random_events(600, 3)
    compare(security_features(frame(spark, rows), 600, "tumbling"), plain_features(rows, 600, minute=False))


def test_sliding_counts_every_window(spark):
    rows = random_events(100, 4)
    out = security_features(frame(spark, rows), 600, "sliding", 300)
    assert out.agg(F.sum(F.col("request_rate") * 600)).first()[0] == pytest.approx(200)


def one_bucket(spark, **cols):
    n = max(len(v) for v in cols.values())
    base = dict(source="lb", host="h", status=None, latency_ms=None, bytes=None, src_ip=None, path=None)
    rows = [dict(ts=datetime(2026, 1, 1, 0, 0, 1), **{**base, **{k: v[i] for k, v in cols.items()}}) for i in range(n)]
    return security_features(frame(spark, rows)).first()


def test_percentile_of_one_two_and_ten_values(spark):
    assert one_bucket(spark, latency_ms=[7.0]).p99_latency == 7.0
    assert one_bucket(spark, latency_ms=[9.0, 7.0]).p99_latency == 7.0
    assert one_bucket(spark, latency_ms=[float(i) for i in range(10, 0, -1)]).p99_latency == 9.0


def test_empty_values_give_zero_and_null_status_counts(spark):
    row = one_bucket(spark, status=[None, 401, None, 500])
    assert (row.p99_latency, row.bytes_p99, row.entropy_path, row.distinct_ips) == (0.0, 0.0, 0.0, 0)
    assert (row.rate_4xx, row.rate_5xx, row.auth_failure_rate) == (0.25, 0.25, 0.25)


def test_zero_latency_and_bytes_count(spark):
    row = one_bucket(spark, latency_ms=[0.0, 0.0, 0.0], bytes=[0, 0, 0])
    assert row.p99_latency == 0.0 and row.bytes_p99 == 0.0


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        security_features(frame(spark, random_events(1, 1)), mode="hopping")


def test_no_events_no_rows(spark):
    assert security_features(spark.createDataFrame([], SCHEMA)).count() == 0


def test_events_are_scanned_once(spark, tmp_path):
    frame(spark, random_events(200, 5)).write.parquet(str(tmp_path / "e"))
    out = security_features(spark.read.parquet(str(tmp_path / "e")), 600, "tumbling")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan


def test_other_columns_and_totals(spark):
    rows = random_events(300, 6)
    df = frame(spark, rows)
    whole = 3600
    p95 = column_percentile(df, "latency_ms", 0.95, "p95", whole)
    want = sorted(r["latency_ms"] for r in rows if r["latency_ms"] is not None and r["source"] == "lb" and r["host"] == "hot")
    got = p95.where("source = 'lb' and host = 'hot'").first().p95
    assert got == want[max(len(want) * 95 // 100, 1) - 1]
    assert column_entropy(df, "path", "e", whole).count() <= 12
    totals = event_totals(df, whole).agg(F.sum("req_count"), F.sum("err_count")).first()
    assert totals[0] == 300 and totals[1] == sum(1 for r in rows if r["status"] and 400 <= r["status"] < 600)
    exact = security_features(df, whole, "tumbling").select("source", "host", "distinct_ips")
    near = distinct_clients_sketch(df, whole).join(exact, ["source", "host"])
    assert near.where(F.abs(F.col("distinct_ips_approx") - F.col("distinct_ips")) > 1).count() == 0


def test_feature_matrix_fills_nulls(spark):
    df = spark.createDataFrame([(None, 1)], "request_rate double, distinct_ips int")
    for c in FEATURE_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    assert list(feature_matrix(df).first()) == [0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]


# ---- order statistics the features rest on


def test_buckets_keep_the_order(spark):
    rng = random.Random(9)
    vals = sorted([0.0, -0.0, 1e-300, -1e-300, 1e300, float("inf"), float("-inf")] + [rng.uniform(-5, 5) * 10 ** rng.randint(-8, 8) for _ in range(2000)])
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for size in (16, 64, 65536):
        got = [r.b for r in df.select("v", value_bucket(F.col("v"), size).alias("b")).orderBy("v").collect()]
        assert got == sorted(got)


@pytest.mark.parametrize("q", [0.5, 0.95, 0.99])
def test_quantiles_match_pandas(spark, q):
    import pandas as pd

    rng = random.Random(3)
    data = [("g%d" % (i % 3), rng.choice([1.0, rng.gauss(0, 3), rng.uniform(0, 1)])) for i in range(2000)] + [("one", 4.0), ("null", None)]
    df = spark.createDataFrame(data, "k string, v double")
    pdf = pd.DataFrame(data, columns=["k", "v"])
    want = pdf.dropna().groupby("k").v.quantile(q).to_dict()
    got = {r.k: r.x for r in interpolated_quantile(df, ["k"], "v", q, "x").collect()}
    assert got == pytest.approx(want)
    assert interpolated_quantile(df, [], "v", q, "x").first().x == pytest.approx(pdf.v.quantile(q))


def test_rank_percentile_with_one_dominant_value(spark):
    df = spark.createDataFrame([(1.0,)] * 500 + [(2.0,)] * 4 + [(3.0,)], "v double")
    assert rank_percentile(df, [], "v", 0.99, "p").first().p == 1.0
    assert rank_percentile(df, [], "v", 0.999, "p").first().p == 2.0


def test_running_totals(spark):
    rng = random.Random(4)
    data = sorted({(rng.choice("ab"), round(rng.gauss(0, 2), 3)) for _ in range(800)})
    hist = spark.createDataFrame([(k, v, i % 5) for i, (k, v) in enumerate(data)], "k string, v double, c int")
    got = {(r.k, r.v): r.c_before for r in running_before(hist, ["k"], "v", ["c"]).collect()}
    want, seen = {}, {"a": 0, "b": 0}
    for i, (k, v) in enumerate(data):
        want[(k, v)] = seen[k]
        seen[k] += i % 5
    assert got == want
