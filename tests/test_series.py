import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from watchloom.operators import drift, edge, lookups
from watchloom.operators import timeseries as ts

T0 = datetime(2026, 1, 1)


def points(spark, rows):
    return spark.createDataFrame([(s, T0 + timedelta(seconds=at), float(v)) for s, at, v in rows], "s string, ts timestamp, value double")


def test_align_and_reduce(spark):
    df = points(spark, [("a", 0, 1), ("a", 30, 3), ("a", 60, 5), ("b", 10, 10)]).withColumn("g", F.lit("x"))
    rate = {(r.s, r.at.minute): r.aligned for r in ts.align(df, ["s"], 60, "rate").collect()}
    assert rate == {("a", 0): 2 / 60, ("a", 1): 1 / 60, ("b", 0): 1 / 60}
    mean = ts.align(df, ["g", "s"], 60, "mean")
    assert {r.at.minute: r.reduced for r in ts.reduce_series(mean, ["g"], "max").collect()} == {0: 10.0, 1: 5.0}
    assert {r.at.minute: r.reduced for r in ts.reduce_series(mean, [], "p50").collect()} == {0: 6.0, 1: 5.0}


def test_histogram_and_quantile(spark):
    df = points(spark, [("a", 0, v) for v in (0.5, 1.5, 1.5, 3.0, 100.0)] + [("b", 0, 0.5)])
    bounds = (1.0, 2.0, 4.0)
    h = ts.histogram(df, ["s"], bounds)
    rows = {(r.s, r.le): r.cumulative for r in ts.histogram_rows(h, ["s"], bounds).collect()}
    assert [rows[("a", le)] for le in ("1.0", "2.0", "4.0", "+Inf")] == [1, 3, 4, 5]
    q = lambda p: {r.s: r.q for r in h.select("s", ts.histogram_quantile(bounds, p).alias("q")).collect()}
    assert q(0.5)["a"] == pytest.approx(1 + 1.5 / 2) and q(0.99)["a"] == 4.0 and q(0.5)["b"] == 0.5


def test_sustained_needs_consecutive_windows(spark):
    low = [("a", 300 * i, 0.1) for i in range(12)]
    gap = [("b", 300 * i, 0.1) for i in range(20) if i != 10]
    up = [("c", 300 * i, 0.1 if i != 6 else 0.9) for i in range(20)]
    out = ts.sustained_below(points(spark, low + gap + up), ["s"]).collect()
    assert [(r.s, r.windows) for r in out if r.s == "a"] == [("a", 12)]
    assert [r.windows for r in out if r.s == "c"] == [13] and not [r for r in out if r.s == "b"]
    either = ts.any_condition(points(spark, low), points(spark, gap), series=["s"])
    assert {r.s: r.conditions for r in either.collect()} == {"a": [0], "b": [1]}


def test_gauge_and_summary(spark):
    df = spark.createDataFrame([("a", T0, 1, 5.0, 200), ("a", T0, 2, 6.0, 500), ("b", T0, 0, 1.0, 200)], "s string, ts timestamp, id int, value double, status int")
    assert {r.s: r.last_value for r in ts.gauge_last(df, ["s"], "id").collect()} == {"a": 6.0, "b": 1.0}
    got = {r.s: (r.n, r.fail_ratio, r.p99) for r in ts.traffic_summary(df, ["s"], "value").collect()}
    assert got == {"a": (2, 0.5, 5.0), "b": (1, 0.0, 1.0)}


# ---- edge


def test_bans_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", "hot", "cold"]), T0 + timedelta(seconds=rng.randint(0, 900))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, src_ip string, ts timestamp")
    limit, width, ban = 9, 60, 90
    slots = {}
    for _, ip, t in rows:
        key = (ip, int((t - T0).total_seconds()) // width)
        slots[key] = slots.get(key, 0) + 1
    spans = [(ip, T0 + timedelta(seconds=(s + 1) * width)) for (ip, s), n in slots.items() if n > limit]
    want = {i for i, ip, t in rows if any(ip == b and frm <= t < frm + timedelta(seconds=ban) for b, frm in spans)}
    out = edge.mark_banned(df, limit, width, ban)
    assert out.count() == len(rows)
    assert {r.id for r in out.where("banned").collect()} == want and want


def test_default_limit_is_strict(spark):
    df = spark.range(601).select(F.lit("ip").alias("src_ip"), F.lit(T0).alias("ts"))
    assert edge.rate_bans(df).count() == 1 and edge.rate_bans(df.limit(600)).count() == 0


@pytest.mark.parametrize(
    "path, sqli, xss",
    [
        ("/p?q=' OR 1=1--", True, False),
        ("/p?q=1; DROP TABLE users--", True, False),
        ("/p?q=%27%20UNION%20SELECT", True, False),
        ("/p?q=<script>alert(1)</script>", False, True),
        ("/p?q=%3Cscript%3E", False, True),
        ("/p?q=%zz", False, False),
        ("/selection/union-station", False, False),
        (None, False, False),
    ],
)
def test_injection_flags(spark, path, sqli, xss):
    df = spark.createDataFrame([(path,)], "path string").select(edge.is_sqli("path").alias("s"), edge.is_xss("path").alias("x"))
    assert tuple(df.first()) == (sqli, xss)


def test_first_match(spark):
    df = spark.createDataFrame([("/p?q=' OR 1=1--", True), ("/p?q=' OR 1=1--", False), ("/<script>", False), ("/", False)], "path string, banned boolean")
    assert [(r.priority, r.action) for r in edge.first_match(df).collect()] == [(500, "deny(429)"), (600, "deny(403)"), (601, "deny(403)"), (1000, "allow")]
    assert [(r.priority, r.action) for r in edge.first_match(df, conform_is_final=True).collect()] == [(500, "deny(429)")] + [(500, "allow")] * 3


# ---- drift


def two_samples(spark, seed=8):
    rng = random.Random(seed)
    rows = [(True, round(rng.gauss(0, 1), 2)) for _ in range(600)] + [(False, round(rng.gauss(0.5, 1.5), 2)) for _ in range(400)]
    return rows, spark.createDataFrame(rows, "ref boolean, x double")


def test_ks(spark):
    rows, df = two_samples(spark)
    a, b = [x for r, x in rows if r], [x for r, x in rows if not r]
    want = max(abs(sum(v <= t for v in a) / len(a) - sum(v <= t for v in b) / len(b)) for t in {x for _, x in rows})
    got = drift.ks_statistic(df, ["x"], F.col("ref")).first()
    assert got.ks == pytest.approx(want) and (got.n_ref, got.n_cur) == (600, 400)


def test_kl(spark):
    import math

    rows, df = two_samples(spark)
    a, b = [x for r, x in rows if r], [x for r, x in rows if not r]
    lo, hi, bins = min(a), max(a), 200  # many bins, so some stay empty
    where = lambda v: min(max(int((v - lo) // ((hi - lo) / bins)), 0), bins - 1)
    q, p = [1.0] * bins, [1.0] * bins
    for v in a:
        q[where(v)] += 1
    for v in b:
        p[where(v)] += 1
    want = sum(x / sum(p) * math.log((x / sum(p)) / (y / sum(q))) for x, y in zip(p, q))
    assert drift.kl_divergence(df, ["x"], F.col("ref"), bins).first().kl == pytest.approx(want)
    same = df.unionByName(df.withColumn("ref", ~F.col("ref")))
    assert drift.kl_divergence(same, ["x"], F.col("ref")).first().kl == pytest.approx(0.0)


def test_mean_shift(spark):
    df = spark.createDataFrame([(True, 0.0), (True, 2.0), (False, 5.0)], "ref boolean, x double")
    got = drift.mean_shift(df, ["x"], F.col("ref")).first()
    assert (got.ref_mean, got.ref_std, got.cur_mean, got.shift, got.drifted) == (1.0, 1.0, 5.0, 4.0, True)


def test_seasonal(spark):
    rows = [("a", 3600 * 24 * 7 * w, 10.0 + w % 2) for w in range(12)] + [("a", 3600 * 24 * 7 * 12, 500.0)]
    out = drift.seasonal_z(points(spark, rows), ["s"])
    assert [r.value for r in out.where("anomalous").collect()] == [500.0]


# ---- lookups


@pytest.mark.parametrize("chunk", [1, 60, 10**6])
def test_login_streaks(spark, chunk):
    rng = random.Random(chunk)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b"]), T0 + timedelta(seconds=rng.randint(0, 400)), rng.random() < 0.25) for i in range(500)]
    want, streak = {}, {}
    for i, user, _, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        streak[user] = 0 if ok else streak.get(user, 0) + 1
        want[i] = streak[user]
    df = spark.createDataFrame(rows, "event_id int, user_id string, ts timestamp, success boolean")
    assert {r.event_id: r.failed_streak for r in lookups.failed_login_streak(df, chunk_seconds=chunk).collect()} == want


def test_orders(spark):
    items = spark.createDataFrame([(1, 10, 2, 5.0), (1, 11, 1, 7.0), (2, 10, 9, 5.0), (3, 99, 1, 1.0)], "order_id int, product_id int, quantity int, unit_price double")
    prods = spark.createDataFrame([(10, 5.0, 3), (11, 8.0, 3)], "product_id int, price double, stock int")
    assert [tuple(r) for r in lookups.order_totals(items, prods).collect()] == [(1, 18.0, 2)]
    assert [r.product_id for r in lookups.price_mismatches(items, prods).collect()] == [11]
    orders = spark.createDataFrame([(1, 18.0), (2, 45.0), (7, 0.0)], "order_id int, total double")
    assert sorted((r.order_id, r.product_id) for r in lookups.order_detail(orders, items).collect()) == [(1, 10), (1, 11), (2, 10)]
    one = lookups.order_document(orders, items, 1).first()
    assert (one.total, [i.product_id for i in one["items"]]) == (18.0, [10, 11])
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    assert tuple(lookups.shop_stats(orders, users).first()) == (3, 63.0, 2)
    assert tuple(lookups.shop_stats(orders.limit(0), users.limit(0)).first()) == (0, 0.0, 0)


def test_traces(spark):
    spans = spark.createDataFrame([("t", T0), ("t", T0 + timedelta(seconds=2.5)), ("u", T0)], "trace_id string, ts timestamp")
    logs = spark.createDataFrame([("t", T0 + timedelta(seconds=1), "ERROR"), ("t", T0, "INFO"), ("v", T0, "INFO")], "trace_id string, ts timestamp, severity string")
    got = {r.trace_id: (r.spans, r.duration_sec, r.logs, r.errors) for r in lookups.trace_timeline(spans, logs).collect()}
    assert got == {"t": (2, 2.5, 2, 1), "u": (1, 0.0, 0, 0)}
    assert sorted(r.offset_sec for r in lookups.logs_with_trace(logs, spans).collect()) == [0.0, 1.0]


def test_lake_counts(spark):
    df = spark.createDataFrame([("lb", T0, 1.0), ("lb", T0 + timedelta(hours=23), 3.0), ("lb", T0 + timedelta(days=1), 9.0)], "source string, ts timestamp, latency_ms double")
    assert tuple(lookups.daily_latency(df, F.lit(T0)).first()) == ("lb", 2, 2.0)
    assert tuple(lookups.count_by_source(df).first()) == ("lb", 3)
