"""Counters, sketches, profiles, files and versions against plain versions."""

import os
import random
import re
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from watchloom.operators import counters, drift, evaluate, parse, sketches
from watchloom.operators import forest as forest_ops
from watchloom.plans import inputs
from watchloom.sources import lake

START = datetime(2026, 1, 1, tzinfo=UTC)


def plain_growth(points, seconds, stale):
    """Growth per (series, window) by walking over the points of each series."""
    out, resets = defaultdict(float), defaultdict(int)
    by = defaultdict(list)
    for s, t, v in points:
        if t is not None and v is not None:
            by[s].append(((t - START.replace(day=1)).total_seconds(), v))
    for s, own in by.items():
        own.sort()
        for t, _ in own:
            out[s, int(t // seconds)] += 0.0
        for (a, x), (b, y) in zip(own, own[1:], strict=False):
            grown = y if y < x else y - x
            resets[s, int(b // seconds)] += y < x
            if b == a or b - a > stale:
                out[s, int(b // seconds)] += grown
                continue
            for w in range(int(a // seconds), int(b // seconds) + 1):
                out[s, w] += grown * (min(b, (w + 1) * seconds) - max(a, w * seconds)) / (b - a)
    return {k: (v, resets[k]) for k, v in out.items()}


def test_counter_growth_equals_a_walk_over_the_points(spark):
    rnd, points = random.Random(4), []
    for s, many in (("hot", 400), ("b", 30), ("c", 1), (None, 12)):
        at, total = START, 0.0
        for _ in range(many):
            at += timedelta(seconds=rnd.choice([0, 1, 7, 59, 60, 61, 200, 5000]))
            total = float(rnd.randint(0, 5)) if rnd.random() < 0.1 else total + rnd.randint(0, 9)
            points.append((s, at, total))
    points += [("b", None, 1.0), ("b", START, None), points[3], points[3]]
    rnd.shuffle(points)
    df = spark.createDataFrame(points, "name string, ts timestamp, value double")
    got = counters.counter_growth(df, ["name"], 60, stale=600).select("name", F.unix_timestamp("at").alias("at"), "value", "resets").collect()
    want = plain_growth(points, 60, 600)
    zero = int(START.timestamp())
    assert {(r["name"], (r["at"] - zero) // 60): (r["value"], r["resets"]) for r in got} == {k: (pytest.approx(v), n) for k, (v, n) in want.items()}
    # what the windows hold adds up to what the series grew by
    assert sum(r["value"] for r in got) == pytest.approx(sum(v for v, _ in want.values()))
    assert counters.counter_growth(df.limit(0), ["name"], 60).collect() == []


def test_histograms_restart_as_a_whole(spark):
    rows = [("a", 0, 1.0, 3.0, 9.0), ("a", 30, 2.0, 5.0, 20.0), ("a", 60, 2.0, 4.0, 7.0), ("a", 90, 2.0, 9.0, 30.0)]
    df = spark.createDataFrame(rows, "name string, t int, le_0 double, total double, sum double").withColumn("ts", F.timestamp_seconds("t"))
    out = {r["at"].second + 60 * r["at"].minute: (r["le_0"], r["total"], r["sum"]) for r in counters.histogram_deltas(df, ["name"], ["name"], 60, (1.0,)).collect()}
    # the total falls at 60 s: all that the point shows is new, half of it in either neighbouring instant's window
    assert out[0] == (3.0, 6.0, 18.0) and out[60] == (0.0, 5.0, 23.0)


def test_stored_sketches_unite(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(START + timedelta(seconds=rnd.randint(0, 3 * 86400)), "s", rnd.choice(["h", "h", None]), rnd.choice([None, "", *[f"ip{i}" for i in range(3000)]])) for _ in range(9000)]
    events = spark.createDataFrame(rows, "ts timestamp, source string, host string, src_ip string")
    sketches.write_sketches(sketches.minute_sketches(events), str(tmp_path / "s"))
    sketches.write_sketches(sketches.minute_sketches(events), str(tmp_path / "s"))  # a day written again is replaced
    stored = sketches.read_sketches(spark, str(tmp_path / "s"))
    got = {r["host"]: r["estimate"] for r in sketches.united(stored, ["host"]).collect()}
    for host in ("h", "unknown"):
        exact = len({ip for _, _, h, ip in rows if (h or "unknown") == host and ip})
        assert abs(got[host] - exact) <= exact * sketches.error_bound()
    last = sketches.last_distinct(spark, str(tmp_path / "s"), F.lit(START + timedelta(days=2)), 86400, ["host"])
    assert "PartitionFilters: [isnotnull(date" in last._jdf.queryExecution().executedPlan().toString()
    exact = len({ip for t, _, h, ip in rows if h and ip and START + timedelta(days=1) <= t < START + timedelta(days=2)})
    assert abs({r["host"]: r["estimate"] for r in last.collect()}["h"] - exact) <= exact * sketches.error_bound()
    assert sketches.minute_sketches(events.limit(0)).count() == 0


def test_forest_does_not_depend_on_partitions(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, *map(float, rnd.normal(size=3))) for i in range(600)] + [(999, 9.0, -9.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    fits = [forest_ops.fit_forest(df.repartition(n), ["id"], ["a", "b", "c"], trees=20, psi=64) for n in (1, 7)]
    assert fits[0].nodes.equals(fits[1].nodes) and fits[0].threshold == fits[1].threshold
    inner = fits[0].nodes[fits[0].nodes["feature"] >= 0]
    assert (inner["left"] == 2 * inner["node"]).all() and (inner["right"] == 2 * inner["node"] + 1).all()
    top = forest_ops.score_forest(df, fits[0]).orderBy(F.desc("anomaly_score")).first()
    assert top["id"] == 999 and top["is_anomaly"]


def test_only_one_writer_gets_a_version(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: [evaluate.claim_version(spark, str(tmp_path), "d") for _ in range(5)], range(8)))
    assert sorted(v for own in got for v in own) == list(range(1, 41))
    rows = spark.createDataFrame([("d", 0.5), ("e", 0.7)], "detector string, value double")
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda _: evaluate.commit_versions(rows, str(tmp_path / "r")).count(), range(2)))
    assert sorted((r["detector"], r["version"]) for r in evaluate.read_registry(spark, str(tmp_path / "r")).collect()) == [("d", 1), ("d", 2), ("e", 1), ("e", 2)]


def test_objects_go_by_their_age(spark, tmp_path):
    for day in (1, 40, 91, 200):
        f = tmp_path / f"date=x{day}" / "a.json"
        f.parent.mkdir()
        f.write_text("{}")
        os.utime(f, ((START - timedelta(days=day)).timestamp(),) * 2)
    old = lake.expired_objects(spark, str(tmp_path), F.lit(START))
    assert sorted(r["bytes"] for r in old.collect()) == [2, 2]
    assert lake.delete_objects(old) == 2 and lake.objects(spark, str(tmp_path)).count() == 2
    assert lake.delete_objects(lake.expired_objects(spark, str(tmp_path), F.lit(START))) == 0


def test_scans_name_the_file_of_a_reject(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"message": "x"}\n{"mess\n\n')
    (tmp_path / "b.jsonl").write_text('{"message": "y"}\n')
    (tmp_path / "c.txt").write_text("not read\n")
    good, bad = lake.split_corrupt(lake.read_events(spark, str(tmp_path), strict=False, named=True))
    assert sorted((r["message"], r["file"].rsplit("/", 1)[1]) for r in good.collect()) == [("x", "a.json"), ("y", "b.jsonl")]
    assert [(r["_corrupt_record"], r["file"].rsplit("/", 1)[1]) for r in bad.collect()] == [('{"mess', "a.json")]
    with pytest.raises((PySparkException, Py4JJavaError), match="a.json"):
        lake.read_events(spark, str(tmp_path)).collect()


def test_profile_stands_in_for_the_reference(spark):
    rnd = np.random.default_rng(5)
    then, now = rnd.normal(size=4000), rnd.normal(0.4, 1.2, size=3000)
    frame = lambda x: spark.createDataFrame([(float(v), None) for v in x], "v double, w double")
    got = {r["feature"]: r for r in drift.against_profile(frame(now), drift.profile(frame(then), ["v", "w"])).collect()}
    edges = np.linspace(then.min(), then.max(), drift.PROFILE_BINS + 1)
    gap = max(abs((then < e).mean() - (now < e).mean()) for e in edges[1:-1])
    assert got["v"]["ks"] == pytest.approx(gap, abs=2e-3) and got["v"]["shift"] == pytest.approx(abs(now.mean() - then.mean()) / then.std())
    assert got["v"]["kl"] > 0 and (got["w"]["n_ref"], got["w"]["kl"]) == (0, None)


@pytest.mark.parametrize("name", ["nginx", "lb", "app", "waf", "slow"])
def test_a_record_is_parsed_once(spark, name):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.exists(sf):
        pytest.skip("no test tables here")
    rows = {"nginx": (inputs.access_lines, parse.parse_nginx), "lb": (inputs.lb_records, parse.parse_lb), "app": (inputs.app_records, parse.parse_app), "waf": (inputs.waf_records, parse.parse_waf), "slow": (inputs.slow_records, parse.parse_slow_query)}
    source, parser = rows[name]
    plan = parser(source(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"from_json\(" if name != "nginx" else r"regexp_replace\(", plan)) == 1
