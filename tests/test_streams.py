import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_rules import RULES, START, plain_hits, random_features

from watchloom.operators.features import security_features
from watchloom.operators.rules import evaluate_rules
from watchloom.schema import EVENT_SCHEMA, FEATURE_COLUMNS
from watchloom.sources import envelope, lake
from watchloom.streaming import jobs


def event_files(path, batches, seed=3):
    """Batches of JSON events in time order, a few of them late inside the watermark."""
    rng = random.Random(seed)
    path.mkdir(parents=True)
    at = datetime(2026, 1, 1)
    for b in range(batches):
        lines = []
        for _ in range(150):
            at += timedelta(seconds=rng.randint(0, 6))
            late = timedelta(seconds=rng.randint(0, 120))
            lines.append(json.dumps({
                "ts": (at - late).strftime("%Y-%m-%dT%H:%M:%SZ"), "source": rng.choice(["lb", "app"]), "host": rng.choice(["h1", "h1", "h2"]), "message": "m",
                "status": rng.choice([200, 401, 500]), "latency_ms": rng.uniform(0, 100), "bytes": rng.randint(0, 99), "src_ip": f"10.0.0.{rng.randint(0, 5)}", "path": rng.choice(["/", "/a", "/b"]),
            }))
        (path / f"b{b}.json").write_text("\n".join(lines))
    return at


def test_streamed_features_equal_batch(spark, tmp_path):
    event_files(tmp_path / "in", 4)
    stream = jobs.event_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    jobs.drain(jobs.features_job(stream, str(tmp_path / "f"), str(tmp_path / "cp"), 300, "5 minutes", every=None), seconds=300)
    out = lake.read_features(spark, str(tmp_path / "f"))
    batch = security_features(lake.read_events(spark, str(tmp_path / "in")), 300, "tumbling")
    newest = lake.read_events(spark, str(tmp_path / "in")).agg(F.max("ts")).first()[0]
    closed = batch.where(F.col("window_end") <= F.lit(newest - timedelta(minutes=5)))
    key = lambda r: (r.source, r.host, r.window_end)
    want = {key(r): tuple(r[c] for c in FEATURE_COLUMNS) for r in closed.collect()}
    have = {key(r): tuple(r[c] for c in FEATURE_COLUMNS) for r in out.collect()}
    left = jobs.flush_open(spark, str(tmp_path / "f"), str(tmp_path / "cp"), 300)
    everything = {key(r): tuple(r[c] for c in FEATURE_COLUMNS) for r in batch.collect()}
    opened = {key(r): tuple(r[c] for c in FEATURE_COLUMNS) for r in left.collect()}
    assert opened and opened.keys() == everything.keys() - want.keys()
    assert all(opened[k] == pytest.approx(everything[k]) for k in opened)
    assert want and have.keys() == want.keys()
    for k in want:
        assert have[k] == pytest.approx(want[k])


def test_feature_state_is_looked_up_once_a_value(spark, tmp_path):
    """Counting the keys of the state would look up each of them again when it is written and when it goes."""
    event_files(tmp_path / "in", 3)
    before = spark.conf.get(jobs.UNCOUNTED, None)
    job = jobs.features_job(jobs.event_stream(spark, str(tmp_path / "in"), files_per_batch=1), str(tmp_path / "f"), str(tmp_path / "cp"), 300, "5 minutes", every=None)
    jobs.drain(job, seconds=300)
    states = [s for p in job.recentProgress for s in p.stateOperators]
    put, gone, got = (sum(n) for n in zip(*[(s.numRowsUpdated, s.numRowsRemoved, s.customMetrics["rocksdbGetCount"]) for s in states], strict=True))
    assert put > 0 and gone > 0 and got == put
    assert spark.conf.get(jobs.UNCOUNTED, None) == before


def write_feature_files(spark, path, parts, only=None):
    rows = random_features(21, 200)
    names = [c for c in FEATURE_COLUMNS if c not in ("p99_latency", "entropy_path")]
    schema = "source string, host string, window_end timestamp, m double, k double"
    for i in only if only is not None else range(parts):
        lo, hi = START + timedelta(minutes=200 / parts * i), START + timedelta(minutes=200 / parts * (i + 1))
        df = spark.createDataFrame([r for r in rows if lo <= r[2] < hi], schema)
        wide = df.select("source", "host", "window_end", F.col("m").alias("p99_latency"), F.col("k").alias("entropy_path"), *[
            (F.lit(0).cast("bigint") if c.startswith("distinct") else F.lit(0.0)).alias(c) for c in names
        ])
        wide.select("source", "host", "window_end", *FEATURE_COLUMNS).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    return rows


def renamed_rules():
    from dataclasses import replace

    return [replace(r, metric={"m": "p99_latency", "k": "entropy_path"}[r.metric]) for r in RULES]


def test_streamed_rules_keep_state_between_batches(spark, tmp_path):
    """Several micro-batches and a restart give the hits of one pass over all rows."""
    rules, hits = renamed_rules(), str(tmp_path / "hits")
    for parts in ((0, 1), (2, 3)):  # the second run starts from stored state
        rows = write_feature_files(spark, str(tmp_path / "f"), 4, parts)
        stream = jobs.feature_stream(spark, str(tmp_path / "f"))
        jobs.drain(jobs.rules_job(stream, rules, jobs.anomalies_sink(hits), str(tmp_path / "cp"), every=None), seconds=300)
    got = spark.read.option("recursiveFileLookup", "true").parquet(f"{hits}/rows")
    assert {(r.source, r.host, r.ts, r.rule) for r in got.collect()} == plain_hits(rows)
    points = spark.read.option("recursiveFileLookup", "true").json(f"{hits}/metric")
    assert points.count() == got.count()
    logged = spark.read.option("recursiveFileLookup", "true").json(f"{hits}/log")
    assert logged.where("severity = 'MEDIUM'").count() == got.count()


def test_alert_sink_upserts(spark, tmp_path):
    write_feature_files(spark, str(tmp_path / "f"), 1)
    features = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "f"))
    hits = evaluate_rules(features, renamed_rules()).persist()
    sink = jobs.alerts_sink(str(tmp_path / "store"))
    for batch in (0, 1):
        sink(hits, batch)
    stored = lake.read_alerts(spark, str(tmp_path / "store"))
    assert stored.count() == hits.count() == stored.select("id").distinct().count()


def test_archive_and_fan_out(spark, tmp_path):
    event_files(tmp_path / "in", 2)
    stream = jobs.event_stream(spark, str(tmp_path / "in"))
    seen = {}
    queries = jobs.fan_out(
        stream,
        {"a": lambda df, b: seen.__setitem__("a", df.count()), "b": lambda df, b: seen.__setitem__("b", df.where("status = 500").count())},
        str(tmp_path / "cp"),
    )
    archive = jobs.archive(stream, str(tmp_path / "raw"), str(tmp_path / "cp-archive"), every=None, shards=2)
    jobs.drain(*queries.values(), archive, seconds=300)
    assert seen["a"] == 300 and 0 < seen["b"] < 300
    back = lake.read_events(spark, str(tmp_path / "raw"), partitioned=True)
    assert back.count() == 300
    files = list((tmp_path / "raw").rglob("*.json"))
    assert files and all(f.parent.name.startswith("date=") and f.parent.parent.name.startswith("source=") for f in files)
    assert max(len(list(d.glob("*.json"))) for d in {f.parent for f in files}) <= 2


def test_envelopes_decode_in_a_stream(spark, tmp_path):
    body = spark.createDataFrame([('{"source":"lb","host":"h","status":500}',)], "t string").select(envelope.encode_payload("t").alias("data"))
    body.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("data string").json(str(tmp_path / "in"))
    seen = []
    q = envelope.decode_envelope(stream).writeStream.foreachBatch(lambda df, b: seen.extend(df.collect()))
    jobs.drain(jobs.trigger(q.option("checkpointLocation", str(tmp_path / "cp")), None).start(), seconds=120)
    assert [(r.source, r.host, r.status) for r in seen] == [("lb", "h", 500)] and seen[0].__fields__ == EVENT_SCHEMA.fieldNames()
