"""Queries that run streams to their end over the given events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions.columns import epoch
from watchloom.plans import catalog as base
from watchloom.plans import inputs
from watchloom.plans.oracle import DAY, EVENTS, F_OUT, ORACLE, SIX, TUMBLE_SIX, features
from watchloom.plans.registry import query, rounded
from watchloom.schema import FEATURE_SCHEMA
from watchloom.session import ROCKSDB, new_run_dir
from watchloom.streaming import bans, jobs, late, sustained

PART = 5 * DAY  # events arrive in parts of so many seconds
FILE_ROWS = 250_000  # of a part in a file, about
DELAYED, VERY_LATE = 40, 97  # of so many events one arrives a part later, or three


def arrivals(spark, sf, very_late=True, clock=None):
    """The given events as a stream in the order they arrive in: a batch a part, some events parts later than their time.

    ``clock`` adds a last part with one row without a client, that many seconds after all events.
    """
    path = new_run_dir(spark, "arrivals")
    e = inputs.events(spark, sf)
    part = F.floor(epoch("ts") / PART).cast("int") + F.when(F.col("event_id") % DELAYED == 0, 1).otherwise(0)
    part = part + F.when(F.col("event_id") % VERY_LATE == 0, 3).otherwise(0) if very_late else part
    # cut once, so that a part reads its own rows only
    cut = new_run_dir(spark, "parts")
    e.withColumn("part", part).write.partitionBy("part").parquet(cut)
    rows = spark.read.schema(e.withColumn("part", part).schema).parquet(cut)
    parts = {r["part"]: r["count"] for r in rows.where(F.col("part").isNotNull()).groupBy("part").count().collect()}
    # all parts have equally many files, so that a batch takes a part
    files = max(1, -(-max(parts.values(), default=0) // FILE_ROWS))
    for p in sorted(parts):
        own = spark.read.schema(e.schema).parquet(f"{cut}/part={p}")
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(path)
        while len(spark.read.schema(e.schema).parquet(path).inputFiles()) % files:
            own.limit(0).coalesce(1).write.mode("append").parquet(path)
    if not parts:
        e.limit(0).coalesce(1).write.parquet(path)
    if clock is not None:
        tick = F.lit(e.agg(F.max("ts")).first()[0]) + F.make_dt_interval(secs=F.lit(clock))
        e.limit(1).withColumns({"event_id": F.lit(-1).cast(e.schema["event_id"].dataType), "ts": tick, "src_ip": F.lit("clock")}).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(path)


def _gated(spark, sf):
    out = new_run_dir(spark, "late")
    stream = arrivals(spark, sf)
    jobs.drain(late.late_gate(stream, f"{out}/gate", f"{out}/cp-gate", SIX, "1 hour", every=None))
    return out, stream.schema


@query
def stream_late_events(spark, sf):
    """The events that came after their window was over."""
    out, schema = _gated(spark, sf)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/gate/late").select("event_id", "ts")


@query
def stream_features_amended(spark, sf):
    """Features of a stream with late events, after the windows they hit were worked out again."""
    out, schema = _gated(spark, sf)
    job = jobs.features_job(late.gated(spark, f"{out}/gate", "ontime", schema), f"{out}/features", f"{out}/cp-features", SIX, "1 hour", every=None, kept_counts=f"{out}/counts")
    jobs.drain(job)
    if jobs.late_rows(job):
        raise RuntimeError("the feature job dropped rows that were on time at the gate")
    jobs.flush_open(spark, f"{out}/features", f"{out}/cp-features", SIX)
    jobs.drain(late.amendments(late.gated(spark, f"{out}/gate", "late", schema), f"{out}/counts", f"{out}/amended", f"{out}/cp-amended", SIX, every=None))
    first = spark.read.schema(FEATURE_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{out}/features")
    return rounded(late.amended_features(first, spark, f"{out}/amended"), 6, "entropy_path")


_PART = f"epoch_us(ts) // {PART * 1_000_000} + case when event_id % {DELAYED} = 0 then 1 else 0 end + case when event_id % {VERY_LATE} = 0 then 3 else 0 end"
ORACLE["stream_late_events"] = f"""with {EVENTS}, p as (select event_id, ts, {TUMBLE_SIX} as window_end, {_PART} as part from ev),
m as (select part, max(max(ts)) over (order by part rows between unbounded preceding and 1 preceding) - interval 1 hour as line from p group by part)
select event_id, ts from p join m using (part) where window_end <= line"""
ORACLE["stream_features_amended"] = f"with {EVENTS}, {features(SIX, TUMBLE_SIX)} {F_OUT}"


@query
def stream_banned_events(spark, sf):
    """Requests that met a running ban, decided as the stream goes on; equal to ``edge_banned_events``."""
    out = new_run_dir(spark, "bans")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # out of order by up to a part, so the watermark waits that long; the clock lets the last slots end
    requests = arrivals(spark, sf, very_late=False, clock=2 * PART).select("event_id", "src_ip", "ts")
    jobs.drain(bans.ban_job(requests, f"{out}/banned", f"{out}/cp", f"{PART} seconds", every=None, **base.LIMITS))
    return spark.read.schema(bans.BANNED).option("recursiveFileLookup", "true").parquet(f"{out}/banned")


ORACLE["stream_banned_events"] = ORACLE["edge_banned_events"]


@query
def stream_sustained(spark, sf):
    """Runs of low windows found as the stream goes on; equal to ``ts_sustained``."""
    out = new_run_dir(spark, "sustained")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    points = arrivals(spark, sf, very_late=False, clock=2 * PART)
    runs = sustained.sustained_below(points, ["source"], 50.0, SIX, 3 * SIX, delay=f"{PART} seconds")
    jobs.drain(jobs.trigger(runs.writeStream.format("parquet").option("path", f"{out}/runs").option("checkpointLocation", f"{out}/cp").outputMode("append"), None).start())
    return rounded(spark.read.schema(runs.schema).parquet(f"{out}/runs"), 9, "highest")


ORACLE["stream_sustained"] = ORACLE["ts_sustained"]
