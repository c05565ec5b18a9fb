"""Seeded synthetic events and labelled attacks as distributed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Choices of the event generator.
SOURCES = ("lb", "cdn", "app", "gke", "nginx", "cloudsql", "node_metrics")
STATUSES = (200, 200, 200, 200, 301, 404, 500)
PATHS = ("/", "/api/v1/order", "/login", "/health")
HOSTS, SEED = 50, 7
ATTACKS = ("ddos", "brute_force", "slow_loris")
ATTACK_HOST = "edge-attack"


def draw(row: Column, salt: int, size: int) -> Column:
    """A number in 0..size-1 from the row number: the same on every retry."""
    return F.pmod(F.xxhash64(row, F.lit(salt)), F.lit(size))


def normal(row: Column, salt: int) -> Column:
    """A standard normal value from two hashed uniforms."""
    scale = F.lit(float(1 << 30))
    u = (draw(row, salt, 1 << 30) + 1) / scale
    v = draw(row, salt + 1, 1 << 30) / scale
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(6.283185307179586) * v)


def pick(row: Column, salt: int, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (draw(row, salt, len(values)) + 1).cast("int"))


def events_like(rows: DataFrame, row: str, ts: Column, seed: int = SEED) -> DataFrame:
    """Synthetic events, one for each row of ``rows``."""
    r, s = F.col(row), seed * 100
    return rows.select(
        ts.alias("ts"),
        ts.alias("ingest_ts"),
        pick(r, s + 1, SOURCES).alias("source"),
        F.concat(F.lit("host-"), draw(r, s + 2, HOSTS) + 1).alias("host"),
        F.concat(F.lit("event-"), r).alias("message"),
        pick(r, s + 3, STATUSES).alias("status"),
        F.greatest(F.lit(1.0), F.lit(80.0) + F.lit(30.0) * normal(r, s + 4)).alias("latency_ms"),
        (draw(r, s + 6, 49801) + 200).alias("bytes"),
        F.concat(F.lit("10.0."), draw(r, s + 7, 255) + 1, F.lit("."), draw(r, s + 8, 255) + 1).alias("src_ip"),
        F.lit(None).cast("string").alias("user"),
        pick(r, s + 9, PATHS).alias("path"),
    )


def seed_events(spark: SparkSession, n: int = 2000, start: str = "2026-06-20 10:00:00", per_second: float = 50.0, seed: int = SEED) -> DataFrame:
    ts = F.lit(start).cast("timestamp") + F.make_dt_interval(secs=(F.col("id") / F.lit(per_second)).cast("decimal(18,6)"))
    return events_like(spark.range(n), "id", ts, seed)


def attack_like(rows: DataFrame, row: str, ts: Column, kind: str, seed: int = SEED) -> DataFrame:
    """Attack events of one kind, one for each row of ``rows``."""
    if kind not in ATTACKS:
        raise ValueError(f"kind must be one of {ATTACKS}")
    none = F.lit(None)
    # What each attack looks like.
    shape = {
        "ddos": (503, F.concat(F.lit("203.0.113."), draw(F.col(row), seed * 100 + 50, 254) + 1), none, "/", F.lit(5.0), F.lit(0)),
        "brute_force": (401, F.lit("198.51.100.42"), F.lit("admin"), "/login", none, none),
        "slow_loris": (200, F.lit("192.0.2.7"), none, "/upload", F.lit(30000.0), F.lit(100)),
    }[kind]
    status, ip, user, path, latency, size = shape
    return rows.select(
        ts.alias("ts"),
        ts.alias("ingest_ts"),
        F.lit("lb").alias("source"),
        F.lit(ATTACK_HOST).alias("host"),
        F.lit(f"injected-{kind}").alias("message"),
        F.lit(status).alias("status"),
        latency.cast("double").alias("latency_ms"),
        size.cast("bigint").alias("bytes"),
        ip.alias("src_ip"),
        user.cast("string").alias("user"),
        F.lit(path).alias("path"),
    )


def inject_attack(events: DataFrame, attack: DataFrame) -> DataFrame:
    """Events with an attack mixed in, labelled by the attack's host."""
    return events.unionByName(attack, allowMissingColumns=True).withColumn("is_anomaly", (F.col("host") == ATTACK_HOST).cast("int"))
