"""Schemas and fixed values of the event model."""

from __future__ import annotations

from pyspark.sql import types as T

# The sources an event may name.
NATIVE_SOURCES = (
    "cdn",
    "lb",
    "cloud_armor",
    "app",
    "gke",
    "nginx",
    "kafka",
    "cloudsql",
    "mongo",
    "redis",
    "node_metrics",
    "container_metrics",
    "prom_app",
    "otel_traces",
)

# Accepted aliases and the native source each one stands for.
SOURCE_ALIASES = {
    "cloudfront": "cdn",
    "alb": "lb",
    "waf": "cloud_armor",
    "eks": "gke",
    "mysql": "cloudsql",
}

ALLOWED_SOURCES = NATIVE_SOURCES + tuple(SOURCE_ALIASES)

# Written times keep their microseconds.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

# The common event.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("ingest_ts", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Detector input columns, in model order.
FEATURE_COLUMNS = (
    "request_rate",
    "rate_4xx",
    "rate_5xx",
    "auth_failure_rate",
    "distinct_ips",
    "distinct_paths",
    "p99_latency",
    "bytes_p99",
    "entropy_path",
)

FEATURE_KEYS = ("source", "host", "window_end")

FEATURE_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("request_rate", T.DoubleType()),
        T.StructField("rate_4xx", T.DoubleType()),
        T.StructField("rate_5xx", T.DoubleType()),
        T.StructField("auth_failure_rate", T.DoubleType()),
        T.StructField("distinct_ips", T.LongType()),
        T.StructField("distinct_paths", T.LongType()),
        T.StructField("p99_latency", T.DoubleType()),
        T.StructField("bytes_p99", T.DoubleType()),
        T.StructField("entropy_path", T.DoubleType()),
    ]
)

# Columns of the stored anomalies table; the last two may be null.
ANOMALY_REQUIRED = ("id", "ts", "detector", "source", "score", "severity")
ANOMALY_OPTIONAL = ("host", "explanation")

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("detector", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("explanation", T.StringType()),
    ]
)

# Labels an analyst may give an alert.
FEEDBACK_LABELS = ("true_positive", "false_positive", "ignored")
