"""Windowed security features per (source, host, window).

Every event is spread into facets (status, client, path, latency, bytes) and folded to
counts per (group, facet, value) in one shuffle with map-side combine. All outputs
are then read off those counts, so the events are scanned once and a hot host is
split by its values rather than held in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.columns import filled_or, share
from watchloom.functions.ordered import low_rank, pick_ranked, rank_targets, value_bucket
from watchloom.schema import FEATURE_COLUMNS, FEATURE_KEYS

STATUS, CLIENT, PATH, LATENCY, BYTES = "s", "i", "p", "l", "b"
EPOCH = "timestamp'1970-01-01 00:00:00'"
MODES = ("minute", "tumbling", "sliding")


def window_end(ts: str, seconds: int, mode: str = "minute", slide: int | None = None) -> Column:
    """End of the window an event belongs to.

    ``minute``   the event's minute plus the window length (the compatible default:
                 each bucket holds one minute although rates divide by the window)
    ``tumbling`` fixed windows of the given length
    ``sliding``  overlapping windows; yields one row per window
    """
    span = f"{seconds} seconds"
    if mode == "minute":
        return F.date_trunc("minute", F.col(ts)) + F.expr(f"interval {seconds} seconds")
    if mode == "tumbling":
        return F.window(ts, span)["end"]
    if mode == "sliding":
        return F.window(ts, span, f"{slide or seconds} seconds")["end"]
    raise ValueError(f"mode must be one of {MODES}")


def facet_rows(events: DataFrame) -> DataFrame:
    """(ts, source, host, facet, text, num): up to five rows per event."""
    none_text, none_num = F.lit(None).cast("string"), F.lit(None).cast("double")

    def facet(code: str, keep: Column, text: Column = none_text, num: Column = none_num) -> Column:
        return F.struct(F.lit(code).alias("facet"), keep.alias("keep"), text.alias("text"), num.cast("double").alias("num"))

    facets = F.array(
        facet(STATUS, F.lit(True), num=F.col("status")),
        facet(CLIENT, F.coalesce(F.col("src_ip") != "", F.lit(False)), text=F.col("src_ip")),
        facet(PATH, F.coalesce(F.col("path") != "", F.lit(False)), text=F.col("path")),
        facet(LATENCY, F.col("latency_ms").isNotNull(), num=F.col("latency_ms")),
        facet(BYTES, F.col("bytes").isNotNull(), num=F.col("bytes")),
    )
    return (
        events.where(F.col("ts").isNotNull())
        .select("ts", filled_null("source").alias("source"), filled_null("host").alias("host"), F.explode(facets).alias("f"))
        .where("f.keep")
        .select("ts", "source", "host", "f.facet", "f.text", "f.num")
    )


def facet_counts(events: DataFrame, seconds: int, mode: str = "minute", slide: int | None = None) -> DataFrame:
    """Counts per (source, host, window_end, facet, text, num)."""
    rows = facet_rows(events)
    if mode == "sliding":
        rows = rows.withColumn("window_end", window_end("ts", seconds, mode, slide))
        end = F.col("window_end")
    else:
        end = window_end("ts", seconds, mode, slide)
    # never null here; coalesce keeps every use of the counts on one shared plan
    end = F.coalesce(end, F.expr(EPOCH)).alias("window_end")
    return rows.select("source", "host", end, "facet", "text", "num").groupBy(*FEATURE_KEYS, "facet", "text", "num").agg(F.count(F.lit(1)).alias("c"))


def security_features(
    events: DataFrame,
    seconds: int = 300,
    mode: str = "minute",
    slide: int | None = None,
    quantile: float = 0.99,
) -> DataFrame:
    """The nine detector inputs per (source, host, window_end)."""
    return features_from_counts(facet_counts(events, seconds, mode, slide), seconds, quantile)


def features_from_counts(counts: DataFrame, seconds: int, quantile: float = 0.99) -> DataFrame:
    """Features from ``facet_counts`` rows; also finishes the streaming aggregation."""
    counts = counts.withColumn("bucket", value_bucket(F.col("num"), per_octave=16))
    status, c = F.col("num"), F.col("c")

    def hits(condition: Column) -> Column:
        return F.sum(F.when(condition, c).otherwise(F.lit(0)))

    buckets = counts.groupBy(*FEATURE_KEYS, "facet", "bucket").agg(
        F.sum("c").alias("c"),
        F.count(F.lit(1)).alias("values"),
        F.sum(c * F.log2(c)).alias("clogc"),
        hits((status >= 400) & (status < 500)).alias("n4"),
        hits((status >= 500) & (status < 600)).alias("n5"),
        hits(status.isin(401, 403)).alias("nauth"),
    )

    def of(code: str, col: str) -> Column:
        return F.sum(F.when(F.col("facet") == code, F.col(col)).otherwise(F.lit(0)))

    scalars = buckets.groupBy(*FEATURE_KEYS).agg(
        of(STATUS, "c").alias("n"),
        of(STATUS, "n4").alias("n4"),
        of(STATUS, "n5").alias("n5"),
        of(STATUS, "nauth").alias("nauth"),
        of(CLIENT, "values").alias("distinct_ips"),
        of(PATH, "values").alias("distinct_paths"),
        of(PATH, "c").alias("path_n"),
        of(PATH, "clogc").alias("path_clogc"),
    )
    keys = [*FEATURE_KEYS, "facet"]
    # only the numeric facets get a rank; leaving the others in keeps one shared plan
    rank = F.when(F.col("facet").isin(LATENCY, BYTES), low_rank(F.col("_n"), quantile))
    targets = rank_targets(buckets.select(*keys, "bucket", F.col("c").alias("_c")), keys, "bucket", {"p": rank})
    near = counts.withColumnRenamed("c", "_c").join(targets, [*keys, "bucket"])
    top = pick_ranked(near, keys, "num").groupBy(*FEATURE_KEYS).agg(
        F.max(F.when(F.col("facet") == LATENCY, F.col("num"))).alias("lat"),
        F.max(F.when(F.col("facet") == BYTES, F.col("num"))).alias("byt"),
    )
    zero = F.lit(0.0)
    return scalars.join(top, list(FEATURE_KEYS), "left").select(
        *FEATURE_KEYS,
        (F.col("n") / F.lit(float(seconds))).alias("request_rate"),
        share(F.col("n4"), F.col("n")).alias("rate_4xx"),
        share(F.col("n5"), F.col("n")).alias("rate_5xx"),
        share(F.col("nauth"), F.col("n")).alias("auth_failure_rate"),
        "distinct_ips",
        "distinct_paths",
        F.coalesce("lat", zero).alias("p99_latency"),
        F.coalesce("byt", zero).alias("bytes_p99"),
        entropy_from(F.col("path_n"), F.col("path_clogc")).alias("entropy_path"),
    )


def entropy_from(total: Column, clogc: Column) -> Column:
    """Shannon entropy in bits from sum(c) and sum(c * log2 c); 0 when empty."""
    # one value alone has entropy exactly 0; greatest() drops the rounding residue below it
    return F.when(total > 0, F.greatest(F.log2(total) - clogc / total, F.lit(0.0))).otherwise(F.lit(0.0))


def column_entropy(events: DataFrame, column: str, name: str, seconds: int, mode: str = "tumbling") -> DataFrame:
    """Entropy of any text column (for example the user agent) per feature group."""
    counts = (
        _keyed(events, seconds, mode).where(F.coalesce(F.col(column) != "", F.lit(False))).groupBy(*FEATURE_KEYS, column).agg(F.count(F.lit(1)).alias("c"))
    )
    return counts.groupBy(*FEATURE_KEYS).agg(
        entropy_from(F.sum("c"), F.sum(F.col("c") * F.log2(F.col("c")))).alias(name), F.count(F.lit(1)).alias("distinct_values")
    )


def column_percentile(events: DataFrame, column: str, q: float, name: str, seconds: int, mode: str = "tumbling") -> DataFrame:
    """Rank percentile of any numeric column per feature group (p95 and friends)."""
    from watchloom.functions.ordered import rank_percentile

    return rank_percentile(_keyed(events, seconds, mode), FEATURE_KEYS, column, q, name)


def event_totals(events: DataFrame, seconds: int, mode: str = "tumbling") -> DataFrame:
    """Count forms of the rates: requests, errors (4xx and 5xx) and authentication failures."""
    status = F.col("status")
    return (
        _keyed(events, seconds, mode)
        .groupBy(*FEATURE_KEYS)
        .agg(
            F.count(F.lit(1)).alias("req_count"),
            F.count_if((status >= 400) & (status < 600)).alias("err_count"),
            F.count_if(status.isin(401, 403)).alias("auth_failure_count"),
        )
        .withColumn("err_rate", share(F.col("err_count"), F.col("req_count")))
    )


def distinct_clients_sketch(events: DataFrame, seconds: int = 60, rsd: float = 0.02) -> DataFrame:
    """Approximate distinct clients per window from a mergeable HyperLogLog sketch."""
    return (
        _keyed(events, seconds, "tumbling")
        .groupBy(*FEATURE_KEYS)
        .agg(F.approx_count_distinct(F.nullif(F.col("src_ip"), F.lit("")), rsd).alias("distinct_ips_approx"))
    )


def feature_matrix(features: DataFrame) -> DataFrame:
    """Keys plus the model columns in order, as doubles, null as 0."""
    keys = [k for k in FEATURE_KEYS if k in features.columns]
    return features.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURE_COLUMNS])


def _keyed(events: DataFrame, seconds: int, mode: str) -> DataFrame:
    return (
        events.where(F.col("ts").isNotNull())
        .withColumn("source", filled_null("source"))
        .withColumn("host", filled_null("host"))
        .withColumn("window_end", window_end("ts", seconds, mode))
    )


def filled_null(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("unknown"))


__all__ = [
    "column_entropy",
    "column_percentile",
    "distinct_clients_sketch",
    "event_totals",
    "feature_matrix",
    "filled_or",
    "security_features",
    "window_end",
]
