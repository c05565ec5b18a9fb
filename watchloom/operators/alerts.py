"""Detector routing, decisions, alerts, feedback and source health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.functions.columns import epoch, one_of, share, stable_id
from watchloom.schema import ALERT_SCHEMA, FEATURE_COLUMNS, FEEDBACK_LABELS

ANOMALY_THRESHOLD = 3.0
HIGH_SCORE = 5.0
FRESH_SECONDS = 300
LIST_DEFAULT, LIST_MAX = 100, 1000
NO_ENDPOINT = "no-endpoint"

# The detector that serves each source.
ROUTES = {
    "node_metrics": "rcf-metrics",
    "container_metrics": "rcf-metrics",
    "prom_app": "rcf-metrics",
    "lb": "iforest-logs",
    "cdn": "iforest-logs",
    "cloudsql": "iforest-logs",
    "nginx": "iforest-logs",
    "app": "log-embedding-anomaly",
    "otel_traces": "lstm-ae-traces",
}


def routing_table(spark: SparkSession, routes: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((routes or ROUTES).items()), "source string, endpoint string")


ROUTES_LIMIT = 10_000


def _endpoint_of(events: DataFrame, routing: DataFrame | dict[str, str] | None) -> DataFrame:
    """``events`` with ``endpoint``. Named routes are a literal map and move no row. A table is
    broadcast where it has ROUTES_LIMIT rows at most; a larger one is joined as Spark sees fit."""
    if isinstance(routing, DataFrame):
        small = len(routing.select("source").limit(ROUTES_LIMIT + 1).collect()) <= ROUTES_LIMIT
        return events.join(F.broadcast(routing) if small else routing, "source", "left")
    pairs = [F.lit(x) for pair in (ROUTES if routing is None else routing).items() for x in pair]
    return events.withColumn("endpoint", F.try_element_at(F.create_map(*pairs), F.col("source")) if pairs else F.lit(None).cast("string"))


def route_and_decide(
    events: DataFrame,
    routing: DataFrame | dict[str, str] | None = None,
    score: str = "anomaly_score",
    flag: str = "model_flag",
    threshold: float = ANOMALY_THRESHOLD,
) -> DataFrame:
    """Add detector, score and is_anomaly. A source without a detector scores 0.0.

    ``routing`` is a mapping (ROUTES if left out) or a table of (source, endpoint).
    """
    routed = _endpoint_of(events, routing)
    served = F.coalesce(F.col("endpoint") != "", F.lit(False))
    value = F.when(served, F.coalesce(F.col(score).cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))
    flagged = served & F.coalesce(F.col(flag), F.lit(False))
    return (
        routed.withColumn("detector", F.when(served, F.col("endpoint")).otherwise(F.lit(NO_ENDPOINT)))
        .withColumn("score", value)
        .withColumn("is_anomaly", flagged | (F.col("score") >= threshold))
        .drop("endpoint")
    )


def score_severity(score: Column) -> Column:
    """Severity of a scored event: there is no LOW here."""
    return F.when(score >= HIGH_SCORE, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))


def payload_severity(severity: Column, score: Column) -> Column:
    """Severity of an incoming anomaly: its own if given, else from its score."""
    level = F.coalesce(score, F.lit(0.0))
    from_score = F.when(level >= HIGH_SCORE, "HIGH").when(level >= ANOMALY_THRESHOLD, "MEDIUM").otherwise("LOW")
    return F.coalesce(F.nullif(severity, F.lit("")), from_score)


def alerts_from_scores(decided: DataFrame, id_columns: Sequence[str] | None = None) -> DataFrame:
    """Alerts of the rows that are anomalies.

    Without ``id_columns`` the id hashes the whole row, so two events of one host in one instant keep an alert each.
    """
    if id_columns is None:
        id_columns = sorted(f.name for f in decided.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)))
    explanation = F.col("explanation") if "explanation" in decided.columns else F.lit("{}")
    return decided.where("is_anomaly").select(
        stable_id(*id_columns).alias("id"),
        "ts",
        "detector",
        score_severity(F.col("score")).alias("severity"),
        "score",
        "source",
        "host",
        explanation.alias("explanation"),
    )


def alerts_from_anomalies(anomalies: DataFrame, now: Column | None = None) -> DataFrame:
    """Normalise anomaly payloads to alerts; the score is ``score``, else ``value``."""
    have = set(anomalies.columns)

    def field(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    raw_score = field("score") if "score" in have else field("value")
    if "score" in have and "value" in have:
        raw_score = F.coalesce(F.col("score").cast("string"), F.col("value").cast("string"))
    score = F.coalesce(raw_score.cast("string").try_cast("double"), F.lit(0.0))
    ts = F.coalesce(field("ts").try_cast("timestamp"), F.current_timestamp() if now is None else now)
    out = anomalies.select(
        F.coalesce(F.nullif(field("id").cast("string"), F.lit("")), stable_id(field("source"), field("host"), field("rule"), field("ts"))).alias("id"),
        ts.alias("ts"),
        F.coalesce(field("detector"), F.lit("streaming-statistical")).alias("detector"),
        payload_severity(field("severity"), score).alias("severity"),
        score.alias("score"),
        F.coalesce(field("source"), F.lit("unknown")).alias("source"),
        F.coalesce(field("host"), F.lit("unknown")).alias("host"),
        field("rule").alias("rule"),
        field("metric").alias("metric"),
        F.coalesce(field("explanation"), F.lit("{}")).alias("explanation"),
    )
    return out.select(*ALERT_SCHEMA.fieldNames())


def all_alerts(*parts: DataFrame) -> DataFrame:
    """Alerts from both writers in one table; columns only one of them has are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def list_alerts(
    alerts: DataFrame,
    since: Column | None = None,
    source: str | None = None,
    severity: str | None = None,
    limit: int = LIST_DEFAULT,
    pushdown: bool = False,
) -> DataFrame:
    """Newest alerts first.

    By default the newest ``limit`` alerts are taken before the filters, so a
    filtered list can be shorter than ``limit``; ``pushdown=True`` filters first.
    """
    if not 0 < limit <= LIST_MAX:
        raise ValueError(f"limit must be in 1..{LIST_MAX}")

    def filtered(df: DataFrame) -> DataFrame:
        if since is not None:
            df = df.where(F.col("ts") >= since)
        if source:
            df = df.where(F.col("source") == source)
        if severity:
            df = df.where(F.col("severity") == severity)
        return df

    newest = [F.desc("ts"), F.col("id")]
    return filtered(alerts).orderBy(*newest).limit(limit) if pushdown else filtered(alerts.orderBy(*newest).limit(limit))


def get_alert(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.where(F.col("id") == alert_id)


def get_alerts(alerts: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The alerts whose id is in ``wanted``."""
    return alerts.join(wanted.select(key), key, "left_semi")


def baselines(features: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Mean and population deviation of each feature per key."""
    stats = []
    for c in FEATURE_COLUMNS:
        stats += [F.avg(F.col(c).cast("double")).alias(f"{c}_mean"), F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_std")]
    return features.groupBy(*keys).agg(*stats)


def explain_top_features(features: DataFrame, base: DataFrame, k: int = 3, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Per feature row the k features furthest from their baseline, as ranked rows.

    The candidates are the nine columns of one row, so ranking them is an array
    sort inside the row and needs no shuffle. Deviations equal to six digits are a
    tie, broken by name. ``base`` has a row per source; up to ROUTES_LIMIT of them are broadcast, so the
    features are not shuffled on a few sources. Pass stored features: both sides read them.
    """
    ids = [c for c in features.columns if c not in FEATURE_COLUMNS]
    small = len(base.select(*keys).limit(ROUTES_LIMIT + 1).collect()) <= ROUTES_LIMIT
    joined = features.join(F.broadcast(base) if small else base, list(keys))

    def item(c: str) -> Column:
        observed, mean, std = F.col(c).cast("double"), F.col(f"{c}_mean"), F.col(f"{c}_std")
        away = F.when(std > 0, F.abs(observed - mean) / std).otherwise(F.lit(0.0))
        return F.struct(F.round(-away, 6).alias("order"), F.lit(c).alias("name"), observed.alias("observed"), mean.alias("baseline"), away.alias("deviation"))

    ranked = F.slice(F.array_sort(F.array(*[item(c) for c in FEATURE_COLUMNS])), 1, k)
    return joined.select(*ids, F.posexplode(ranked).alias("pos", "f")).select(
        *ids, (F.col("pos") + 1).alias("rank"), "f.name", "f.observed", "f.baseline", "f.deviation"
    )


def explanation_json(explained: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold ranked features (at most nine per alert) to the explanation document."""
    items = F.sort_array(F.collect_list(F.struct("rank", "name", "observed", "baseline")))
    doc = F.struct(
        F.transform(items, lambda i: F.struct(i["name"].alias("name"), i["observed"].alias("observed"), i["baseline"].alias("baseline"))).alias("top_features"),
        F.map_from_entries(F.transform(items, lambda i: F.struct(i["name"], i["baseline"]))).alias("baseline"),
        F.map_from_entries(F.transform(items, lambda i: F.struct(i["name"], i["observed"]))).alias("observed"),
    )
    return explained.groupBy(*keys).agg(F.to_json(doc).alias("explanation"))


def similar_alerts(alerts: DataFrame, per_source: int = 5) -> DataFrame:
    """The newest alerts of every source, ranked.

    The rank filter is applied inside each map task before the shuffle, so a source
    that holds most alerts sends only a few rows per task.
    """
    w = Window.partitionBy("source").orderBy(F.desc("ts"), "id")
    return alerts.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= per_source)


def explain_alert(alerts: DataFrame, alert_id: str, per_source: int = 5, pushdown: bool = False) -> DataFrame:
    """One alert with its explanation parts and its similar past alerts, one row per similar alert."""
    one = get_alert(alerts, alert_id).select(
        F.col("id").alias("alert_id"),
        "source",
        F.get_json_object("explanation", "$.top_features").alias("top_features"),
        F.get_json_object("explanation", "$.baseline").alias("baseline"),
        F.get_json_object("explanation", "$.observed").alias("observed"),
    )
    recent = similar_alerts(alerts, per_source).drop("recency") if pushdown else list_alerts(alerts, limit=per_source)
    return one.join(recent.select("source", F.col("id").alias("similar_id"), F.col("ts").alias("similar_ts")), "source", "left")


def valid_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.where(one_of("label", FEEDBACK_LABELS))


def rejected_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.where(~one_of("label", FEEDBACK_LABELS))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The last label given to each alert."""
    return latest_by(valid_feedback(feedback), ["alert_id"], [F.desc("ts"), F.col("label")])


def detector_precision(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    """tp / (tp + fp) per detector from the latest labels."""
    labelled = alerts.select(F.col("id").alias("alert_id"), "detector").join(latest_feedback(feedback).select("alert_id", "label"), "alert_id")
    tp, fp = F.count_if(F.col("label") == "true_positive"), F.count_if(F.col("label") == "false_positive")
    return labelled.groupBy("detector").agg(tp.alias("tp"), fp.alias("fp"), F.count_if(F.col("label") == "ignored").alias("ignored")).withColumn(
        "precision", share(F.col("tp"), F.col("tp") + F.col("fp"))
    )


def source_health(seen: DataFrame, now: Column | None = None, ts: str = "ts") -> DataFrame:
    """Last event per source, its lag in seconds, and whether that is fresh."""
    now = F.current_timestamp() if now is None else now
    lag = F.floor(epoch(now)) - F.floor(epoch(F.col("last_seen")))
    return (
        seen.groupBy("source").agg(F.max(ts).alias("last_seen")).withColumn("lag_sec", lag).withColumn("fresh", F.col("lag_sec") < FRESH_SECONDS)
    )


def console_tiles(alerts: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """Totals of the last hour: all, HIGH, MEDIUM, distinct detectors (one row)."""
    recent = alerts.where(F.col("ts") > now - F.expr(f"interval {seconds} seconds"))
    # few detectors exist: fold to one row each, then total, so nothing large meets in one task
    per = recent.groupBy("detector").agg(
        F.count(F.lit(1)).alias("c"), F.count_if(F.col("severity") == "HIGH").alias("h"), F.count_if(F.col("severity") == "MEDIUM").alias("m")
    )
    zero = F.lit(0).cast("bigint")
    return per.agg(
        F.coalesce(F.sum("c"), zero).alias("total"), F.coalesce(F.sum("h"), zero).alias("high"),
        F.coalesce(F.sum("m"), zero).alias("medium"), F.count("detector").alias("detectors"),
    )


def score_counters(decided: DataFrame) -> DataFrame:
    return decided.groupBy("source", F.when(F.col("is_anomaly"), "true").otherwise("false").alias("is_anomaly")).agg(F.count(F.lit(1)).alias("n"))


def score_points(decided: DataFrame) -> DataFrame:
    """Metric points of scoring: one per event, value = score."""
    return decided.select(
        F.lit("scoring/anomalies").alias("metric_type"),
        F.create_map(
            F.lit("detector"), F.col("detector"), F.lit("source"), F.col("source"),
            F.lit("is_anomaly"), F.when(F.col("is_anomaly"), "true").otherwise("false"),
        ).alias("labels"),
        F.col("score").alias("value"),
        F.date_trunc("second", "ts").alias("end_time"),
    )


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order.

    Spark turns row_number() = 1 into a per-task group limit before the shuffle, so
    a key with very many copies sends one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def upsert(current: DataFrame | None, incoming: DataFrame, key: str = "id", version: str = "ingest_seq") -> DataFrame:
    """Newest row per key over stored and incoming rows."""
    both = incoming if current is None else current.unionByName(incoming, allowMissingColumns=True)
    ties = [F.col(c) for c in sorted(both.columns) if c not in (key, version) and not both.schema[c].dataType.typeName().startswith("map")]
    return latest_by(both, [key], [F.desc(version), *ties])


def anomaly_rows(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows fit for the anomalies table with their day, rows missing a required field)."""
    from watchloom.schema import ANOMALY_OPTIONAL, ANOMALY_REQUIRED

    complete = F.lit(True)
    for c in ANOMALY_REQUIRED:
        complete = complete & F.col(c).isNotNull()
    rows = alerts.select(*ANOMALY_REQUIRED, *ANOMALY_OPTIONAL)
    return rows.where(complete).withColumn("date", F.to_date("ts")), rows.where(~complete)


