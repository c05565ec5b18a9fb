"""Every runnable query over the given tables: name -> callable(spark, folder)."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import functions as F

from watchloom.functions.columns import stable_id
from watchloom.functions.pii import pseudonym
from watchloom.operators import alerts as A
from watchloom.operators import drift, edge, evaluate, lookups, parse
from watchloom.operators import timeseries as ts_ops
from watchloom.operators.features import (
    column_entropy,
    column_percentile,
    distinct_clients_sketch,
    event_totals,
    feature_matrix,
    security_features,
)
from watchloom.operators.outliers import reconstruction_error, text_outliers
from watchloom.operators.rules import (
    Rule,
    emit,
    evaluate_rules,
    fired_per_record,
    load_rules,
    with_change,
    with_ewma,
    with_zscore,
)
from watchloom.plans import inputs
from watchloom.plans.inputs import table
from watchloom.plans.registry import CATALOG, at, query, rounded
from watchloom.schema import ALERT_SCHEMA, FEATURE_KEYS, FEATURE_SCHEMA, TIME_FORMAT
from watchloom.session import new_run_dir
from watchloom.sources import envelope, lake
from watchloom.streaming import jobs

DAY, SIX_HOURS = 86400, 21600

# The shipped rules, some with limits that the small tables can reach, and two rules of our own.
REACHED = {"distinct_ip_burst": {"value": 3}, "latency_z_spike": {"threshold": 2.5}}
with warnings.catch_warnings(action="ignore"):  # 4xx_creep never fires; that is what a query here shows
    _SHIPPED = load_rules()
DEMO_RULES = (
    *(replace(r, **REACHED.get(r.name, {})) for r in _SHIPPED),
    Rule("quiet_host", "request_rate", "threshold", "LOW", op="<", value=0.00005),
    Rule("latency_creep", "p99_latency", "ewma", "LOW", alpha=0.05, deviation_sigma=2.5),
)


# ---- features ---------------------------------------------------------------


@query
def features_minute_compat(spark, sf):
    return rounded(security_features(inputs.events(spark, sf)), 6, "entropy_path")


@query
def features_tumbling(spark, sf):
    return rounded(security_features(inputs.events(spark, sf), DAY, "tumbling"), 6, "entropy_path")


@query
def features_sliding(spark, sf):
    return rounded(security_features(inputs.events(spark, sf), DAY, "sliding", SIX_HOURS), 6, "entropy_path")


@query
def p95_variant(spark, sf):
    return column_percentile(inputs.events(spark, sf), "latency_ms", 0.95, "p95_latency", DAY)


@query
def ua_entropy(spark, sf):
    return rounded(column_entropy(inputs.events(spark, sf), "user_agent", "ua_entropy", DAY), 6, "ua_entropy")


@query
def event_counts(spark, sf):
    return event_totals(inputs.events(spark, sf), DAY)


@query
def feature_matrix_rows(spark, sf):
    return rounded(feature_matrix(security_features(inputs.events(spark, sf), SIX_HOURS, "tumbling")), 6, "entropy_path")


@query
def distinct_ips_sketch(spark, sf):
    return distinct_clients_sketch(inputs.events(spark, sf), DAY)


# ---- rules ------------------------------------------------------------------


def six_hour_features(spark, sf):
    return security_features(inputs.events(spark, sf), SIX_HOURS, "tumbling")


def feature_table(spark, sf):
    """The same features as a stored table: the events are aggregated once, then read by several consumers."""
    return lake.materialised(six_hour_features(spark, sf), new_run_dir(spark, "features"))


def anomalies(spark, sf):
    return evaluate_rules(feature_table(spark, sf), DEMO_RULES)


SERIES = ["source", "host"]


@query
def rule_threshold(spark, sf):
    f = six_hour_features(spark, sf)
    return f.select(*FEATURE_KEYS, "rate_5xx", (F.col("rate_5xx") > 0.05).alias("fired"))


@query
def rule_zscore(spark, sf):
    f = six_hour_features(spark, sf).select(*FEATURE_KEYS, F.col("p99_latency").alias("value"))
    z = with_zscore(f, SERIES, ["window_end"])
    fired = (F.col("n") >= 30) & (F.abs("z") > 2.5)
    return rounded(z.withColumn("fired", fired), 6, "z")


@query
def zscore_by_user(spark, sf):
    """z-scores of each user's values, where a series is one user's hourly totals."""
    hourly = table(spark, sf, "events").groupBy("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.sum("value").alias("value"))
    z = with_zscore(hourly, ["user_id"], ["hour"])
    return rounded(z.where((F.col("n") >= 30) & (F.abs("z") > 4.0)), 6, "value", "z")


@query
def rule_rate_of_change(spark, sf):
    f = six_hour_features(spark, sf).select(*FEATURE_KEYS, F.col("auth_failure_rate").alias("value"))
    c = with_change(f, SERIES, ["window_end"])
    return c.withColumn("fired", F.coalesce(F.col("change_pct") > 200, F.lit(False)))


@query
def rule_ewma(spark, sf):
    f = six_hour_features(spark, sf).select(*FEATURE_KEYS, F.col("p99_latency").alias("value"))
    e = with_ewma(f, SERIES, ["window_end"], 0.05)
    return e.withColumn("fired", F.abs("ewma_z") > 2.5)


@query
def rules_all_fired(spark, sf):
    return anomalies(spark, sf)


@query
def rules_shipped(spark, sf):
    return evaluate_rules(feature_table(spark, sf), load_rules())


@query
def rules_per_record(spark, sf):
    f = feature_table(spark, sf)
    per = fired_per_record(f, evaluate_rules(f, DEMO_RULES))
    return per.withColumn("fired", F.array_join("fired", ","))


@query
def anomaly_metric_points(spark, sf):
    points = emit(anomalies(spark, sf))["metric"]
    return points.groupBy("metric_type", F.col("labels")["rule"].alias("rule"), F.col("labels")["source"].alias("source"), "end_time").agg(F.sum("value").alias("value"))


@query
def anomaly_log_rows(spark, sf):
    rows = emit(anomalies(spark, sf))["log"]
    return rows.select("ts", "severity", F.get_json_object("payload", "$.rule").alias("rule"), F.get_json_object("payload", "$.source").alias("source"), F.get_json_object("payload", "$.host").alias("host"))


# ---- parsing and ingest -----------------------------------------------------


@query
def parse_nginx(spark, sf):
    return parse.parse_nginx(inputs.access_lines(spark, sf), read_latency=True).select(
        "event_id", "ts", "source", "host", "message", "status", "latency_ms", "bytes", "src_ip", "path", "user_agent"
    )


@query
def parse_nginx_redacted(spark, sf):
    return parse.parse_nginx(inputs.access_lines(spark, sf), redact_message=True).select("event_id", "message")


@query
def nginx_dead_letters(spark, sf):
    return parse.unparsed_lines(inputs.access_lines(spark, sf))


@query
def parse_lb(spark, sf):
    return parse.parse_lb(inputs.lb_records(spark, sf)).select(
        "event_id", "ts", "source", "host", "message", "status", "latency_ms", "bytes", "src_ip", "path", "user_agent"
    )


@query
def parse_waf(spark, sf):
    return parse.parse_waf(inputs.waf_records(spark, sf)).select(
        "event_id", "ts", "source", "host", "message", "status", "src_ip", "path", "user_agent", F.col("attrs")["action"].alias("action")
    )


@query
def parse_app(spark, sf):
    return parse.parse_app(inputs.app_records(spark, sf)).select(
        "event_id", "ts", "source", "host", "message", "severity", "latency_ms", "status", "user", "path",
        F.col("attrs")["k"].alias("attr_k"), F.col("attrs")["kind"].alias("attr_kind"),
    )


@query
def parse_slowquery(spark, sf):
    return parse.parse_slow_query(inputs.slow_records(spark, sf)).select(
        "event_id", "ts", "source", "host", "message", "severity", F.col("attrs")["slow_query"].alias("slow_query")
    )


@query
def parse_dispatch(spark, sf):
    """Records of five sources in one table, each through its own parser."""
    parts = [("nginx", inputs.access_lines(spark, sf).withColumnRenamed("line", "rec")), ("lb", inputs.lb_records(spark, sf)),
             ("cloud_armor", inputs.waf_records(spark, sf)), ("app", inputs.app_records(spark, sf)), ("cloudsql", inputs.slow_records(spark, sf))]
    mixed = None
    for name, df in parts:
        part = df.withColumn("source", F.lit(name))
        mixed = part if mixed is None else mixed.unionByName(part)
    return parse.parse_by_source(mixed).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("status").alias("with_status"), F.count("src_ip").alias("with_ip"), F.count_distinct("host").alias("hosts"),
    )


@query
def dispatch_rejects(spark, sf):
    """Records that no parser takes, each with its reason."""
    _, bad = parse.split_dispatched(parse.dispatched(inputs.mixed_records(spark, sf)))
    return bad.select("event_id", "source", "reason", F.col("raw").isNull().alias("no_raw"))


@query
def parse_rejects(spark, sf):
    """Per source and reason (none for events) how many records there are: together, all of them."""
    rows = parse.dispatched(inputs.mixed_records(spark, sf))
    return rows.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("records"), F.count("event.ts").alias("events_with_time"))


def _messages(spark, sf):
    return inputs.app_messages(spark, sf).drop("ts", "user_id")


@query
def parse_access_msg(spark, sf):
    return parse.access_fields(_messages(spark, sf))


@query
def parse_login_msg(spark, sf):
    return parse.login_fields(_messages(spark, sf))


@query
def parse_worker_msg(spark, sf):
    return parse.worker_fields(_messages(spark, sf))


@query
def parse_order_msg(spark, sf):
    return parse.order_fields(_messages(spark, sf))


def _loose_sources(spark, sf):
    """Events whose source is sometimes an alias, sometimes unknown."""
    e = inputs.events(spark, sf).select("event_id", "source")
    odd = F.when(F.col("event_id") % 9 == 0, "alb").when(F.col("event_id") % 9 == 1, "cloudfront").when(F.col("event_id") % 9 == 2, "pager")
    return e.select("event_id", F.coalesce(odd, F.col("source")).alias("source"))


@query
def source_validation(spark, sf):
    good, bad = parse.split_valid(_loose_sources(spark, sf))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


@query
def source_canonical(spark, sf):
    return _loose_sources(spark, sf).withColumn("canonical_source", parse.canonical_source("source"))


@query
def pii_hash(spark, sf):
    c = table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 10 == 0, F.lit("")).when(F.col("c_custkey") % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("é-"), F.col("c_name")))
    return c.select("c_custkey", pseudonym(name).alias("hashed"))


@query
def envelope_decode(spark, sf):
    e = inputs.events(spark, sf)
    body = F.to_json(F.struct("ts", "source", "host", "message", "status", "latency_ms", "bytes", "src_ip", "path"), {"timestampFormat": TIME_FORMAT})
    sent = e.select("event_id", envelope.encode_payload(body).alias("data"))
    return envelope.decode_envelope(sent).select("event_id", "ts", "source", "host", "message", "status", "latency_ms", "bytes", "src_ip", "path")


@query
def sink_route(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "cloudsql_database").otherwise("gce_instance")
    log = F.when(F.col("event_type") == "error", "mysql-slow.log").otherwise("mysql.log")
    entries = e.select("event_id", F.concat(F.lit('{"resource":{"type":"'), kind, F.lit('"},"logName":"'), log, F.lit('"}')).alias("rec"))
    sinks = {"slow": ("cloudsql_database", "mysql-slow.log"), "database": ("cloudsql_database", "mysql.log"), "vm": ("gce_instance", "mysql.log")}
    return envelope.route_to_sinks(entries, sinks).drop("rec")


@query
def retention(spark, sf):
    e = inputs.events(spark, sf).withColumn("date", F.to_date("ts"))
    today = at("2024-02-15")
    return e.where(lake.kept("date", today, 30)).groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


@query
def retention_expired(spark, sf):
    return lake.expired_days(inputs.events(spark, sf).withColumn("date", F.to_date("ts")), at("2024-02-15"), days=30)


# ---- alerts -----------------------------------------------------------------


def scored_events(spark, sf):
    return inputs.events(spark, sf).withColumn("anomaly_score", F.col("value") / 50).withColumn(
        "model_flag", (F.col("event_type") == "purchase") & (F.col("value") > 100)
    )


def decided_events(spark, sf):
    return A.route_and_decide(scored_events(spark, sf))


def stored_alerts(spark, sf):
    return A.alerts_from_scores(decided_events(spark, sf), ["event_id"])


def _alert_view(df):
    return df.select("id", "ts", "detector", "severity", "score", "source", "host")


@query
def route_and_decide(spark, sf):
    return decided_events(spark, sf).select("event_id", "source", "detector", "score", "is_anomaly")


@query
def alert_from_score(spark, sf):
    return _alert_view(stored_alerts(spark, sf))


def _payloads(spark, sf):
    e = inputs.events(spark, sf)
    eid = F.col("event_id")
    return e.select(
        F.when(eid % 4 == 0, F.lit("")).when(eid % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit("ext-"), eid)).alias("id"),
        F.date_trunc("second", "ts").alias("ts"),
        F.when(eid % 3 == 0, F.lit("")).when(eid % 3 == 1, F.lit("HIGH")).alias("severity"),
        F.when(eid % 5 == 0, F.lit(None)).when(eid % 5 == 1, F.lit("bad")).otherwise((eid % 8).cast("string")).alias("score"),
        (eid % 6).cast("double").alias("value"),
        F.when(eid % 7 != 2, F.col("source")).alias("source"),
        F.when(eid % 11 != 3, F.col("host")).alias("host"),
        F.concat(F.lit("rule-"), eid).alias("rule"),
        F.lit("p99_latency").alias("metric"),
    )


@query
def alert_from_anomaly(spark, sf):
    return A.alerts_from_anomalies(_payloads(spark, sf)).select(*[c for c in ALERT_SCHEMA.fieldNames() if c != "explanation"])


@query
def source_heartbeats(spark, sf):
    """Last time of each source in an alert store that took two batches."""
    store = new_run_dir(spark, "alert-store")
    payloads = _payloads(spark, sf)
    sink = jobs.alerts_sink(store)
    late = F.col("ts") >= at("2024-01-15")
    sink(payloads.where(late), 0)
    sink(payloads.where(~late), 1)
    return lake.read_heartbeats(spark, store)


@query
def alerts_both_writers(spark, sf):
    both = A.all_alerts(stored_alerts(spark, sf), A.alerts_from_anomalies(_payloads(spark, sf)))
    return both.groupBy("detector", "severity", F.col("rule").isNull().alias("no_rule")).agg(F.count(F.lit(1)).alias("n"))


@query
def alerts_list_compat(spark, sf):
    return _alert_view(A.list_alerts(stored_alerts(spark, sf), severity="HIGH"))


@query
def alerts_list_filtered(spark, sf):
    return _alert_view(A.list_alerts(stored_alerts(spark, sf), since=at("2024-01-10"), source="lb", severity="MEDIUM", limit=50, pushdown=True))


@query
def alert_get(spark, sf):
    wanted = table(spark, sf, "labels").select(stable_id("doc_id").alias("id"))
    return _alert_view(A.get_alerts(stored_alerts(spark, sf), wanted))


@query
def alert_explain_topk(spark, sf):
    f = feature_table(spark, sf)
    return rounded(rounded(A.explain_top_features(f, A.baselines(f)), 7, "observed", "baseline"), 6, "deviation")


@query
def similar_alerts(spark, sf):
    return A.similar_alerts(stored_alerts(spark, sf)).select("source", "recency", "id", "ts", "severity")


def _feedback(spark, sf):
    d = decided_events(spark, sf).where("is_anomaly")
    eid = F.col("event_id")
    first = F.when(eid % 4 == 0, "true_positive").when(eid % 4 == 1, "false_positive").when(eid % 4 == 2, "ignored").otherwise("maybe")
    one = d.select(stable_id("event_id").alias("alert_id"), first.alias("label"), "ts")
    two = d.where(eid % 10 == 0).select(stable_id("event_id").alias("alert_id"), F.lit("false_positive").alias("label"), (F.col("ts") + F.expr("interval 1 hour")).alias("ts"))
    return one.unionByName(two)


@query
def feedback_valid(spark, sf):
    return A.valid_feedback(_feedback(spark, sf))


@query
def feedback_rejected(spark, sf):
    return A.rejected_feedback(_feedback(spark, sf))


@query
def feedback_precision(spark, sf):
    return A.detector_precision(stored_alerts(spark, sf), _feedback(spark, sf))


@query
def source_health(spark, sf):
    return A.source_health(inputs.events(spark, sf), at("2024-01-31"))


@query
def console_tiles(spark, sf):
    return A.console_tiles(stored_alerts(spark, sf), at("2024-01-30 12:00:00"))


@query
def score_counters(spark, sf):
    return A.score_counters(decided_events(spark, sf))


@query
def score_points(spark, sf):
    p = A.score_points(decided_events(spark, sf))
    out = p.groupBy(F.col("labels")["detector"].alias("detector"), F.col("labels")["is_anomaly"].alias("is_anomaly")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_score"))
    return rounded(out, 9, "mean_score")


@query
def alerts_upsert_latest(spark, sf):
    e = inputs.events(spark, sf).select(F.col("user_id").alias("id"), "ts", "source", "value", F.col("event_id").alias("ingest_seq"))
    return A.upsert(e.where(F.col("ts") < at("2024-01-16")), e.where(F.col("ts") >= at("2024-01-16")))


@query
def anomalies_table(spark, sf):
    """Rows per day of the anomalies table; rows that miss a required field have no day."""
    a = stored_alerts(spark, sf).withColumn("severity", F.when(F.col("score") < 9, F.col("severity")))
    good, bad = A.anomaly_rows(a)
    good, bad = good.withColumn("ok", F.lit(True)), bad.withColumn("date", F.lit(None).cast("date")).withColumn("ok", F.lit(False))
    return good.unionByName(bad).groupBy("date", "ok").agg(F.count(F.lit(1)).alias("n"))


# ---- evaluation -------------------------------------------------------------


def eval_set(spark, sf):
    e = table(spark, sf, "events")
    return e.select((F.col("event_type") == "error").cast("int").alias("is_anomaly"), F.col("value").alias("anomaly_score"), F.col("value").alias("recon_error"))


def score_counts(spark, sf):
    """Counts per score, stored: the scored rows are read once, every measure reads this small table."""
    return lake.materialised(evaluate.score_counts(eval_set(spark, sf), "is_anomaly", "anomaly_score"), new_run_dir(spark, "score-counts"))


def labelled_documents(spark, sf):
    d, lb = table(spark, sf, "documents"), table(spark, sf, "labels")
    return lb.join(d.select("doc_id", "n_chars"), "doc_id").select(F.col("toxic").alias("is_anomaly"), F.col("n_chars").cast("double").alias("recon_error"))


@query
def eval_f1_p99(spark, sf):
    return evaluate.f1_at_quantile(score_counts(spark, sf)).drop("note")


@query
def eval_precision_top1(spark, sf):
    return evaluate.precision_at_top(score_counts(spark, sf))


@query
def eval_auc(spark, sf):
    return rounded(evaluate.roc_auc(eval_set(spark, sf)), 9, "auc")


@query
def eval_auc_labels(spark, sf):
    return rounded(evaluate.roc_auc(labelled_documents(spark, sf)), 9, "auc")


@query
def gate_decision(spark, sf):
    return rounded(evaluate.gate(_metrics(spark, sf), evaluate.detector_table(spark)), 9, "value")


def _metrics(spark, sf):
    """What each detector is graded on, from the labelled scores; the fourth has the text set's labels."""
    s = score_counts(spark, sf)
    return (
        evaluate.metric_rows(evaluate.f1_at_quantile(s), "rcf-metrics")
        .unionByName(evaluate.metric_rows(evaluate.precision_at_top(s), "iforest-logs"))
        .unionByName(evaluate.metric_rows(evaluate.roc_auc(s), "lstm-ae-traces"))
        .unionByName(evaluate.metric_rows(evaluate.precision_at_top(labelled_documents(spark, sf), score="recon_error"), "log-embedding-anomaly"))
    )


def _registry(spark, sf):
    names = [d.name for d in evaluate.DETECTORS]
    e = inputs.events(spark, sf).where("event_type = 'signup'")
    return e.select(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("user_id") % 4 + 1).cast("int")).alias("detector"), F.col("event_id").alias("version"), F.col("ts").alias("created"))


@query
def registry_latest(spark, sf):
    return evaluate.served_versions(_registry(spark, sf))


@query
def registry_append(spark, sf):
    """The detectors of ``gate_decision`` that pass at half their limit, with the version after the last registered one."""
    limits = evaluate.detector_table(spark).withColumn("threshold", F.col("threshold") / 2)
    verdicts = evaluate.gate(_metrics(spark, sf), limits)
    rows = evaluate.register_passed(verdicts, F.concat(F.lit("models/"), F.col("detector")), at("2024-02-01"), _registry(spark, sf))
    return rounded(rows, 9, "value")


@query
def retrain_due(spark, sf):
    runs = _registry(spark, sf).select("detector", F.col("created").alias("finished"))
    return evaluate.retrain_due(runs, evaluate.detector_table(spark), at("2024-01-28 01:00:00"))


# ---- time series ------------------------------------------------------------


@query
def ts_rate_sum(spark, sf):
    a = ts_ops.align(inputs.events(spark, sf), ["event_type", "source"], 60, "rate")
    return rounded(ts_ops.reduce_series(a, ["event_type"], "sum"), 9, "reduced")


@query
def ts_rate_total(spark, sf):
    a = ts_ops.align(inputs.events(spark, sf), ["event_type", "source"], 3600, "rate")
    return rounded(ts_ops.reduce_series(a, [], "sum"), 9, "reduced")


@query
def ts_mean_max(spark, sf):
    a = ts_ops.align(inputs.events(spark, sf), ["event_type", "source"], 3600, "mean")
    return rounded(ts_ops.reduce_series(a, ["event_type"], "max"), 9, "reduced")


@query
def ts_percentile_reduce(spark, sf):
    a = ts_ops.align(inputs.events(spark, sf), ["event_type", "source", "host"], 3600, "rate")
    return rounded(ts_ops.reduce_series(a, [], "p95"), 9, "reduced")


def _seconds(spark, sf):
    return inputs.events(spark, sf).withColumn("value", F.col("value") / 100)


@query
def ts_hist_p95(spark, sf):
    points = _seconds(spark, sf).withColumn("at", F.window("ts", "6 hours")["start"])
    h = ts_ops.histogram(points, ["event_type", "at"], ts_ops.REQUEST_BOUNDS)
    return h.select("event_type", "at", ts_ops.histogram_quantile(ts_ops.REQUEST_BOUNDS, 0.95).alias("p95"))


@query
def ts_sustained(spark, sf):
    return rounded(ts_ops.sustained_below(inputs.events(spark, sf), ["source"], 50.0, SIX_HOURS, 3 * SIX_HOURS), 9, "highest")


@query
def counters_by_label(spark, sf):
    return ts_ops.counters(inputs.events(spark, sf), ["event_type", "status"])


@query
def hist_buckets(spark, sf):
    h = ts_ops.histogram(_seconds(spark, sf), ["event_type"], ts_ops.QUERY_BOUNDS)
    return ts_ops.histogram_rows(h, ["event_type"], ts_ops.QUERY_BOUNDS)


@query
def gauge_last(spark, sf):
    return ts_ops.gauge_last(inputs.events(spark, sf), ["source", "host"], "event_id")


@query
def traffic_summary(spark, sf):
    return ts_ops.traffic_summary(inputs.events(spark, sf), ["event_type"])


# ---- lookups ----------------------------------------------------------------


@query
def lake_daily(spark, sf):
    return rounded(lookups.daily_latency(inputs.events(spark, sf), at("2024-01-15")), 9, "avg_latency")


@query
def lake_count(spark, sf):
    return lookups.count_by_source(inputs.events(spark, sf))


@query
def app_stats(spark, sf):
    out = lookups.shop_stats(table(spark, sf, "orders"), table(spark, sf, "customer"), "o_totalprice", "o_orderkey", "c_custkey")
    return rounded(out, 2, "revenue")


@query
def products_ordered(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("stock")).orderBy("id")


@query
def product_by_id(spark, sf):
    return table(spark, sf, "part").where(F.col("p_partkey") == 42).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))


def order_items(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.col("l_linenumber").alias("line"),
    )


def products(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("stock"))


@query
def order_detail(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))
    return lookups.order_detail(o, order_items(spark, sf))


@query
def order_total(spark, sf):
    return rounded(lookups.order_totals(order_items(spark, sf), products(spark, sf)), 3, "total")


@query
def failed_login_streak(spark, sf):
    e = inputs.events(spark, sf).select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("success"))
    return lookups.failed_login_streak(e)


@query
def price_mismatch(spark, sf):
    return lookups.price_mismatches(order_items(spark, sf), products(spark, sf)).select("order_id", "line", "product_id", "unit_price", "price")


@query
def trace_timeline(spark, sf):
    e = inputs.events(spark, sf).withColumn("trace_id", F.floor(F.col("event_id") / 10))
    logs = e.where(F.col("event_type").isin("error", "signup")).withColumn("severity", F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"))
    # every seventh trace lost its spans
    return lookups.trace_timeline(e.where(F.col("trace_id") % 7 != 0), logs)


@query
def logs_with_trace(spark, sf):
    e = inputs.events(spark, sf).withColumn("trace_id", F.floor(F.col("event_id") / 10))
    logs = e.where("event_type = 'error'").select("event_id", "trace_id", "ts")
    return lookups.logs_with_trace(logs, e)


# ---- edge policy ------------------------------------------------------------


# Injections and look-alikes, plain, escaped and with a broken escape.
PAYLOADS = ("x' or 7=7", "9;delete from carts", "id%20union%20all%20select%201", "<script src=//x>", "%3Cimg%20onerror%3Dgo()%3E", "100%zz union select", "union of selectors")


def edge_requests(spark, sf):
    eid = F.col("event_id") % 25
    payload = F.when(eid < len(PAYLOADS), F.get(F.array(*[F.lit(p) for p in PAYLOADS]), eid.cast("int"))).otherwise(F.col("event_type"))
    return inputs.events(spark, sf).select("event_id", "ts", "src_ip", F.concat(F.lit("/api/products?q="), payload).alias("path"))


LIMITS = dict(limit=5, seconds=DAY, ban=2 * DAY)


@query
def edge_rate_ban(spark, sf):
    return edge.rate_bans(edge_requests(spark, sf), **LIMITS).drop("slot")


@query
def edge_banned_events(spark, sf):
    return edge.mark_banned(edge_requests(spark, sf), **LIMITS).where("banned").select("event_id", "src_ip", "ts")


@query
def edge_sqli(spark, sf):
    return edge_requests(spark, sf).select("event_id", "path", edge.is_sqli("path").alias("sqli"))


@query
def edge_xss(spark, sf):
    return edge_requests(spark, sf).select("event_id", "path", edge.is_xss("path").alias("xss"))


@query
def edge_first_match(spark, sf):
    return edge.first_match(edge.mark_banned(edge_requests(spark, sf), **LIMITS)).select("event_id", "priority", "rule", "action")


# ---- drift and models -------------------------------------------------------


def _reference():
    return F.col("ts") < at("2024-01-16")


@query
def drift_mean_shift(spark, sf):
    return rounded(drift.mean_shift(inputs.events(spark, sf), ["value", "bytes"], _reference()), 6, "ref_mean", "ref_std", "cur_mean", "shift")


@query
def drift_kl(spark, sf):
    return rounded(drift.kl_divergence(inputs.events(spark, sf), ["value", "bytes"], _reference()), 9, "kl")


@query
def drift_ks(spark, sf):
    return rounded(drift.ks_statistic(inputs.events(spark, sf), ["value", "bytes"], _reference()), 9, "ks")


@query
def seasonal_z(spark, sf):
    z = drift.seasonal_z(inputs.events(spark, sf), ["source"], threshold=3.0)
    return rounded(z, 4, "value", "expected", "spread", "z")


@query
def tfidf_outliers(spark, sf):
    scored, _ = text_outliers(table(spark, sf, "documents"), ["doc_id"], "text")
    return scored.select("doc_id", "anomaly_score", "is_anomaly", "score_z")


@query
def recon_error(spark, sf):
    f = feature_table(spark, sf).select(*FEATURE_KEYS, "p99_latency")
    return reconstruction_error(f, SERIES, ["window_end"], "p99_latency")


# ---- streams ----------------------------------------------------------------


def _event_source(spark, sf):
    # a pattern, because a stream may name a folder or a pattern but not a single file
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return inputs.as_events(spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]"))


def _stream_features(spark, sf, out):
    jobs.drain(jobs.features_job(_event_source(spark, sf), f"{out}/features", f"{out}/cp-features", SIX_HOURS, "1 hour", every=None))
    jobs.flush_open(spark, f"{out}/features", f"{out}/cp-features", SIX_HOURS)
    return f"{out}/features"


@query
def stream_features(spark, sf):
    path = _stream_features(spark, sf, new_run_dir(spark, "stream-features"))
    return rounded(spark.read.schema(FEATURE_SCHEMA).option("recursiveFileLookup", "true").parquet(path), 6, "entropy_path")


@query
def stream_rules(spark, sf):
    out = new_run_dir(spark, "stream-rules")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    features = jobs.feature_stream(spark, _stream_features(spark, sf, out))
    jobs.drain(jobs.rules_job(features, DEMO_RULES, jobs.anomalies_sink(f"{out}/anomalies"), f"{out}/cp-rules", every=None))
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/anomalies/rows")


@query
def stream_archive(spark, sf):
    out = new_run_dir(spark, "stream-archive")
    e = _event_source(spark, sf).select("ts", "source", "host", "message", "status", "latency_ms", "bytes", "src_ip", "path")
    jobs.drain(jobs.archive(e, f"{out}/raw", f"{out}/cp", every=None))
    back = lake.read_events(spark, f"{out}/raw", partitioned=True)
    return back.select("date", *e.columns)


@query
def flagship(spark, sf):
    """Daily features, threshold and z-score rules, anomalies by time."""
    rules = [Rule("error_rate_spike", "rate_5xx", "threshold", "HIGH", value=0.05), Rule("latency_z_spike", "p99_latency", "zscore", "MEDIUM", threshold=2.5)]
    return evaluate_rules(feature_table(spark, sf), rules).orderBy("ts", "source", "host", "rule")


from watchloom.plans import live, measures  # noqa: E402, F401  (their queries build on those above)

__all__ = ["CATALOG"]
