"""Queries over cumulative counters, stored sketches and trained detectors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchloom.functions.columns import epoch
from watchloom.operators import alerts, counters, drift, evaluate, sketches
from watchloom.operators import timeseries as ts_ops
from watchloom.operators.forest import Forest, fit_forest, score_forest
from watchloom.operators.rules import Rule, evaluate_rules, fired_per_record
from watchloom.plans import catalog as base
from watchloom.plans import inputs
from watchloom.plans.oracle import EVENTS, ORACLE, SIX_F, floor_ts
from watchloom.plans.registry import at, query, rounded
from watchloom.schema import FEATURE_KEYS
from watchloom.session import new_run_dir
from watchloom.sources import lake

HOUR, SIX_HOURS, DAY = 3600, 21600, 86400
KINDS = ["event_type", "source"]

# ---- cumulative counters ----------------------------------------------------

RESTART = 5 * DAY  # the counters of the given events start anew that often


def running_totals(spark, sf):
    """The events as cumulative points: per (event_type, source) the count and the latency histogram since the last restart."""
    e = inputs.events(spark, sf).withColumn("seconds", F.col("value") / 100)
    since = Window.partitionBy(*KINDS, F.floor(epoch("ts") / RESTART)).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cells = [F.count_if(F.col("seconds") <= b).over(since).cast("double").alias(f"le_{i}") for i, b in enumerate(ts_ops.REQUEST_BOUNDS)]
    total = F.count(F.lit(1)).over(since).cast("double")
    return e.select(*KINDS, "ts", total.alias("value"), *cells, total.alias("total"), F.sum("seconds").over(since).alias("sum"))


@query
def counter_rate_sum(spark, sf):
    """Rate of each counter per hour, added up per event type."""
    aligned = counters.align_counter(running_totals(spark, sf), KINDS, HOUR, "rate", stale=DAY)
    return rounded(ts_ops.reduce_series(aligned, ["event_type"], "sum"), 9, "reduced")


@query
def counter_rate_total(spark, sf):
    aligned = counters.align_counter(running_totals(spark, sf), KINDS, SIX_HOURS, "rate", stale=DAY)
    return rounded(ts_ops.reduce_series(aligned, [], "sum"), 9, "reduced")


@query
def counter_delta_p95(spark, sf):
    """95th percentile over the series of what each counted per six hours."""
    aligned = counters.align_counter(running_totals(spark, sf), KINDS, SIX_HOURS, "delta", stale=DAY)
    return rounded(ts_ops.reduce_series(aligned, [], "p95"), 6, "reduced")


@query
def counter_resets(spark, sf):
    """Growth and restarts of each series per day."""
    return rounded(counters.counter_growth(running_totals(spark, sf), KINDS, DAY, stale=DAY), 6, "value")


@query
def histogram_delta_p95(spark, sf):
    """95th percentile of the latencies that each window took in, from cumulative histograms."""
    out = counters.delta_quantile(running_totals(spark, sf), KINDS, ["event_type"], SIX_HOURS, ts_ops.REQUEST_BOUNDS, 0.95, "p95", stale=DAY)
    return rounded(out, 6, "p95", "total")


_LES = [f"le_{i}" for i in range(len(ts_ops.REQUEST_BOUNDS))]


def _grown(seconds: int, values: list[str], stale: int = DAY) -> str:
    """CTEs ending in g: (event_type, source, at, values, resets) by lag over all points of a series and an explosion of the time between."""
    us, lagged = seconds * 1_000_000, ", ".join(f"lag({v}) over w as p_{v}" for v in values)
    reset = " or ".join(f"{v} < p_{v}" for v in values)
    inc = ", ".join(f"case when p_ts is null then 0 when {reset} then {v} else {v} - p_{v} end as i_{v}" for v in values)
    les = ", ".join(f"cast(count(*) filter (value / 100 <= {b!r}) over s as double) as le_{i}" for i, b in enumerate(ts_ops.REQUEST_BOUNDS))
    return f"""{EVENTS},
t as (select event_type, source, ts, cast(count(*) over s as double) as value, {les}, cast(count(*) over s as double) as total, sum(value / 100) over s as "sum"
  from ev window s as (partition by event_type, source, epoch_us(ts) // {RESTART * 1_000_000} order by ts, event_id rows unbounded preceding)),
l as (select *, lag(ts) over w as p_ts, {lagged} from t window w as (partition by event_type, source order by ts, {", ".join(values)})),
i as (select event_type, source, epoch_us(ts) as e, epoch_us(p_ts) as b, coalesce({reset}, false) as reset, {inc} from l),
x as (select *, unnest(case when b is null or e = b or e - b > {stale * 1_000_000} then [e // {us}] else range(b // {us}, e // {us} + 1) end) as slot,
  b is null or e = b or e - b > {stale * 1_000_000} as whole from i),
p as (select event_type, source, slot, case when whole then 1.0 else (least(e, (slot + 1) * {us}) - greatest(b, slot * {us})) / cast(e - b as double) end as share,
  reset and slot = e // {us} as reset, {", ".join(f"i_{v}" for v in values)} from x),
g as (select event_type, source, make_timestamp(slot * {us}) as "at", {", ".join(f'sum(i_{v} * share) as "{v}"' for v in values)}, count(*) filter (reset) as resets from p group by all)"""


ORACLE["counter_rate_sum"] = f"""with {_grown(HOUR, ['value'])} select event_type, "at", round(sum(value / {HOUR}), 9) as reduced from g group by all"""
ORACLE["counter_rate_total"] = f"""with {_grown(SIX_HOURS, ['value'])} select "at", round(sum(value / {SIX_HOURS}), 9) as reduced from g group by all"""
ORACLE["counter_delta_p95"] = f"""with {_grown(SIX_HOURS, ['value'])} select "at", round(quantile_cont(value, 0.95), 6) as reduced from g group by all"""
ORACLE["counter_resets"] = f"""with {_grown(DAY, ['value'])} select event_type, source, "at", round(value, 6) as value, resets from g"""


def _quantile(q: float) -> str:
    out = f"{ts_ops.REQUEST_BOUNDS[-1]!r}"
    for i in reversed(range(len(ts_ops.REQUEST_BOUNDS))):
        low, before = (ts_ops.REQUEST_BOUNDS[i - 1], f"le_{i - 1}") if i else (0.0, "0")
        width = ts_ops.REQUEST_BOUNDS[i] - low
        out = f"case when le_{i} >= total * {q} then coalesce({low!r} + {width!r} * (total * {q} - {before}) / nullif(le_{i} - {before}, 0), {low!r}) else {out} end"
    return f"case when total > 0 then {out} end"


ORACLE["histogram_delta_p95"] = f"""with {_grown(SIX_HOURS, [*_LES, "total", "sum"])},
h as (select event_type, "at", {", ".join(f"sum({c}) as {c}" for c in [*_LES, "total"])} from g group by all)
select event_type, "at", round({_quantile(0.95)}, 6) as p95, round(total, 6) as total from h"""

# ---- sketches ---------------------------------------------------------------


def stored_sketches(spark, sf):
    """A sketch of the clients of each (source, host) and minute, as a stored table."""
    path = new_run_dir(spark, "sketches")
    sketches.write_sketches(sketches.minute_sketches(inputs.events(spark, sf)), path)
    return path


def _judged(exact, estimate, keys):
    """How many there are, and whether the estimate is within the stated bound."""
    both = exact.join(estimate, keys, "full")
    away = F.abs(F.col("estimate") - F.col("clients"))
    return both.select(*keys, "clients", F.coalesce(away <= F.greatest(F.lit(0.5), F.col("clients") * sketches.error_bound()), F.lit(False)).alias("within_bound"))


@query
def distinct_ips_sliding(spark, sf):
    """Clients of the last day at every sixth hour, from stored minutes, against the exact number."""
    keys = ["source", "host", "window_end"]
    estimate = sketches.sliding_distinct(sketches.read_sketches(spark, stored_sketches(spark, sf)), keys[:2], DAY, SIX_HOURS)
    exact = inputs.events(spark, sf).withColumn("window_end", F.window("ts", f"{DAY} seconds", f"{SIX_HOURS} seconds")["end"])
    return _judged(exact.groupBy(*keys).agg(F.count_distinct("src_ip").alias("clients")), estimate, keys)


@query
def distinct_ips_all_sources(spark, sf):
    """Clients of each day over all sources and hosts: sketches of hosts unite without their events."""
    stored = sketches.read_sketches(spark, stored_sketches(spark, sf)).withColumn("day", F.to_date("at"))
    exact = inputs.events(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("src_ip").alias("clients"))
    return _judged(exact, sketches.united(stored, ["day"]).select("day", "estimate"), ["day"])


@query
def distinct_ips_last(spark, sf):
    """Clients in the week before a point in time, read from the stored days that hold it."""
    now, keys = at("2024-01-20 12:30:00"), ["source", "host"]
    estimate = sketches.last_distinct(spark, stored_sketches(spark, sf), now, 7 * DAY)
    exact = inputs.events(spark, sf).where((F.col("ts") < now) & (F.col("ts") >= now - F.expr("interval 7 days")))
    return _judged(exact.groupBy(*keys).agg(F.count_distinct("src_ip").alias("clients")), estimate, keys)


ORACLE["distinct_ips_sliding"] = f"""with {EVENTS},
s as (select source, host, src_ip, {floor_ts(SIX_HOURS)} - i * interval {SIX_HOURS} second + interval {DAY} second as window_end from ev, range({DAY // SIX_HOURS}) r(i))
select source, host, window_end, count(distinct src_ip) as clients, true as within_bound from s group by all"""
ORACLE["distinct_ips_all_sources"] = f"with {EVENTS} select cast(ts as date) as day, count(distinct src_ip) as clients, true as within_bound from ev group by all"
ORACLE["distinct_ips_last"] = f"""with {EVENTS} select source, host, count(distinct src_ip) as clients, true as within_bound from ev
where ts < timestamp '2024-01-20 12:30:00' and ts >= timestamp '2024-01-13 12:30:00' group by all"""

# ---- forest and the chain from scores to the registry ------------------------

TREES, PSI, LIMIT, SEED, SPARE = 100, 256, 8, 42, 4


def forest_features(spark, sf):
    # the last digits of an entropy depend on the order of addition, and a tree would split on them
    return lake.materialised(rounded(base.six_hour_features(spark, sf), 6, "entropy_path"), new_run_dir(spark, "forest-features"))


def forest_scored(spark, sf):
    f = forest_features(spark, sf)
    return score_forest(f, fit_forest(f, FEATURE_KEYS, trees=TREES, psi=PSI, seed=SEED))


@query
def forest_scores(spark, sf):
    return rounded(rounded(forest_scored(spark, sf).select(*FEATURE_KEYS, "anomaly_score", "is_anomaly", "score_z"), 9, "anomaly_score"), 6, "score_z")


@query
def detector_chain(spark, sf):
    """Score, label, evaluate, gate, register: what the registry holds after two rounds, the second of which everything passes.

    A window is labelled anomalous if more than a tenth of its requests failed in the server.
    """
    scored = forest_scored(spark, sf).select((F.col("rate_5xx") > 0.1).cast("int").alias("is_anomaly"), "anomaly_score")
    counts = lake.materialised(evaluate.score_counts(scored, "is_anomaly", "anomaly_score"), new_run_dir(spark, "score-counts"))
    graded = (
        evaluate.metric_rows(evaluate.f1_at_quantile(counts), "rcf-metrics")
        .unionByName(evaluate.metric_rows(evaluate.precision_at_top(counts), "iforest-logs"))
        .unionByName(evaluate.metric_rows(evaluate.roc_auc(counts), "lstm-ae-traces"))
    )
    limits = evaluate.detector_table(spark).where(F.col("detector").isin("rcf-metrics", "iforest-logs", "lstm-ae-traces"))
    registry = new_run_dir(spark, "registry")
    for limit in (0.75, 0.0):
        verdicts = evaluate.gate(graded, limits.withColumn("threshold", F.col("threshold") * limit))
        rows = evaluate.register_passed(verdicts, F.concat(F.lit("models/"), F.col("detector")), at("2024-02-01")).withColumn("limit", F.lit(limit))
        evaluate.commit_versions(rows, registry)
    return rounded(evaluate.read_registry(spark, registry).select("detector", "model_path", "created", "metric", "value", "limit", "version"), 6, "value")


@query
def forest_reloaded(spark, sf):
    """Scores of a forest that was saved and loaded again: those of the one that was fitted."""
    f, path = forest_features(spark, sf), new_run_dir(spark, "forest-model")
    fit_forest(f, FEATURE_KEYS, trees=TREES, psi=PSI, seed=SEED).save(spark, path)
    return rounded(score_forest(f, Forest.load(spark, path)).select(*FEATURE_KEYS, "anomaly_score", "is_anomaly"), 9, "anomaly_score")


def _unit(text: str) -> str:
    return f"(cast('0x' || substr(md5({text}), 1, 13) as bigint) / 4503599627370496.0::double)"


def _forest_sql() -> str:
    """CTEs ending in scored: the forest grown level by level, all rows walked down all trees."""
    cols = ["request_rate", "rate_4xx", "rate_5xx", "auth_failure_rate", "distinct_ips", "distinct_paths", "p99_latency", "bytes_p99", "round(entropy_path, 6)"]
    x = ", ".join(f"cast(coalesce({c}, 0) as double)" for c in cols)
    n = len(cols)
    lows, highs = ", ".join(f"min(x[{i}])" for i in range(1, n + 1)), ", ".join(f"max(x[{i}])" for i in range(1, n + 1))
    levels = []
    for d in range(LIMIT):
        levels.append(f"""
a{d} as materialized (select tree, node, count(*) as size, [{lows}] as lo, [{highs}] as hi from r{d} group by tree, node),
b{d} as (select *, list_filter(range(1, {n + 1}), lambda i: hi[i] > lo[i]) as usable from a{d}),
c{d} as (select *, usable[1 + cast(floor({_unit(f"'{SEED}|' || tree || '|' || node || '|f'")} * len(usable)) as int)] as f from b{d} where size > 1 and len(usable) > 0),
d{d} as materialized (select tree, node, f, lo[f] + {_unit(f"'{SEED}|' || tree || '|' || node || '|c'")} * (hi[f] - lo[f]) as cut from c{d}),
n{d} as materialized (select a{d}.tree, a{d}.node, {d} as depth, a{d}.size, case when cut > lo[f] then f end as f, cut from a{d} left join d{d} on a{d}.tree = d{d}.tree and a{d}.node = d{d}.node),
r{d + 1} as materialized (select r{d}.tree, 2 * r{d}.node + case when x[f] < cut then 0 else 1 end as node, x from r{d} join n{d} on r{d}.tree = n{d}.tree and r{d}.node = n{d}.node where f is not null),""")
    walks = []
    for d in range(LIMIT):
        walks.append(f"""
w{d + 1} as materialized (select k, w.tree, case when f is null then w.node when x[f] < cut then 2 * w.node else 2 * w.node + 1 end as node, x from w{d} w left join nodes m on w.tree = m.tree and w.node = m.node),""")
    every = " union all ".join(f"select tree, node, depth, size, f, cut from n{d}" for d in range(LIMIT))
    length = "case when size <= 1 then 0 when size = 2 then 1 else 2 * (ln(size - 1) + 0.5772156649015329) - 2 * (size - 1) / cast(size as double) end"
    return f"""{SIX_F},
keyed as materialized (select source, host, window_end, rate_5xx, source || '|' || host || '|' || epoch_us(window_end) as k, [{x}] as x from f),
size as (select count(*) as n, least(1.0, {SPARE * PSI * TREES} / cast(count(*) as double)) as share from keyed),
pool as (select k, x, n * share as kept, source, host, window_end from keyed, size where {_unit(f"'{SEED}|' || k")} < share),
drawn as (select k, x, tree, source, host, window_end from pool, range({TREES}) t(tree) where {_unit(f"'{SEED + 1}|' || tree || '|' || k")} < least(1.0, {SPARE * PSI} / kept)),
r0 as materialized (select tree, 1 as node, x from drawn qualify row_number() over (partition by tree order by md5('{SEED + 2}|' || tree || '|' || k), source, host, window_end) <= {PSI}),{"".join(levels)}
last as (select tree, node, {LIMIT} as depth, count(*) as size, null::int as f, null::double as cut from r{LIMIT} group by tree, node),
nodes as materialized ({every} union all select * from last),
w0 as (select k, tree, 1 as node, x from keyed, range({TREES}) t(tree)),{"".join(walks)}
paths as (select k, sum(depth + {length}) / {TREES} as path from w{LIMIT} w join nodes m on w.tree = m.tree and w.node = m.node group by k),
norm as (select 2 * (ln({PSI} - 1) + 0.5772156649015329) - 2 * ({PSI} - 1) / {PSI}.0 as c),
raw as materialized (select source, host, window_end, rate_5xx, round(pow(2, -path / c), 12) as anomaly_score from paths join keyed using (k), norm),
fit as (select avg(anomaly_score) as m, stddev_pop(anomaly_score) as s, quantile_cont(anomaly_score, 0.99) as cut from raw),
scored as materialized (select *, anomaly_score > cut as is_anomaly, (anomaly_score - m) / s as score_z from raw, fit)"""


ORACLE["forest_scores"] = f"with {_forest_sql()} select source, host, window_end, round(anomaly_score, 9) as anomaly_score, is_anomaly, round(score_z, 6) as score_z from scored"
ORACLE["forest_reloaded"] = f"with {_forest_sql()} select source, host, window_end, round(anomaly_score, 9) as anomaly_score, is_anomaly from scored"
ORACLE["detector_chain"] = f"""with {_forest_sql()},
y as materialized (select rate_5xx > 0.1 as y, anomaly_score as s, cut from scored),
c as (select count(*) filter (s > cut and y) as tp, count(*) filter (s > cut and not y) as fp, count(*) filter (s <= cut and y) as fn,
  count(*) filter (s >= cut and y) as hit, count(*) filter (s >= cut) as top from y),
u as (select sum(case when a.s > b.s then 1.0 when a.s = b.s then 0.5 else 0 end) as u, count(*) as pairs from y a, y b where a.y and not b.y),
m as (select 'rcf-metrics' as detector, 'f1' as metric, case when 2 * tp + fp + fn > 0 then 2 * tp / cast(2 * tp + fp + fn as double) else 0 end as value, 0.7 as threshold from c
  union all select 'iforest-logs', 'precision_top1pct', case when top > 0 then hit / cast(top as double) else 0 end, 0.8 from c
  union all select 'lstm-ae-traces', 'auc', case when pairs > 0 then u / pairs else 0 end, 0.8 from u),
p as (select *, threshold * lim as bar, lim as "limit" from m, (values (0.75::double, 1), (0.0::double, 2)) l(lim, round) where value >= threshold * lim)
select detector, 'models/' || detector as model_path, timestamp '2024-02-01' as created, metric, round(value, 6) as value, "limit",
  row_number() over (partition by detector order by round) as version from p"""

# ---- files of the lake --------------------------------------------------------


def _file_system(spark, path):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return hadoop, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


@query
def retention_objects(spark, sf):
    """Rows per day of a lake after the files older than 30 days went; each file was written on its day."""
    path = new_run_dir(spark, "objects")
    lake.write_raw_events(inputs.events(spark, sf).select("ts", "source", "host", "message"), path)
    hadoop, system = _file_system(spark, path)
    for r in lake.objects(spark, path).select("file", F.unix_millis(F.regexp_extract("file", r"date=([0-9-]+)", 1).cast("timestamp")).alias("ms")).toLocalIterator():
        system.setTimes(hadoop.Path(r["file"]), r["ms"], -1)
    lake.delete_objects(lake.expired_objects(spark, path, at("2024-02-15"), days=30))
    return spark.read.option("basePath", path).json(path).groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


ORACLE["retention_objects"] = "select cast(ts as date) as date, count(*) as rows from events where cast(ts as date) >= date '2024-01-16' group by 1"


def _scanned_lines(spark, sf):
    """A folder of event lines, some of them broken: a third of them as .json, .jsonl and, for others to read, .txt."""
    path = new_run_dir(spark, "lines")
    e = inputs.events(spark, sf)
    line = F.to_json(F.struct("ts", "source", "host", "message", "status", "latency_ms"))
    line = F.when(F.col("event_id") % 23 == 0, F.substring(line, 1, 30)).otherwise(line)
    kind = F.element_at(F.array(F.lit("json"), F.lit("jsonl"), F.lit("txt")), (F.col("event_id") % 3 + 1).cast("int"))
    e.select(line.alias("value"), kind.alias("kind")).write.partitionBy("kind").text(path)
    hadoop, system = _file_system(spark, path)
    for r in lake.objects(spark, path).select("file").toLocalIterator():
        suffix = r["file"].split("kind=")[1].split("/")[0]
        system.rename(hadoop.Path(r["file"]), hadoop.Path(r["file"].removesuffix(".txt") + f".{suffix}"))
    return path


@query
def lake_scan_rejects(spark, sf):
    """Events and rejects of a scan by the suffix of the file that they came from: together all lines with a suffix of the lake."""
    good, bad = lake.split_corrupt(lake.read_events(spark, _scanned_lines(spark, sf), strict=False, named=True))
    rows = good.select("file", F.lit(True).alias("ok"), F.col("ts").isNotNull().alias("timed")).unionByName(bad.select("file", F.lit(False).alias("ok"), F.lit(False).alias("timed")))
    return rows.groupBy(F.regexp_extract("file", r"\.([a-z]+)$", 1).alias("suffix"), "ok").agg(F.count(F.lit(1)).alias("lines"), F.count_if("timed").alias("timed"))


ORACLE["lake_scan_rejects"] = """select case event_id % 3 when 0 then 'json' else 'jsonl' end as suffix, event_id % 23 <> 0 as ok, count(*) as lines,
  count(*) filter (event_id % 23 <> 0) as timed from events where event_id % 3 < 2 group by all"""

@query
def feature_store(spark, sf):
    """Features written by day, those of the first half of the month written again after a correction, then validated and read."""
    path = new_run_dir(spark, "feature-store")
    f = base.feature_table(spark, sf)
    lake.write_features(f, path)
    lake.write_features(f.where(F.col("window_end") < at("2024-01-16")).withColumn("request_rate", F.lit(0.0)), path)
    stored = lake.read_features(spark, path)
    n_rows = evaluate.validate_input(stored, min_rows=1)["n_rows"]
    return rounded(stored.withColumn("n_rows", F.lit(n_rows).cast("long")), 6, "entropy_path")


ORACLE["feature_store"] = f"""with {SIX_F} select source, host, window_end, case when window_end < timestamp '2024-01-16' then 0e0 else request_rate end as request_rate,
  rate_4xx, rate_5xx, auth_failure_rate, distinct_ips, distinct_paths, p99_latency, bytes_p99, round(entropy_path, 6) as entropy_path, count(*) over () as n_rows from f"""


@query
def rules_unknown_type(spark, sf):
    """A rule of a type that nobody knows never fires and hinders no other."""
    rules = [Rule("forecast_gap", "rate_5xx", "forecast", "HIGH", value=0.0), Rule("error_rate_spike", "rate_5xx", "threshold", "HIGH", value=0.05)]
    return fired_per_record(f := base.feature_table(spark, sf), evaluate_rules(f, rules)).select(*FEATURE_KEYS, F.array_join("fired", ",").alias("fired"), "n")


ORACLE["rules_unknown_type"] = f"""with {SIX_F} select coalesce(source, 'unknown') as source, coalesce(host, 'unknown') as host, window_end,
  case when rate_5xx > 0.05 then 'error_rate_spike' else '' end as fired, cast(case when rate_5xx > 0.05 then 1 else 0 end as bigint) as n from f"""

# ---- drift against a stored reference -----------------------------------------


@query
def drift_profile(spark, sf):
    """The second half of the month against the stored profile of the first half."""
    e = inputs.events(spark, sf)
    stored = lake.materialised(drift.profile(e.where(F.col("ts") < at("2024-01-16")), ["value", "bytes"]), new_run_dir(spark, "profile"))
    return rounded(drift.against_profile(e.where(F.col("ts") >= at("2024-01-16")), stored), 6, "shift", "kl", "ks")


ORACLE["drift_profile"] = f"""with {EVENTS},
l as (select 'value' as feature, value as v, ts < timestamp '2024-01-16' as ref from ev where value is not null
  union all select 'bytes', bytes, ts < timestamp '2024-01-16' from ev where bytes is not null),
s as (select feature, count(*) as n, avg(v) as mean, stddev_pop(v) as std, min(v) as lo, max(v) as hi from l where ref group by feature),
b as (select l.feature, ref, v, least(greatest(floor((v - lo) / ((hi - lo) / {drift.PROFILE_BINS})), 0), {drift.PROFILE_BINS - 1}) as bin from l join s using (feature)),
g as (select feature, bin from s, range({drift.PROFILE_BINS}) r(bin)),
c as (select g.feature, g.bin, count(*) filter (ref) as q, count(*) filter (not ref) as p from g left join b on g.feature = b.feature and g.bin = b.bin group by all),
t as (select *, sum(p) over (partition by feature) as np, sum(q) over (partition by feature) as nq,
  sum(p) over w as cp, sum(q) over w as cq from c window w as (partition by feature order by bin rows unbounded preceding)),
d as (select feature, max(nq) as n_ref, max(np) as n_cur, max(abs(cp / np - cq / nq)) as ks,
  sum((p + 1) / (np + {drift.PROFILE_BINS}) * ln(((p + 1) / (np + {drift.PROFILE_BINS})) / ((q + 1) / (nq + {drift.PROFILE_BINS})))) as kl from t group by feature),
m as (select feature, avg(v) as cur from l where not ref group by feature)
select feature, cast(n_ref as bigint) as n_ref, cast(n_cur as bigint) as n_cur, round(abs(cur - mean) / std, 6) as shift, abs(cur - mean) / std >= 3 as drifted, round(kl, 6) as kl, round(ks, 6) as ks
from d join s using (feature) join m using (feature)"""

# ---- conditions ---------------------------------------------------------------


@query
def ts_any_condition(spark, sf):
    """Sources for which one of two sustained conditions held, and which: low means, or few events."""
    e = inputs.events(spark, sf)
    low = ts_ops.sustained_below(e, ["source"], 50.0, SIX_HOURS, 3 * SIX_HOURS)
    few = ts_ops.sustained_below(e.withColumn("value", (F.col("event_type") == "error").cast("double")), ["source"], 0.1, SIX_HOURS, 2 * SIX_HOURS)
    hit = ts_ops.any_condition(low, few, series=["source"])
    return hit.select("source", F.concat_ws(",", F.transform("conditions", lambda c: c.cast("string"))).alias("conditions"))


def _islands(value: str, limit: float, windows: int) -> str:
    us = SIX_HOURS * 1_000_000
    return f"""select distinct source from (select source, slot - row_number() over (partition by source order by slot) as island
  from (select source, epoch_us(ts) // {us} as slot, avg({value}) as m from ev group by all) where m < {limit}) group by source, island having count(*) >= {windows}"""


ORACLE["ts_any_condition"] = f"""with {EVENTS}, c as (select source, 0 as i from ({_islands("value", 50.0, 3)}) union all
select source, 1 from ({_islands("case when event_type = 'error' then 1.0 else 0 end", 0.1, 2)}))
select source, string_agg(cast(i as varchar), ',' order by i) as conditions from c group by source"""

# ---- alerts explained ----------------------------------------------------------

TOP, SIMILAR = 3, 4


@query
def alert_explained(spark, sf):
    """Every alert of a rule as one answer: its explanation document, read back, and the newest alerts of its source."""
    f = base.feature_table(spark, sf)
    hits = evaluate_rules(f, [Rule("error_rate_spike", "rate_5xx", "threshold", "HIGH", value=0.05)])
    documents = alerts.explanation_json(alerts.explain_top_features(f, alerts.baselines(f), TOP), list(FEATURE_KEYS))
    found = hits.join(documents.withColumnRenamed("window_end", "ts"), ["source", "host", "ts"])
    found = lake.materialised(found.withColumn("id", F.concat_ws("/", "source", "host", F.unix_seconds("ts"))), new_run_dir(spark, "explained"))
    like = alerts.similar_alerts(found, SIMILAR).groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("recency", "id"))), lambda x: x["id"]), " ").alias("similar"))
    read = F.from_json("explanation", "top_features array<struct<name string, observed double, baseline double>>, baseline map<string,double>")
    return (
        found.join(like, "source")
        .withColumn("_e", read)
        .select(
            "id", "source", "host", "ts", F.array_join("_e.top_features.name", " ").alias("names"), F.round(F.get("_e.top_features.observed", F.lit(0)), 6).alias("observed"),
            F.round(F.get("_e.top_features.baseline", F.lit(0)), 6).alias("baseline"), F.size("_e.baseline").alias("baselines"), "similar",
        )
    )


_NINE = "request_rate rate_4xx rate_5xx auth_failure_rate distinct_ips distinct_paths p99_latency bytes_p99 entropy_path".split()
ORACLE["alert_explained"] = f"""with {SIX_F}, u as ({" union all ".join(f"select source, host, window_end, '{c}' as name, cast({c} as double) as observed from f" for c in _NINE)}),
b as (select source, name, avg(observed) as baseline, stddev_pop(observed) as sd from u group by all),
d as (select u.*, baseline, case when sd > 0 then abs(observed - baseline) / sd else 0e0 end as deviation from u join b using (source, name)),
r as (select *, row_number() over (partition by source, host, window_end order by round(0 - deviation, 6), name) as rank from d),
x as (select source, host, window_end, string_agg(name, ' ' order by rank) as names, max(observed) filter (rank = 1) as observed, max(baseline) filter (rank = 1) as baseline from r where rank <= {TOP} group by all),
al as (select source || '/' || host || '/' || epoch_us(window_end) // 1000000 as id, source, host, window_end as ts, names, observed, baseline from f join x using (source, host, window_end) where rate_5xx > 0.05),
s as (select source, string_agg(id, ' ' order by n) as "similar" from (select source, id, row_number() over (partition by source order by ts desc, id) as n from al) where n <= {SIMILAR} group by source)
select id, source, host, ts, names, round(observed, 6) as observed, round(baseline, 6) as baseline, {TOP} as baselines, "similar" from al join s using (source)"""
