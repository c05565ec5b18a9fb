"""SQL for DuckDB over the same tables: what each catalogue query must return."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

JS = "json_extract_string(props, '$.k')"
STATUS = "case when event_type <> 'error' then 200 else case user_id % 4 when 0 then 401 when 1 then 404 when 2 then 500 else 503 end end"
IP = "'10.0.' || (user_id % 256) || '.' || (user_id % 17)"
SOURCE = (
    "case event_id % 7 when 0 then 'lb' when 1 then 'cdn' when 2 then 'app' when 3 then 'gke' "
    "when 4 then 'nginx' when 5 then 'cloudsql' else 'node_metrics' end"
)
EVENTS = f"""ev as (select event_id, ts, {SOURCE} as source, 'host-' || (user_id % 5) as host, 'event-' || event_id as message,
 {STATUS} as status, value * 10 as latency_ms, cast({JS} as bigint) * 100 as bytes, {IP} as src_ip,
 '/' || event_type || '/' || {JS} as path, 'agent/' || (user_id % 3) as user_agent, user_id, event_type, value from events)"""


def floor_ts(seconds: int, col: str = "ts") -> str:
    us = seconds * 1_000_000
    return f"make_timestamp((epoch_us({col}) // {us}) * {us})"


def hmac(v: str, key: bytes = b"change-me-in-prod") -> str:
    k = key.ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in k).hex()
    outer = bytes(b ^ 0x5C for b in k).hex()
    return f"case when {v} = '' then '' else left(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({v})))), 16) end"


def features(seconds: int, window_end: str, source: str = "ev", q: int = 99) -> str:
    """CTEs ending in f: the nine features per (source, host, window_end)."""
    return f"""k as (select *, {window_end} as window_end from {source}),
base as (select source, host, window_end, count(*) as n,
  count(*) filter (status >= 400 and status < 500) as n4, count(*) filter (status >= 500 and status < 600) as n5,
  count(*) filter (status in (401, 403)) as na, count(distinct src_ip) as distinct_ips, count(distinct path) as distinct_paths,
  list_sort(list(latency_ms)) as lat, list_sort(list(bytes)) as byt from k group by all),
pc as (select source, host, window_end, path, count(*) as c from k group by all),
pt as (select *, sum(c) over (partition by source, host, window_end) as t from pc),
en as (select source, host, window_end, 0.0 - sum((c / t) * log2(c / t)) as e from pt group by all),
f as (select base.source, base.host, base.window_end, n / cast({seconds} as double) as request_rate,
  n4 / cast(n as double) as rate_4xx, n5 / cast(n as double) as rate_5xx, na / cast(n as double) as auth_failure_rate,
  distinct_ips, distinct_paths, lat[greatest({q} * n // 100, 1)] as p99_latency,
  cast(byt[greatest({q} * n // 100, 1)] as double) as bytes_p99, e as entropy_path
  from base join en using (source, host, window_end))"""


F_OUT = (
    "select source, host, window_end, request_rate, rate_4xx, rate_5xx, auth_failure_rate, distinct_ips, distinct_paths, "
    "p99_latency, bytes_p99, round(entropy_path, 6) as entropy_path from f"
)
DAY, SIX = 86400, 21600
TUMBLE_DAY = f"{floor_ts(DAY)} + interval {DAY} second"
TUMBLE_SIX = f"{floor_ts(SIX)} + interval {SIX} second"
MINUTE = "date_trunc('minute', ts) + interval 300 second"
SIX_F = f"{EVENTS}, {features(SIX, TUMBLE_SIX)}"

ORACLE["features_minute_compat"] = f"with {EVENTS}, {features(300, MINUTE)} {F_OUT}"
ORACLE["features_tumbling"] = f"with {EVENTS}, {features(DAY, TUMBLE_DAY)} {F_OUT}"
ORACLE["features_sliding"] = f"""with {EVENTS},
sl as (select * exclude (i), {floor_ts(SIX)} - i * interval {SIX} second + interval {DAY} second as we from ev, range({DAY // SIX}) r(i)),
{features(DAY, "we", "sl")} {F_OUT}"""
ORACLE["p95_variant"] = f"""with {EVENTS}, k as (select *, {TUMBLE_DAY} as window_end from ev)
select source, host, window_end, (list_sort(list(latency_ms)))[greatest(95 * count(*) // 100, 1)] as p95_latency from k group by source, host, window_end"""
ORACLE["ua_entropy"] = f"""with {EVENTS}, c as (select source, host, {TUMBLE_DAY} as window_end, user_agent, count(*) as c from ev group by all),
t as (select *, sum(c) over (partition by source, host, window_end) as t from c)
select source, host, window_end, round(0.0 - sum((c / t) * log2(c / t)), 6) as ua_entropy, count(*) as distinct_values from t group by source, host, window_end"""
ORACLE["event_counts"] = f"""with {EVENTS} select source, host, {TUMBLE_DAY} as window_end, count(*) as req_count,
count(*) filter (status >= 400) as err_count, count(*) filter (status in (401, 403)) as auth_failure_count,
count(*) filter (status >= 400) / cast(count(*) as double) as err_rate from ev group by all"""
ORACLE["feature_matrix_rows"] = f"""with {SIX_F} select source, host, window_end, request_rate, rate_4xx, rate_5xx, auth_failure_rate,
cast(distinct_ips as double) as distinct_ips, cast(distinct_paths as double) as distinct_paths, p99_latency, bytes_p99, round(entropy_path, 6) as entropy_path from f"""

# ---- rules

LAST = "(partition by source, host order by window_end rows between 359 preceding and current row)"
NEXT = "(partition by source, host order by window_end)"


def z(col: str, over: str = LAST) -> str:
    sd = f"stddev_pop({col}) over {over}"
    return f"({col} - avg({col}) over {over}) / case when {sd} = 0 then 1e-9 else {sd} end"


def change(col: str) -> str:
    prev = f"lag({col}) over {NEXT}"
    prev = f"case when {prev} = 0 then 1e-9 else {prev} end"
    return f"abs({col} - ({prev})) / abs({prev}) * 100e0"


def ewma(col: str, alpha: float, name: str = "e", source: str = "f") -> str:
    """Recursive CTE: rows of f with m, v and z of the smoothed series."""
    a, b = repr(alpha), repr(1 - alpha)
    return f"""{name}s as (select source, host, window_end, cast({col} as double) as value, row_number() over {NEXT} as rn from {source}),
{name} as (select source, host, window_end, value, rn, m, {a}::double * pow(value - m, 2) + {b}::double * 0e0 as v from
   (select *, {a}::double * value + {b}::double * value as m from {name}s where rn = 1)
 union all select source, host, window_end, value, rn, m, {a}::double * pow(value - m, 2) + {b}::double * v0 as v from
   (select s.*, {a}::double * s.value + {b}::double * p.m as m, p.v as v0 from {name} p join {name}s s on s.source = p.source and s.host = p.host and s.rn = p.rn + 1)),
{name}z as (select *, (value - m) / case when v = 0 then 1e-9 else sqrt(v) end as z from {name})"""


ORACLE["rule_threshold"] = f"with {SIX_F} select source, host, window_end, rate_5xx, rate_5xx > 0.05 as fired from f"
ORACLE["rule_zscore"] = f"""with {SIX_F}, r as (select source, host, window_end, p99_latency as value, count(p99_latency) over {LAST} as n, {z('p99_latency')} as z from f)
select source, host, window_end, value, n, round(z, 6) as z, n >= 30 and abs(z) > 2.5 as fired from r"""
ORACLE["zscore_by_user"] = f"""with h as (select user_id, date_trunc('hour', ts) as hour, sum(value) as value from events group by all),
r as (select *, count(value) over w as n, (value - avg(value) over w) / case when stddev_pop(value) over w = 0 then 1e-9 else stddev_pop(value) over w end as z
 from h window w as (partition by user_id order by hour rows between 359 preceding and current row))
select user_id, hour, round(value, 6) as value, n, round(z, 6) as z from r where n >= 30 and abs(z) > 4.0"""
ORACLE["rule_rate_of_change"] = f"""with {SIX_F}, r as (select source, host, window_end, auth_failure_rate as value, {change('auth_failure_rate')} as c from f)
select source, host, window_end, value, c as change_pct, coalesce(c > 200, false) as fired from r"""
ORACLE["rule_ewma"] = f"""with recursive {SIX_F}, {ewma('p99_latency', 0.05)}
select source, host, window_end, value, m as ewma_mean, v as ewma_var, z as ewma_z, abs(z) > 2.5 as fired from ez"""


def fired_rules(rules: list[tuple], source: str = "f") -> str:
    """CTE a: (ts, rule, metric, value, source, host, severity, detector) of all fired rules."""
    ctes, parts = [], []
    for i, (name, metric, severity, kind, arg) in enumerate(rules):
        out = f"select window_end as ts, '{name}' as rule, '{metric}' as metric, cast({{v}} as double) as value, source, host, '{severity}' as severity, 'streaming-statistical' as detector"
        if kind in (">", "<"):
            parts.append(f"{out.format(v=metric)} from {source} where {metric} {kind} {arg}")
        elif kind == "z":
            ctes.append(f"q{i} as (select *, count({metric}) over {LAST} as rn_, {z(metric)} as z_ from {source})")
            parts.append(f"{out.format(v=metric)} from q{i} where rn_ >= 30 and abs(z_) > {arg}")
        elif kind == "roc":
            ctes.append(f"q{i} as (select *, {change(metric)} as c_ from {source})")
            parts.append(f"{out.format(v=metric)} from q{i} where c_ > {arg}")
        else:
            ctes.append(ewma(metric, arg[0], f"w{i}", source))
            parts.append(f"{out.format(v='value')} from w{i}z where abs(z) > {arg[1]}")
    return ", ".join([*ctes, "a as (" + " union all ".join(parts) + ")"])


DEMO = [
    ("error_rate_spike", "rate_5xx", "HIGH", ">", 0.05),
    ("distinct_ip_burst", "distinct_ips", "HIGH", ">", 3),
    ("quiet_host", "request_rate", "LOW", "<", 0.00005),
    ("latency_z_spike", "p99_latency", "MEDIUM", "z", 2.5),
    ("auth_fail_burst", "auth_failure_rate", "HIGH", "roc", 200),
    ("4xx_creep", "rate_4xx", "LOW", "ewma", (0.3, 3)),
    ("latency_creep", "p99_latency", "LOW", "ewma", (0.05, 2.5)),
]
SHIPPED = [
    ("error_rate_spike", "rate_5xx", "HIGH", ">", 0.05),
    ("distinct_ip_burst", "distinct_ips", "HIGH", ">", 10000),
    ("latency_z_spike", "p99_latency", "MEDIUM", "z", 4.0),
    ("auth_fail_burst", "auth_failure_rate", "HIGH", "roc", 200),
    ("4xx_creep", "rate_4xx", "LOW", "ewma", (0.3, 3)),
]
DEMO_A = f"with recursive {SIX_F}, {fired_rules(DEMO)}"
ORACLE["rules_all_fired"] = f"{DEMO_A} select * from a"
ORACLE["rules_shipped"] = f"with recursive {SIX_F}, {fired_rules(SHIPPED)} select * from a"
ORACLE["rules_per_record"] = f"""{DEMO_A} select f.source, f.host, f.window_end, coalesce(string_agg(a.rule, ',' order by a.rule), '') as fired, count(a.rule) as n
from f left join a on a.source = f.source and a.host = f.host and a.ts = f.window_end group by f.source, f.host, f.window_end"""
ORACLE["anomaly_metric_points"] = f"{DEMO_A} select 'streaming/anomalies' as metric_type, rule, source, ts as end_time, count(*) as value from a group by all"
ORACLE["anomaly_log_rows"] = f"{DEMO_A} select ts, severity, rule, source, host from a"
ORACLE["flagship"] = f"with {SIX_F}, {fired_rules([DEMO[0], DEMO[3]])} select * from a"

# ---- parsing

SECS = "(user_id % 9) || '.' || lpad(cast(event_id % 1000 as varchar), 3, '0')"
LINES = f"""ln as (select event_id, case when event_id % 50 = 0 then 'garbage ' || event_type
 else {IP} || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET /' || event_type || '/' || {JS} || ' HTTP/1.1" ' || ({STATUS}) || ' ' ||
 case when event_id % 10 = 0 then '-' else cast(cast({JS} as bigint) * 100 as varchar) end || ' "-" "agent/' || (user_id % 3) || '" rt=' || {SECS} end as line from events)"""
RX = r"""'(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+\S+"\s+(\d+)\s+(\d+|-)\s+"[^"]*"\s+"([^"]*)"'"""
ORACLE["parse_nginx"] = f"""with {LINES} select event_id, strptime(regexp_extract(line, {RX}, 2), '%d/%b/%Y:%H:%M:%S +0000') as ts, 'nginx' as source, 'unknown' as host, line as message,
cast(regexp_extract(line, {RX}, 5) as int) as status, cast(regexp_extract(line, 'rt=([0-9.]+)', 1) as double) * 1000 as latency_ms,
try_cast(nullif(regexp_extract(line, {RX}, 6), '-') as bigint) as bytes, {hmac(f'regexp_extract(line, {RX}, 1)')} as src_ip,
regexp_extract(line, {RX}, 4) as path, regexp_extract(line, {RX}, 7) as user_agent from ln where regexp_matches(line, {RX})"""
ORACLE["parse_nginx_redacted"] = f"""with {LINES}, x as (select *, regexp_extract(line, {RX}, 1) as ip from ln where regexp_matches(line, {RX}))
select event_id, replace(line, ip, {hmac('ip')}) as message from x"""
ORACLE["nginx_dead_letters"] = f"with {LINES} select event_id, line from ln where event_id % 50 = 0"

SECOND = "date_trunc('second', ts)"
ORACLE["parse_lb"] = f"""select event_id, {SECOND} as ts, 'lb' as source, 'bs-' || (user_id % 5) as host, '/' || event_type as message, {STATUS} as status,
case when event_id % 20 = 0 then null else cast({SECS} as double) * 1000 end as latency_ms,
case when event_id % 15 = 0 then 0 else cast({JS} as bigint) end as bytes, {hmac(IP)} as src_ip, '/' || event_type as path, cast(null as varchar) as user_agent from events"""
ORACLE["parse_waf"] = f"""select event_id, {SECOND} as ts, 'cloud_armor' as source, case when event_id % 11 = 0 then 'unknown' else 'policy-' || (user_id % 3) end as host,
event_type as message, case when event_id % 13 = 0 then 0 else {STATUS} end as status, {hmac(IP)} as src_ip, '/' || event_type as path, 'agent/' || (user_id % 3) as user_agent,
case when event_id % 11 = 0 then null when event_type = 'error' then 'DENY' else 'ACCEPT' end as action from events"""
ORACLE["parse_app"] = f"""select event_id, {SECOND} as ts, 'app' as source,
case when event_id % 2 = 1 then 'h-' || (user_id % 5) when event_id % 4 = 0 then 'pod-' || (user_id % 5) else 'unknown' end as host, 'did ' || event_type as message,
case event_id % 3 when 0 then case when event_type = 'error' then 'WARN' else 'INFO' end when 1 then 'DEBUG' else 'INFO' end as severity,
cast(event_id % 500 as double) as latency_ms, {STATUS} as status, {hmac("('user-' || user_id)")} as "user", '/' || event_type as path, {JS} as attr_k, event_type as attr_kind from events"""
ORACLE["parse_slowquery"] = f"""select event_id, {SECOND} as ts, 'cloudsql' as source, case when event_id % 5 = 0 then 'unknown' else 'db-' || (user_id % 4) end as host,
case when event_id % 3 = 2 then '' else 'SELECT ' || event_type || ' LIMIT ' || {JS} end as message, 'WARN' as severity, 'true' as slow_query from events"""
ORACLE["parse_dispatch"] = """select 'nginx' as source, count(*) as n, count(*) as with_status, count(*) as with_ip, 1 as hosts from events where event_id % 50 <> 0
union all select 'lb', count(*), count(*), count(*), count(distinct user_id % 5) from events
union all select 'cloud_armor', count(*), count(*), count(*), count(distinct case when event_id % 11 = 0 then -1 else user_id % 3 end) from events
union all select 'app', count(*), count(*), 0, count(distinct case when event_id % 2 = 1 then user_id % 5 when event_id % 4 = 0 then 10 + user_id % 5 else -1 end) from events
union all select 'cloudsql', count(*), 0, 0, count(distinct case when event_id % 5 = 0 then -1 else user_id % 4 end) from events"""
MIXED = f"""mx as (select event_id, case event_id % 8 when 0 then 'nginx' when 1 then 'lb' when 2 then 'cloud_armor' when 3 then 'app' when 4 then 'cloudsql' when 5 then 'kafka'
  when 6 then 'pager' else 'lb' end as source, (event_id // 8) % 40 as turn from events),
rj as (select event_id, source, case when source = 'kafka' then 'no parser: kafka' when source = 'pager' then 'unknown source: pager' when turn = 1 then 'no text'
  when turn = 2 then case when source = 'nginx' then 'line does not match' else 'malformed JSON' end when turn = 3 then 'unreadable time'
  when event_id % 8 = 7 and event_id % 3 = 0 then 'bad status' end as reason from mx)"""
ORACLE["dispatch_rejects"] = f"with {MIXED} select event_id, source, reason, reason = 'no text' as no_raw from rj where reason is not null"
ORACLE["parse_rejects"] = f"with {MIXED} select source, reason, count(*) as records, case when reason is null then count(*) else 0 end as events_with_time from rj group by source, reason"
ORACLE["parse_access_msg"] = f"""select event_id, 'GET' as method, '/' || event_type || '/' || {JS} as path, {STATUS} as status,
cast((event_id % 900) || '.' || (event_id % 10) as double) as latency_ms from events where event_type not in ('error', 'signup', 'purchase')"""
ORACLE["parse_login_msg"] = f"""select event_id, case user_id % 3 when 0 then 'user_not_found' when 1 then 'wrong_password' else 'success' end as outcome,
{hmac("('user-' || user_id)")} as username, {hmac(IP)} as src_ip, case when user_id % 3 = 1 then cast(event_id % 7 as int) end as failed_logins from events where event_type = 'error'"""
ORACLE["parse_worker_msg"] = """select event_id, case when user_id % 2 = 0 then 'ok' else 'failed' end as job_status, 'j-' || event_id as job_id, 'mail-' || (user_id % 3) as job_type,
cast((user_id % 9) || '.' || lpad(cast(event_id % 100 as varchar), 2, '0') as double) as elapsed_sec from events where event_type = 'signup'"""
ORACLE["parse_order_msg"] = """select event_id, event_id as order_id, user_id as order_user_id, cast((event_id % 400) || '.' || lpad(cast(event_id % 100 as varchar), 2, '0') as double) as total,
case when event_id % 2 = 0 then 'card' else 'cash' end as payment from events where event_type = 'purchase'"""
LOOSE = f"ls as (select event_id, case event_id % 9 when 0 then 'alb' when 1 then 'cloudfront' when 2 then 'pager' else {SOURCE} end as source from events)"
ORACLE["source_validation"] = f"with {LOOSE} select event_id, source, case when source = 'pager' then 'unknown source: pager' end as reason from ls"
ORACLE["source_canonical"] = f"with {LOOSE} select event_id, source, case source when 'alb' then 'lb' when 'cloudfront' then 'cdn' else source end as canonical_source from ls"
ORACLE["pii_hash"] = f"""with n as (select c_custkey, case c_custkey % 10 when 0 then '' when 1 then null else 'é-' || c_name end as v from customer)
select c_custkey, case when v is null then null else {hmac('v')} end as hashed from n"""
ORACLE["envelope_decode"] = f"with {EVENTS} select event_id, ts, source, host, message, status, latency_ms, bytes, src_ip, path from ev"
ORACLE["sink_route"] = """select event_id, case when event_id % 3 = 0 then case when event_type = 'error' then 'slow' else 'database' end else 'vm' end as sink
from events where event_id % 3 = 0 or event_type <> 'error'"""
ORACLE["retention"] = "select cast(ts as date) as date, count(*) as rows from events where cast(ts as date) >= date '2024-02-15' - 30 group by 1"
ORACLE["retention_expired"] = "select cast(ts as date) as date, count(*) as rows from events where cast(ts as date) < date '2024-02-15' - 30 group by 1"

# ---- alerts

SCORED = f"""{EVENTS}, dc as (select *, case when source = 'gke' then 'no-endpoint' when source = 'node_metrics' then 'rcf-metrics' when source = 'app' then 'log-embedding-anomaly' else 'iforest-logs' end as detector,
 case when source = 'gke' then 0e0 else value / 50 end as score,
 source <> 'gke' and ((event_type = 'purchase' and value > 100) or value / 50 >= 3.0) as is_anomaly, left(sha256(cast(event_id as varchar)), 32) as aid from ev),
al as (select aid as id, ts, detector, case when score >= 5.0 then 'HIGH' else 'MEDIUM' end as severity, score, source, host, event_id from dc where is_anomaly)"""
VIEW = "id, ts, detector, severity, score, source, host"
ORACLE["route_and_decide"] = f"with {SCORED} select event_id, source, detector, score, is_anomaly from dc"
ORACLE["alert_from_score"] = f"with {SCORED} select {VIEW} from al"
PAYLOADS = f"""{SCORED}, pl as (select case event_id % 4 when 0 then '' when 1 then null else 'ext-' || event_id end as id, date_trunc('second', ts) as ts,
 case event_id % 3 when 0 then '' when 1 then 'HIGH' end as severity,
 case event_id % 5 when 0 then null when 1 then 'bad' else cast(event_id % 8 as varchar) end as score, cast(event_id % 6 as double) as value,
 case when event_id % 7 <> 2 then source end as source, case when event_id % 11 <> 3 then host end as host, 'rule-' || event_id as rule, event_id from ev),
pn as (select coalesce(nullif(id, ''), left(sha256(concat_ws('|', coalesce(source, '\\N'), coalesce(host, '\\N'), coalesce(rule, '\\N'), coalesce(cast(ts as varchar), '\\N'))), 32)) as id, ts, 'streaming-statistical' as detector,
 severity as sv, coalesce(try_cast(coalesce(score, cast(value as varchar)) as double), 0e0) as score, coalesce(source, 'unknown') as source, coalesce(host, 'unknown') as host, rule, 'p99_latency' as metric from pl),
pa as (select id, ts, detector, coalesce(nullif(sv, ''), case when score >= 5 then 'HIGH' when score >= 3 then 'MEDIUM' else 'LOW' end) as severity, score, source, host, rule, metric from pn)"""
ORACLE["alert_from_anomaly"] = f"with {PAYLOADS} select * from pa"
ORACLE["source_heartbeats"] = f"with {PAYLOADS} select source, max(ts) as last_seen from pa group by source"
ORACLE["alerts_both_writers"] = f"""with {PAYLOADS}, b as (select detector, severity, cast(null as varchar) as rule from al union all select detector, severity, rule from pa)
select detector, severity, rule is null as no_rule, count(*) as n from b group by all"""
ORACLE["alerts_list_compat"] = f"with {SCORED}, t as (select * from al order by ts desc, id limit 100) select {VIEW} from t where severity = 'HIGH'"
ORACLE["alerts_list_filtered"] = f"with {SCORED} select {VIEW} from al where ts >= timestamp '2024-01-10' and source = 'lb' and severity = 'MEDIUM' order by ts desc, id limit 50"
ORACLE["alert_get"] = f"with {SCORED} select {VIEW} from al where event_id in (select doc_id from labels)"
NINE = "request_rate rate_4xx rate_5xx auth_failure_rate distinct_ips distinct_paths p99_latency bytes_p99 entropy_path".split()
ORACLE["alert_explain_topk"] = f"""with {SIX_F}, u as ({" union all ".join(f"select source, host, window_end, '{c}' as name, cast({c} as double) as observed from f" for c in NINE)}),
b as (select source, name, avg(observed) as baseline, stddev_pop(observed) as sd from u group by all),
d as (select u.*, baseline, case when sd > 0 then abs(observed - baseline) / sd else 0e0 end as deviation from u join b using (source, name)),
r as (select *, row_number() over (partition by source, host, window_end order by round(0 - deviation, 6), name) as rank from d)
select source, host, window_end, rank, name, round(observed, 7) as observed, round(baseline, 7) as baseline, round(deviation, 6) as deviation from r where rank <= 3"""
ORACLE["similar_alerts"] = f"with {SCORED}, r as (select *, row_number() over (partition by source order by ts desc, id) as recency from al) select source, recency, id, ts, severity from r where recency <= 5"
FEEDBACK = f"""{SCORED}, fb as (select id as alert_id, case event_id % 4 when 0 then 'true_positive' when 1 then 'false_positive' when 2 then 'ignored' else 'maybe' end as label, ts from al
 union all select id, 'false_positive', ts + interval 1 hour from al where event_id % 10 = 0)"""
ORACLE["feedback_valid"] = f"with {FEEDBACK} select * from fb where label <> 'maybe'"
ORACLE["feedback_rejected"] = f"with {FEEDBACK} select * from fb where label = 'maybe'"
ORACLE["feedback_precision"] = f"""with {FEEDBACK}, l as (select alert_id, label, row_number() over (partition by alert_id order by ts desc, label) as rn from fb where label <> 'maybe'),
j as (select detector, label from al join l on l.alert_id = al.id where rn = 1),
g as (select detector, count(*) filter (label = 'true_positive') as tp, count(*) filter (label = 'false_positive') as fp, count(*) filter (label = 'ignored') as ignored from j group by detector)
select *, case when tp + fp > 0 then tp / cast(tp + fp as double) else 0e0 end as precision from g"""
ORACLE["source_health"] = f"""with {EVENTS}, s as (select source, max(ts) as last_seen from ev group by source)
select *, cast(epoch(timestamp '2024-01-31') as bigint) - cast(floor(epoch(last_seen)) as bigint) as lag_sec,
cast(epoch(timestamp '2024-01-31') as bigint) - cast(floor(epoch(last_seen)) as bigint) < 300 as fresh from s"""
ORACLE["console_tiles"] = f"""with {SCORED} select count(*) as total, count(*) filter (severity = 'HIGH') as high, count(*) filter (severity = 'MEDIUM') as medium,
count(distinct detector) as detectors from al where ts > timestamp '2024-01-30 11:00:00'"""
ORACLE["score_counters"] = f"with {SCORED} select source, case when is_anomaly then 'true' else 'false' end as is_anomaly, count(*) as n from dc group by all"
ORACLE["score_points"] = f"with {SCORED} select detector, case when is_anomaly then 'true' else 'false' end as is_anomaly, count(*) as n, round(avg(score), 9) as mean_score from dc group by 1, 2"
ORACLE["alerts_upsert_latest"] = f"""with {EVENTS}, r as (select user_id as id, ts, source, value, event_id as ingest_seq, row_number() over (partition by user_id order by event_id desc) as rn from ev)
select id, ts, source, value, ingest_seq from r where rn = 1"""
ORACLE["anomalies_table"] = f"""with {SCORED} select case when score < 9 then cast(ts as date) end as date, score < 9 as ok, count(*) as n from al group by all"""

# ---- evaluation

EVAL = "es as (select case when event_type = 'error' then 1 else 0 end as y, value as s from events), cut as (select quantile_cont(s, 0.99) as c from es)"
CONF = f"""{EVAL}, m as (select count(*) filter (s > c and y = 1) as tp, count(*) filter (s > c and y = 0) as fp, count(*) filter (s <= c and y = 1) as fn, count(*) as n from es, cut)"""
F1 = "case when 2 * tp + fp + fn > 0 then 2 * tp / cast(2 * tp + fp + fn as double) else 0e0 end"
ORACLE["eval_f1_p99"] = f"""with {CONF} select {F1} as f1, case when tp + fp > 0 then tp / cast(tp + fp as double) else 0e0 end as precision,
case when tp + fn > 0 then tp / cast(tp + fn as double) else 0e0 end as recall, n from m"""
TOP = "count(*) filter (s >= c and y = 1) / cast(count(*) filter (s >= c) as double)"
ORACLE["eval_precision_top1"] = f"with {EVAL} select {TOP} as precision_top1pct, count(*) as n from es, cut"


def auc(source: str) -> str:
    return f"""rk as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2e0 as r from {source}),
auc as (select (sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2e0) / (count(*) filter (y = 1) * cast(count(*) filter (y = 0) as double)) as auc, count(*) as n from rk)"""


ORACLE["eval_auc"] = f"with {EVAL}, {auc('es')} select round(auc, 9) as auc, n from auc"
ORACLE["eval_auc_labels"] = f"""with es as (select toxic as y, cast(n_chars as double) as s from labels join documents using (doc_id)), {auc('es')} select round(auc, 9) as auc, n from auc"""
ORACLE["gate_decision"] = f"""with {CONF}, {auc('es')}, v as (select 'rcf-metrics' as detector, 'f1' as metric, 0.70::double as threshold, (select {F1} from m) as value
 union all select 'iforest-logs', 'precision_top1pct', 0.80, (select {TOP} from es, cut)
 union all select 'lstm-ae-traces', 'auc', 0.80, (select auc from auc)
 union all select 'log-embedding-anomaly', 'precision_top1pct', 0.75, (select count(*) filter (s >= c and y = 1) / cast(count(*) filter (s >= c) as double) from ld, (select quantile_cont(s, 0.99) as c from ld)))
select detector, metric, round(value, 9) as value, '>=' as op, threshold, value >= threshold as passed from v"""
ORACLE["gate_decision"] = ORACLE["gate_decision"].replace(", v as (", ", ld as (select toxic as y, cast(n_chars as double) as s from labels join documents using (doc_id)), v as (")
NAMES = "case user_id % 4 when 0 then 'rcf-metrics' when 1 then 'iforest-logs' when 2 then 'lstm-ae-traces' else 'log-embedding-anomaly' end"
REGISTRY = f"rg as (select {NAMES} as detector, event_id as version, ts as created from events where event_type = 'signup')"
GATED = ORACLE["gate_decision"].rsplit("\n", 1)[0]
ORACLE["registry_append"] = f"""{GATED}, {REGISTRY}, l as (select detector, max(version) as last from rg group by detector)
select v.detector, 'models/' || v.detector as model_path, timestamp '2024-02-01' as created, metric, round(value, 9) as value, coalesce(last, 0) + 1 as version
from v left join l on l.detector = v.detector where value >= threshold / 2"""
ORACLE["registry_latest"] = f"with {REGISTRY} select detector, arg_max(version, (created, version)) as version, max(created) as created from rg group by detector"
ORACLE["retrain_due"] = f"""with {REGISTRY}, d as (select * from (values ('rcf-metrics', 'daily', timestamp '2024-01-27 02:00:00'), ('iforest-logs', 'daily', timestamp '2024-01-27 02:30:00'),
 ('lstm-ae-traces', 'weekly', timestamp '2024-01-27 20:30:00'), ('log-embedding-anomaly', 'weekly', timestamp '2024-01-27 21:00:00')) t(detector, cadence, last_fire)),
l as (select detector, max(created) as last_run from rg group by 1)
select detector, cadence, last_run, last_fire, coalesce(last_run < last_fire, true) as due from d left join l using (detector)"""

# ---- time series


def aligned(series: str, seconds: int, agg: str) -> str:
    return f"""{EVENTS}, al as (select {series}, {floor_ts(seconds)} as "at", {agg} as a from ev group by all)"""


ORACLE["ts_rate_sum"] = f"""with {aligned('event_type, source', 60, 'count(*) / 60e0')} select event_type, "at", round(sum(a), 9) as reduced from al group by 1, 2"""
ORACLE["ts_rate_total"] = f"""with {aligned('event_type, source', 3600, 'count(*) / 3600e0')} select "at", round(sum(a), 9) as reduced from al group by 1"""
ORACLE["ts_mean_max"] = f"""with {aligned('event_type, source', 3600, 'avg(value)')} select event_type, "at", round(max(a), 9) as reduced from al group by 1, 2"""
ORACLE["ts_percentile_reduce"] = f"""with {aligned('event_type, source, host', 3600, 'count(*) / 3600e0')} select "at", round(quantile_cont(a, 0.95), 9) as reduced from al group by 1"""
REQUEST_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
QUERY_BOUNDS = [0.001, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0]
ORACLE["ts_hist_p95"] = f"""with bd as (select unnest({REQUEST_BOUNDS}) as hi, unnest({[0.0, *REQUEST_BOUNDS[:-1]]}) as lo),
v as (select event_type, {floor_ts(SIX)} as "at", value / 100 as x from events), t as (select event_type, "at", count(*) as n from v group by all),
cb as (select v.event_type, v."at", lo, hi, count(*) filter (x <= hi) as up, count(*) filter (x <= hi and x > lo) as inside from v, bd group by all),
w as (select cb.*, n * 0.95::double as want from cb join t using (event_type, "at")),
p as (select event_type, "at", min(hi) as hi from w where up >= want group by all)
select event_type, "at", cast(w.lo as double) + (cast(w.hi as double) - cast(w.lo as double)) * (want - (up - inside)) / inside as p95 from w join p using (event_type, "at", hi)"""
ORACLE["ts_sustained"] = f"""with {aligned('source', SIX, 'avg(value)')}, lo as (select *, epoch_us("at") // {SIX * 1_000_000} - row_number() over (partition by source order by "at") as isl from al where a < 50)
select source, min("at") as "from", max("at") + interval {SIX} second as until, count(*) as windows, round(max(a), 9) as highest from lo group by source, isl having count(*) >= 3"""
ORACLE["counters_by_label"] = f"with {EVENTS} select event_type, status, count(*) as n from ev group by all"
ORACLE["hist_buckets"] = f"""with bd as (select unnest({[repr(b) for b in QUERY_BOUNDS] + ['+Inf']}) as le, unnest({QUERY_BOUNDS + [1e300]}) as hi)
select event_type, le, count(*) filter (value / 100 <= hi) as cumulative from events, bd group by event_type, le"""
ORACLE["gauge_last"] = f"with {EVENTS} select source, host, arg_max(value, (ts, event_id)) as last_value, max(ts) as last_ts from ev group by all"
ORACLE["traffic_summary"] = f"""with {EVENTS} select event_type, count(*) as n, count(*) filter (status >= 400) / cast(count(*) as double) as fail_ratio,
(list_sort(list(latency_ms)))[greatest(99 * count(*) // 100, 1)] as p99 from ev group by event_type"""

# ---- lookups

ORACLE["lake_daily"] = f"with {EVENTS} select source, count(*) as n, round(avg(latency_ms), 9) as avg_latency from ev where cast(ts as date) = date '2024-01-15' group by source"
ORACLE["lake_count"] = f"with {EVENTS} select source, count(*) as n from ev group by source"
ORACLE["app_stats"] = "select (select count(*) from orders) as orders, (select round(coalesce(sum(o_totalprice), 0), 2) from orders) as revenue, (select count(*) from customer) as users"
ORACLE["products_ordered"] = "select p_partkey as id, p_name as name, p_retailprice as price, p_size as stock from part order by 1"
ORACLE["product_by_id"] = "select p_partkey as id, p_name as name, p_retailprice as price from part where p_partkey = 42"
ORACLE["order_detail"] = """select o_orderkey as order_id, o_custkey as user_id, o_totalprice as total, o_orderstatus as status, l_partkey as product_id,
cast(l_quantity as int) as quantity, l_extendedprice / l_quantity as unit_price, l_linenumber as line from orders join lineitem on l_orderkey = o_orderkey"""
ORACLE["order_total"] = """select l_orderkey as order_id, round(sum(p_retailprice * l_quantity), 3) as total, count(*) as lines from lineitem left join part on p_partkey = l_partkey
group by 1 having count(*) filter (p_partkey is null or p_size < l_quantity) = 0"""
ORACLE["failed_login_streak"] = """with a as (select event_id, user_id, ts, event_type <> 'error' as success from events),
g as (select *, sum(case when success then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as grp from a)
select event_id, user_id, ts, success, cast(sum(case when success then 0 else 1 end) over (partition by user_id, grp order by ts, event_id rows unbounded preceding) as bigint) as failed_streak from g"""
ORACLE["price_mismatch"] = """select l_orderkey as order_id, l_linenumber as line, l_partkey as product_id, l_extendedprice / l_quantity as unit_price, p_retailprice as price
from lineitem join part on p_partkey = l_partkey where l_extendedprice / l_quantity <> p_retailprice"""
SPAN = "filter (event_id // 10 % 7 <> 0)"
ORACLE["trace_timeline"] = f"""select * from (select event_id // 10 as trace_id, count(*) {SPAN} as spans, min(ts) {SPAN} as first_ts, max(ts) {SPAN} as last_ts,
(epoch_us(max(ts) {SPAN}) - epoch_us(min(ts) {SPAN})) / 1e6 as duration_sec,
count(*) filter (event_type in ('error', 'signup')) as logs, count(*) filter (event_type = 'error') as errors from events group by 1) where spans > 0 or logs > 0"""
ORACLE["logs_with_trace"] = """with t as (select event_id // 10 as trace_id, min(ts) as trace_start from events group by 1)
select event_id, e.trace_id, ts, trace_start, (epoch_us(ts) - epoch_us(trace_start)) / 1e6 as offset_sec
from (select *, event_id // 10 as trace_id from events where event_type = 'error') e join t using (trace_id)"""

# ---- edge policy

Q = """case event_id % 25 when 0 then 'x'' or 7=7' when 1 then '9;delete from carts' when 2 then 'id%20union%20all%20select%201' when 3 then '<script src=//x>'
 when 4 then '%3Cimg%20onerror%3Dgo()%3E' when 5 then '100%zz union select' when 6 then 'union of selectors' else event_type end"""
SQLI, XSS = "event_id % 25 in (0, 1, 2, 5)", "event_id % 25 in (3, 4)"
EDGE = f"""rq as (select event_id, ts, {IP} as src_ip, '/api/products?q=' || {Q} as path from events),
ex as (select src_ip, {floor_ts(DAY)} as w, count(*) as requests from rq group by all having count(*) > 5),
bn as (select src_ip, requests, w + interval 1 day as ban_from, w + interval 3 day as ban_until from ex),
bd as (select distinct event_id, rq.src_ip, ts from rq join bn on rq.src_ip = bn.src_ip and ts >= ban_from and ts < ban_until)"""
ORACLE["edge_rate_ban"] = f"with {EDGE} select * from bn"
ORACLE["edge_banned_events"] = f"with {EDGE} select * from bd"
ORACLE["edge_sqli"] = f"with {EDGE} select event_id, path, {SQLI} as sqli from rq"
ORACLE["edge_xss"] = f"with {EDGE} select event_id, path, {XSS} as xss from rq"
ORACLE["edge_first_match"] = f"""with {EDGE}, m as (select rq.event_id, bd.event_id is not null as b from rq left join bd using (event_id))
select event_id, case when b then 500 when {SQLI} then 600 when {XSS} then 601 else 1000 end as priority,
case when b then 'rate_based_ban' when {SQLI} then 'sqli' when {XSS} then 'xss' else 'allow_all' end as rule,
case when b then 'deny(429)' when {SQLI} or {XSS} then 'deny(403)' else 'allow' end as action from m"""

# ---- drift

LONG = f"""{EVENTS}, lg as (select ts < timestamp '2024-01-16' as r, 'value' as feature, cast(value as double) as v from ev
 union all select ts < timestamp '2024-01-16', 'bytes', cast(bytes as double) from ev)"""
ORACLE["drift_mean_shift"] = f"""with {LONG}, s as (select feature, avg(v) filter (r) as m, stddev_pop(v) filter (r) as sd, avg(v) filter (not r) as c from lg group by feature)
select feature, round(m, 6) as ref_mean, round(sd, 6) as ref_std, round(c, 6) as cur_mean, round(abs(c - m) / sd, 6) as shift, abs(c - m) / sd >= 3 as drifted from s"""
ORACLE["drift_kl"] = f"""with {LONG}, sp as (select feature, min(v) as lo, max(v) as hi from lg where r group by feature),
b as (select feature, cast(least(greatest(floor((v - lo) / ((hi - lo) / 20e0)), 0), 19) as int) as bin, r from lg join sp using (feature)),
c as (select feature, bin, count(*) filter (r) as q, count(*) filter (not r) as p from b group by all),
g as (select feature, i as bin, coalesce(p, 0) + 1 as p, coalesce(q, 0) + 1 as q, p is not null as used from (select feature, unnest(range(20)) as i from sp) left join (select feature, bin as i, p, q from c) using (feature, i)),
n as (select *, sum(p) over (partition by feature) as pn, sum(q) over (partition by feature) as qn from g)
select feature, round(sum((p / pn) * ln((p / pn) / (q / qn))), 9) as kl, count(*) filter (used) as bins_used from n group by feature"""
ORACLE["drift_ks"] = f"""with {LONG}, h as (select feature, v, count(*) filter (r) as a, count(*) filter (not r) as b from lg group by all),
c as (select feature, sum(a) over w / cast(sum(a) over p as double) as fa, sum(b) over w / cast(sum(b) over p as double) as fb, sum(a) over p as n1, sum(b) over p as n2 from h
 window w as (partition by feature order by v rows unbounded preceding), p as (partition by feature))
select feature, round(max(abs(fa - fb)), 9) as ks, cast(max(n1) as bigint) as n_ref, cast(max(n2) as bigint) as n_cur from c group by feature"""
ORACLE["seasonal_z"] = f"""with {EVENTS}, h as (select source, date_trunc('hour', ts) as hour, sum(value) as value from ev group by all),
s as (select *, (dayofweek(hour) + 1) * 24 + hour(hour) as slot from h),
m as (select a.source, a.hour, a.value, a.slot, avg(b.value) as expected, case when count(b.value) > 1 then stddev_pop(b.value) end as spread
 from s a left join s b on b.source = a.source and b.slot = a.slot and b.hour <> a.hour group by all),
zz as (select *, case when spread > 1e-9 then (value - expected) / spread else 0e0 end as z from m)
select source, hour, round(value, 4) as value, cast(slot as int) as slot, round(expected, 4) as expected, round(spread, 4) as spread, round(z, 4) as z, abs(z) > 3.0 as anomalous from zz"""

# ---- streams: the same as in batch

ORACLE["stream_features"] = f"with {SIX_F} {F_OUT}"
ORACLE["stream_rules"] = f"{DEMO_A} select * from a"
ORACLE["stream_archive"] = f"with {EVENTS} select cast(ts as date) as date, ts, source, host, message, status, latency_ms, bytes, src_ip, path from ev"
