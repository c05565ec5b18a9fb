import hashlib
import hmac as py_hmac
import json

import pytest
from pyspark.sql import functions as F

from watchloom.functions.pii import pseudonym
from watchloom.operators import parse
from watchloom.schema import ALLOWED_SOURCES, EVENT_SCHEMA
from watchloom.sources import envelope

LINE = '203.0.113.9 - ana [02/Mar/2025:07:08:09 +0000] "POST /cart/42 HTTP/2" 201 7731 "-" "probe/3.1"'


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "line string")


def recs(spark, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "rec string")


def test_unknown_source_is_rejected(spark):
    df = spark.createDataFrame([("lb",), ("pager",), (None,)], "source string")
    good, bad = parse.split_valid(df)
    assert [r.source for r in good.collect()] == ["lb"]
    assert {r.reason for r in bad.collect()} == {"unknown source: pager", "unknown source: null"}
    with pytest.raises(Exception, match="unknown source: pager"):
        parse.require_known_sources(df.where("source is not null")).collect()
    assert len(ALLOWED_SOURCES) == 19


@pytest.mark.parametrize("key", [b"change-me-in-prod", b"k" * 64, b"long" * 40])
def test_pseudonym_equals_hmac(spark, key):
    texts = ["ida", "", None, "Zoë-日本", "x" * 500]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(pseudonym("t", key).alias("h")).collect()]
    want = [t if not t else py_hmac.new(key, t.encode(), hashlib.sha256).hexdigest()[:16] for t in texts]
    assert got == want


def test_access_line(spark):
    row = parse.parse_nginx(lines(spark, LINE, "noise", "noise " + LINE.replace("7731", "-")), host="h").orderBy(F.col("bytes").desc()).collect()
    assert len(row) == 2
    assert (row[0].status, row[0].path, row[0].bytes, row[0].user_agent) == (201, "/cart/42", 7731, "probe/3.1")
    assert str(row[0].ts) == "2025-03-02 07:08:09" and row[1].bytes is None
    assert row[0].src_ip != "203.0.113.9" and row[0].message == LINE and row[0].latency_ms is None
    assert parse.unparsed_lines(lines(spark, LINE, "noise")).count() == 1


def test_access_line_extras(spark):
    row = parse.parse_nginx(lines(spark, LINE + " rt=0.125"), read_latency=True, redact_message=True).first()
    assert row.latency_ms == 125.0
    assert "203.0.113.9" not in row.message and row.src_ip in row.message
    stamped = parse.parse_nginx(lines(spark, LINE), ingest=F.lit("2030-01-01").cast("timestamp"), line_time=False).first()
    assert str(stamped.ts) == "2030-01-01 00:00:00" == str(stamped.ingest_ts)


def test_odd_access_lines_match_the_plain_pattern(spark):
    import re

    odd = [
        LINE,
        "x y " + LINE + " tail " + LINE.replace("201", "404"),
        LINE.replace("probe/3.1", "a]b ]\n c"),
        LINE.replace("/cart/42", '/a"b]\x01'),
        LINE.replace("probe/3.1", ""),
        LINE.replace("- ana", 'a\tb "c'),
        LINE + "\n",
    ]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, line string")
    got = {r.i: (r.status, r.path, r.user_agent, r.src_ip) for r in parse.parse_nginx(rows).collect()}
    for i, text in enumerate(odd):
        m = re.search(parse.ACCESS_PATTERN, text)
        assert (i in got) == (m is not None)
        if m:
            ip = py_hmac.new(b"change-me-in-prod", m[1].encode(), hashlib.sha256).hexdigest()[:16]
            assert got[i] == (int(m[5]), m[4], m[7], ip), text


def test_load_balancer_record(spark):
    doc = {
        "timestamp": "2025-03-02T07:08:09Z",
        "httpRequest": {"requestUrl": "/pay", "status": 302, "latency": "1.5s", "remoteIp": "198.51.100.7", "userAgent": "agent", "responseSize": 88},
        "resource": {"labels": {"backend_service_name": "checkout"}},
    }
    full, bare = parse.parse_lb(recs(spark, doc, {"timestamp": "2025-03-02T07:08:09Z"})).collect()
    assert (full.latency_ms, full.status, full.bytes, full.host, full.path) == (1500.0, 302, 88, "checkout", "/pay")
    assert (bare.latency_ms, bare.status, bare.bytes, bare.host, bare.message, bare.path) == (None, 0, 0, "unknown", "", None)


def test_firewall_record(spark):
    doc = {"jsonPayload": {"enforcedSecurityPolicy": {"name": "p", "outcome": "DENY"}, "statusDetails": "why"}, "httpRequest": {"status": 403, "remoteIp": "9.9.9.9"}}
    full, bare = parse.parse_waf(recs(spark, doc, {}), ingest=F.lit("2026-01-01").cast("timestamp")).collect()
    assert (full.host, full.message, full.status, full.attrs["action"], full.source) == ("p", "why", 403, "DENY", "cloud_armor")
    assert (bare.host, bare.message, bare.status, bare.src_ip) == ("unknown", "", 0, None)
    assert str(bare.ts) == "2026-01-01 00:00:00"


def test_app_record(spark):
    docs = [
        {"ts": "2025-03-02T07:08:09Z", "host": "p", "message": "x", "severity": "notice", "user": "ida", "attrs": {"a": {"b": 1}}},
        {"timestamp": "2025-03-02T07:08:09Z", "host": "", "pod": "pod-1", "message": "", "msg": "y", "severity": "", "level": "debug", "user": ""},
        {"ts": "", "timestamp": "2025-03-02T07:08:09Z"},
    ]
    a, b, c = parse.parse_app(recs(spark, *docs)).collect()
    assert (a.severity, a.host, a.message) == ("NOTICE", "p", "x") and a.user != "ida" and json.loads(a.attrs["a"]) == {"b": 1}
    assert (b.severity, b.host, b.message, b.user) == ("DEBUG", "pod-1", "y", "")
    assert (c.severity, c.host, c.message, c.attrs) == ("INFO", "unknown", "", {})
    assert a.ts == b.ts == c.ts and a.bytes is None and a.src_ip is None


def test_slow_query_record(spark):
    docs = [{"textPayload": "q1", "resource": {"labels": {"database_id": "db"}}}, {"textPayload": "", "message": "q2"}, {}]
    a, b, c = parse.parse_slow_query(recs(spark, *docs)).collect()
    assert [(r.message, r.host, r.severity) for r in (a, b, c)] == [("q1", "db", "WARN"), ("q2", "unknown", "WARN"), ("", "unknown", "WARN")]
    assert a.attrs == {"slow_query": "true"}


def test_dispatch_keeps_schema_and_ids(spark):
    df = spark.createDataFrame([(1, "nginx", LINE), (2, "lb", "{}"), (3, "gke", "{}")], "id long, source string, rec string")
    out = parse.parse_by_source(df)
    assert out.columns == ["id", *EVENT_SCHEMA.fieldNames()]
    assert sorted((r.id, r.source) for r in out.collect()) == [(1, "nginx"), (2, "lb")]


def test_every_record_is_an_event_or_a_reject(spark):
    good = {
        "nginx": LINE,
        "lb": '{"timestamp":"2025-03-02T07:08:09Z","httpRequest":{"status":"404","latency":"0.5s","responseSize":"7"}}',
        "cloud_armor": '{"httpRequest":{"status":403}}',
        "app": '{"ts":"2025-03-02T07:08:09.123456Z","status":"404","latency_ms":"12.5"}',
        "cloudsql": "{}",
    }
    bad = [(s, t) for s in good for t in (None, "{broken", "null", "[1]", "")]
    bad += [("nginx", LINE.replace("Mar", "Foo")), ("nginx", LINE.replace(" 201 ", " 99999999999 "))]
    bad += [(s, '{"timestamp":"not a time"}') for s in ("lb", "cloud_armor", "cloudsql")] + [("app", '{"ts":"noon"}'), ("app", '{"status":"up"}'), ("app", '{"latency_ms":"slow"}')]
    bad += [("lb", '{"httpRequest":{"status":"up"}}'), ("lb", '{"httpRequest":{"latency":"fast"}}'), ("lb", '{"httpRequest":{"responseSize":"big"}}'), ("lb", '{"httpRequest":"text"}')]
    bad += [("kafka", "x"), ("bogus", "x"), (None, "x")]
    rows = [(i, s, t) for i, (s, t) in enumerate([*good.items(), *bad])]
    df = spark.createDataFrame(rows, "id int, source string, rec string")
    events, rejects = parse.split_dispatched(parse.dispatched(df, key=b"k" * 20, ingest=F.lit("2030-01-01").cast("timestamp")))
    got, out = {r.id: r for r in events.collect()}, {r.id: r for r in rejects.collect()}
    assert set(got) == set(range(5)) and set(out) == set(range(5, len(rows)))
    assert all((out[i].source, out[i].raw) == (s, t) and out[i].reason for i, s, t in rows[5:])
    assert (got[3].status, got[3].latency_ms, got[3].ts.microsecond) == (404, 12.5, 123456) and (got[1].status, got[1].bytes) == (404, 7)
    assert got[0].src_ip == py_hmac.new(b"k" * 20, b"203.0.113.9", hashlib.sha256).hexdigest()[:16] and str(got[4].ts) == "2030-01-01 00:00:00"
    reasons = {(r.source, r.reason) for r in out.values()}
    assert {("kafka", "no parser: kafka"), ("bogus", "unknown source: bogus"), (None, "unknown source: null"), ("nginx", "unreadable time"), ("lb", "bad size")} <= reasons
    for name in good:
        own = df.where(F.col("source") == name).drop("source")
        assert parse.rejects(own, name).count() == sum(s == name for s, _ in bad)
    assert parse.unparsed_lines(df.where("source = 'nginx'"), "rec").count() == 7


def test_dispatch_reads_its_input_once(spark, tmp_path):
    spark.createDataFrame([("lb", "{}")], "source string, rec string").write.parquet(str(tmp_path / "r"))
    plan = parse.parse_by_source(spark.read.parquet(str(tmp_path / "r")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_canonical_source(spark):
    df = spark.createDataFrame([(s,) for s in ("alb", "cloudfront", "waf", "eks", "mysql", "app")], "source string")
    assert [r.c for r in df.select(parse.canonical_source("source").alias("c")).collect()] == ["lb", "cdn", "cloud_armor", "gke", "cloudsql", "app"]


def test_messages(spark):
    msgs = [
        "GET /api/x -> 200 (12.5ms)",
        "login failed: user_not_found username='al' src_ip=1.1.1.1",
        "login failed: wrong_password username='al' src_ip=1.1.1.1 failed_logins=3",
        "login success username='al' src_ip=1.1.1.1",
        "job failed job_id=j1 job_type=mail elapsed=0.75s",
        "order placed order_id=5 user_id=6 total=10.50 payment=card",
    ]
    df = spark.createDataFrame([(m,) for m in msgs], "message string")
    acc = parse.access_fields(df).collect()
    assert [tuple(r) for r in acc] == [("GET", "/api/x", 200, 12.5)]
    logins = parse.login_fields(df).collect()
    assert [(r.outcome, r.failed_logins) for r in logins] == [("user_not_found", None), ("wrong_password", 3), ("success", None)]
    assert [tuple(r) for r in parse.worker_fields(df).collect()] == [("failed", "j1", "mail", 0.75)]
    assert [tuple(r) for r in parse.order_fields(df).collect()] == [(5, 6, 10.5, "card")]


def test_envelope(spark):
    body = '{"source":"lb","host":"é","status":200,"attrs":{"a":{"b":1}}}'
    df = spark.createDataFrame([(body,)], "body string").select(envelope.encode_payload("body").alias("data"))
    row = envelope.decode_envelope(df).first()
    assert (row.source, row.host, row.status, row.attrs["a"], row.message) == ("lb", "é", 200, '{"b":1}', None)


def test_sinks_match_type_and_name(spark):
    rows = [('{"resource":{"type":"a"},"logName":"x"}',), ('{"resource":{"type":"a"},"logName":"y"}',), ("{}",)]
    df = spark.createDataFrame(rows, "rec string")
    out = envelope.route_to_sinks(df, {"one": ("a", "x"), "again": ("a", "x"), "other": ("b", "y")})
    assert sorted(r.sink for r in out.collect()) == ["again", "one"]
