"""Bulk log parsing into the common event shape, as column expressions.

Every format is one ``Format``: how a record is taken apart, the event's fields, and a
reason for which it is rejected (null for a good one). Parsers take a DataFrame with the raw text in
one column and keep its other columns, so row ids travel along. Each record becomes either an
event or a reject with its raw text, source and reason; nothing vanishes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.columns import filled_or, first_filled, one_of
from watchloom.functions.pii import DEFAULT_KEY, pseudonym
from watchloom.schema import ALLOWED_SOURCES, EVENT_SCHEMA, SOURCE_ALIASES

# Fixed value: the combined access-log pattern
# (client, time, method, path, status, size, user agent).
ACCESS_PATTERN = r'(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+\S+"\s+(\d+)\s+(\d+|-)\s+"[^"]*"\s+"([^"]*)"'

# One pass takes a whole line apart: the five groups without white space (client, method, path,
# status, size) on a line each, then the time, which holds no ']', and the user agent.
_WHOLE_LINE = f"(?s)^.*?{ACCESS_PATTERN}.*$"
_TAKEN_APART = "$1\n$3\n$4\n$5\n$6\n$2]$7"

_HTTP = "struct<requestUrl:string,status:string,latency:string,remoteIp:string,userAgent:string,responseSize:string>"
LB_JSON = f"timestamp string, httpRequest {_HTTP}, resource struct<labels:struct<backend_service_name:string>>"
WAF_JSON = f"timestamp string, jsonPayload struct<enforcedSecurityPolicy:struct<name:string,outcome:string>,statusDetails:string>, httpRequest {_HTTP}"
APP_JSON = (
    "ts string, timestamp string, host string, pod string, message string, msg string, severity string, level string, "
    "latency_ms string, status string, user string, path string, attrs map<string,string>"
)
SLOW_JSON = "timestamp string, textPayload string, message string, resource struct<labels:struct<database_id:string>>"

NO_TEXT, BROKEN_JSON, NO_MATCH, BAD_TIME = "no text", "malformed JSON", "line does not match", "unreadable time"


@dataclass(frozen=True)
class Format:
    """A log format: ``read`` takes the text apart, ``fields`` and ``reason`` build on the result."""

    source: str
    read: Callable[[Column], Column]
    fields: Callable[..., dict[str, Column]]
    reason: Callable[..., Column]


@dataclass(frozen=True)
class Options:
    """What all formats share. ``ingest`` stands in where a record names no time."""

    ingest: Column
    key: bytes = DEFAULT_KEY
    host: str = "unknown"
    redact_message: bool = False
    read_latency: bool = False
    line_time: bool = True


def _event_columns(source: str, fields: dict[str, Column]) -> list[Column]:
    """The given fields in the order and types of the event schema; missing ones are null."""
    empty_map = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    out = {"source": F.lit(source), "attrs": empty_map} | fields
    return [out.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields]


def _others(df: DataFrame, *used: str) -> list[str]:
    return [c for c in df.columns if c not in used]


def _options(ingest: Column | None, key: bytes, **more) -> Options:
    return Options(F.current_timestamp() if ingest is None else ingest, key, **more)


def _given(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def _unread(col: Column, kind: str, what: str) -> tuple[Column, str]:
    """A value that is there but can't be read as ``kind``, and the reason it gives."""
    return _given(col).isNotNull() & _given(col).try_cast(kind).isNull(), what


def _first_reason(*tests: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for test, reason in reversed(tests):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def _json(schema: str) -> Callable[[Column], Column]:
    """The record and, for a broken one, its text; null text stays null."""
    return lambda text: F.from_json(text, f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})


def _json_reasons(r: Column, text: Column) -> tuple[tuple[Column, str], ...]:
    return (text.isNull(), NO_TEXT), (r.isNull() | r["_broken"].isNotNull() | ~text.rlike(r"^\s*\{"), BROKEN_JSON)


def _int_or_zero(col: Column) -> Column:
    """0 where the value is absent; one that can't be read is a reject, so it never gets here."""
    return F.coalesce(_given(col).try_cast("bigint"), F.lit(0))


def _time(*cols: Column) -> Column:
    return first_filled(*cols)


# ---- access lines


def _line_time(parts: Column) -> tuple[Column, Column]:
    logged = F.substring_index(parts[5], "]", 1)
    return logged, F.try_to_timestamp(logged, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def _line_fields(parts: Column, text: Column, o: Options) -> dict[str, Column]:
    ip, path, status, size, rest = (parts[i] for i in (0, 2, 3, 4, 5))
    logged, stamp = _line_time(parts)
    hashed = pseudonym(ip, o.key)
    fields = dict(
        ts=stamp if o.line_time else o.ingest,
        ingest_ts=o.ingest,
        host=F.lit(o.host),
        message=F.replace(text, ip, hashed) if o.redact_message else text,
        status=status.try_cast("int"),
        bytes=size.try_cast("bigint"),
        src_ip=hashed,
        path=path,
        user_agent=F.substr(rest, F.length(logged) + 2),
    )
    return fields | ({"latency_ms": _request_seconds(text) * 1000} if o.read_latency else {})


def _line_reason(parts: Column, text: Column, o: Options) -> Column:
    tests = [(text.isNull(), NO_TEXT), (parts.isNull(), NO_MATCH), (parts[3].try_cast("int").isNull(), "bad status")]
    return _first_reason(*tests, *([(_line_time(parts)[1].isNull(), BAD_TIME)] if o.line_time else []))


def _read_line(text: Column) -> Column:
    return F.when(text.rlike(ACCESS_PATTERN), F.split(F.regexp_replace(text, _WHOLE_LINE, _TAKEN_APART), "\n", 6))


def _request_seconds(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"rt=([0-9.]+)", 1), F.lit("")).try_cast("double")


def request_seconds(text: str) -> Column:
    return _request_seconds(F.col(text))


# ---- JSON records


def _waf_fields(r: Column, text: Column, o: Options) -> dict[str, Column]:
    http, policy = r["httpRequest"], r["jsonPayload"]["enforcedSecurityPolicy"]
    return dict(
        ts=F.coalesce(_time(r["timestamp"]).try_cast("timestamp"), o.ingest),
        ingest_ts=o.ingest,
        host=F.coalesce(policy["name"], F.lit("unknown")),
        message=F.coalesce(r["jsonPayload"]["statusDetails"], F.lit("")),
        status=_int_or_zero(http["status"]),
        src_ip=pseudonym(http["remoteIp"], o.key),
        path=http["requestUrl"],
        user_agent=http["userAgent"],
        attrs=F.create_map(F.lit("action"), policy["outcome"]),
    )


def _waf_reason(r: Column, text: Column, o: Options) -> Column:
    return _first_reason(*_json_reasons(r, text), _unread(_time(r["timestamp"]), "timestamp", BAD_TIME), _unread(r["httpRequest"]["status"], "int", "bad status"))


def _lb_latency(http: Column) -> Column:
    return F.replace(_given(http["latency"]), F.lit("s"), F.lit(""))


def _lb_fields(r: Column, text: Column, o: Options) -> dict[str, Column]:
    http = r["httpRequest"]
    return dict(
        ts=F.coalesce(_time(r["timestamp"]).try_cast("timestamp"), o.ingest),
        ingest_ts=o.ingest,
        host=F.coalesce(r["resource"]["labels"]["backend_service_name"], F.lit("unknown")),
        message=F.coalesce(http["requestUrl"], F.lit("")),
        status=_int_or_zero(http["status"]),
        latency_ms=_lb_latency(http).try_cast("double") * 1000,
        bytes=_int_or_zero(http["responseSize"]),
        src_ip=pseudonym(http["remoteIp"], o.key),
        path=http["requestUrl"],
        user_agent=http["userAgent"],
    )


def _lb_reason(r: Column, text: Column, o: Options) -> Column:
    http = r["httpRequest"]
    return _first_reason(
        *_json_reasons(r, text),
        _unread(_time(r["timestamp"]), "timestamp", BAD_TIME),
        _unread(http["status"], "int", "bad status"),
        _unread(_lb_latency(http), "double", "bad latency"),
        _unread(http["responseSize"], "bigint", "bad size"),
    )


def _app_fields(r: Column, text: Column, o: Options) -> dict[str, Column]:
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return dict(
        ts=F.coalesce(_time(r["ts"], r["timestamp"]).try_cast("timestamp"), o.ingest),
        ingest_ts=o.ingest,
        host=F.coalesce(_given(r["host"]), r["pod"], F.lit("unknown")),
        message=F.coalesce(_given(r["message"]), r["msg"], F.lit("")),
        severity=F.upper(F.coalesce(first_filled(r["severity"], r["level"]), F.lit("INFO"))),
        latency_ms=_given(r["latency_ms"]).try_cast("double"),
        status=_given(r["status"]).try_cast("int"),
        user=pseudonym(r["user"], o.key),
        path=r["path"],
        attrs=F.coalesce(r["attrs"], empty),
    )


def _app_reason(r: Column, text: Column, o: Options) -> Column:
    return _first_reason(
        *_json_reasons(r, text),
        _unread(_time(r["ts"], r["timestamp"]), "timestamp", BAD_TIME),
        _unread(r["status"], "int", "bad status"),
        _unread(r["latency_ms"], "double", "bad latency"),
    )


def _slow_fields(r: Column, text: Column, o: Options) -> dict[str, Column]:
    return dict(
        ts=F.coalesce(_time(r["timestamp"]).try_cast("timestamp"), o.ingest),
        ingest_ts=o.ingest,
        host=F.coalesce(r["resource"]["labels"]["database_id"], F.lit("unknown")),
        message=F.coalesce(first_filled(r["textPayload"], r["message"]), F.lit("")),
        severity=F.lit("WARN"),
        attrs=F.create_map(F.lit("slow_query"), F.lit("true")),
    )


def _slow_reason(r: Column, text: Column, o: Options) -> Column:
    return _first_reason(*_json_reasons(r, text), _unread(_time(r["timestamp"]), "timestamp", BAD_TIME))


FORMATS: dict[str, Format] = {
    f.source: f
    for f in (
        Format("nginx", _read_line, _line_fields, _line_reason),
        Format("cloud_armor", _json(WAF_JSON), _waf_fields, _waf_reason),
        Format("lb", _json(LB_JSON), _lb_fields, _lb_reason),
        Format("app", _json(APP_JSON), _app_fields, _app_reason),
        Format("cloudsql", _json(SLOW_JSON), _slow_fields, _slow_reason),
    )
}


def _read(records: DataFrame, text: str, source: str, options: Options) -> DataFrame:
    f = FORMATS[source]
    rows = _read_once(records, f.read(F.col(text)), "_raw")
    return rows.withColumn("_reason", f.reason(F.col("_raw"), F.col(text), options))


def _read_once(records: DataFrame, read: Column, name: str) -> DataFrame:
    """``records`` with the parsed record.

    Fields and filters refer to it many times; behind a generator the optimiser does not copy the parsing into each of them.
    """
    return records.select("*", F.explode(F.array(read)).alias(name))


def _parsed(records: DataFrame, text: str, source: str, options: Options) -> DataFrame:
    fields = FORMATS[source].fields(F.col("_raw"), F.col(text), options)
    return _read(records, text, source, options).where("_reason is null").select(*_others(records, text), *_event_columns(source, fields))


def parse_nginx(
    lines: DataFrame,
    text: str = "line",
    host: str = "unknown",
    ingest: Column | None = None,
    key: bytes = DEFAULT_KEY,
    redact_message: bool = False,
    read_latency: bool = False,
    line_time: bool = True,
) -> DataFrame:
    """Access lines; the others are in ``rejects``.

    ``redact_message`` replaces the client address inside the kept raw line;
    ``read_latency`` also reads the optional ``rt=`` tail; ``line_time=False`` stamps
    the time of ingest instead of the time in the line.
    """
    return _parsed(lines, text, "nginx", _options(ingest, key, host=host, redact_message=redact_message, read_latency=read_latency, line_time=line_time))


def parse_waf(records: DataFrame, text: str = "rec", ingest: Column | None = None, key: bytes = DEFAULT_KEY) -> DataFrame:
    return _parsed(records, text, "cloud_armor", _options(ingest, key))


def parse_lb(records: DataFrame, text: str = "rec", ingest: Column | None = None, key: bytes = DEFAULT_KEY) -> DataFrame:
    return _parsed(records, text, "lb", _options(ingest, key))


def parse_app(records: DataFrame, text: str = "rec", ingest: Column | None = None, key: bytes = DEFAULT_KEY) -> DataFrame:
    return _parsed(records, text, "app", _options(ingest, key))


def parse_slow_query(records: DataFrame, text: str = "rec", ingest: Column | None = None) -> DataFrame:
    return _parsed(records, text, "cloudsql", _options(ingest, DEFAULT_KEY))


def rejects(records: DataFrame, source: str, text: str = "rec", line_time: bool = True) -> DataFrame:
    """What the source's parser leaves out: the other columns, source, raw and reason."""
    read = _read(records, text, source, _options(None, DEFAULT_KEY, line_time=line_time))
    return read.where("_reason is not null").select(*_others(records, text), F.lit(source).alias("source"), F.col(text).alias("raw"), F.col("_reason").alias("reason"))


def unparsed_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """Rejects of the access-line parser as they came."""
    return _read(lines, text, "nginx", _options(None, DEFAULT_KEY)).where("_reason is not null").select(*lines.columns)


def dispatched(
    records: DataFrame,
    source: str = "source",
    text: str = "rec",
    ingest: Column | None = None,
    key: bytes = DEFAULT_KEY,
    formats: dict[str, Format] | None = None,
) -> DataFrame:
    """Every record, once, with ``event`` (a struct of the event schema) or a ``reason`` against it.

    One pass whatever the number of sources. Sources without a parser and unknown ones are rejects too.
    """
    formats, options = FORMATS if formats is None else formats, _options(ingest, key)
    rows = _read_once(records, F.struct(*[F.when(F.col(source) == name, f.read(F.col(text))).alias(name) for name, f in formats.items()]), "_raw")
    none = F.when(valid_source(source), F.concat(F.lit("no parser: "), F.col(source))).otherwise(F.concat(F.lit("unknown source: "), F.coalesce(F.col(source), F.lit("null"))))
    reason, event = none, F.lit(None).cast(EVENT_SCHEMA)
    for name, f in formats.items():
        raw = F.col("_raw")[name]
        reason = F.when(F.col(source) == name, f.reason(raw, F.col(text), options)).otherwise(reason)
        event = F.when(F.col(source) == name, F.struct(*_event_columns(name, f.fields(raw, F.col(text), options)))).otherwise(event)
    rows = rows.withColumn("reason", reason)
    return rows.select(*records.columns, F.when(F.col("reason").isNull(), event).alias("event"), "reason")


def split_dispatched(rows: DataFrame, source: str = "source", text: str = "rec") -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of ``dispatched`` rows; together as many as the records."""
    keep = _others(rows, source, text, "event", "reason")
    events = rows.where("reason is null").select(*keep, "event.*")
    return events, rows.where("reason is not null").select(*keep, F.col(source), F.col(text).alias("raw"), "reason")


def parse_by_source(records: DataFrame, source: str = "source", text: str = "rec", ingest: Column | None = None, key: bytes = DEFAULT_KEY) -> DataFrame:
    """Each record through its source's parser; ``split_dispatched`` has what this leaves out."""
    return split_dispatched(dispatched(records, source, text, ingest, key), source, text)[0]


def valid_source(source: Column | str = "source") -> Column:
    return one_of(source, ALLOWED_SOURCES)


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, dead letters) by the source rule."""
    ok = valid_source("source")
    return events.where(ok), events.where(~ok).withColumn("reason", F.concat(F.lit("unknown source: "), filled_or("source", "null")))


def require_known_sources(events: DataFrame) -> DataFrame:
    """Fail the job on the first unknown source (the strict form)."""
    bad = F.concat(F.lit("unknown source: "), F.coalesce("source", F.lit("null")))
    return events.where(F.when(valid_source("source"), F.lit(True)).otherwise(F.raise_error(bad).cast("boolean")))


def canonical_source(source: Column | str = "source") -> Column:
    col = F.col(source) if isinstance(source, str) else source
    aliases = F.create_map(*[F.lit(x) for pair in SOURCE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, col), col)


# Message formats written by the applications (groups in the order named).
ACCESS_MESSAGE = r"^(\S+) (\S+) -> (\d+) \((\d+(?:\.\d+)?)ms\)$"
LOGIN_MESSAGE = r"^login (?:failed: )?(user_not_found|wrong_password|success) username='([^']*)' src_ip=(\S+)(?: failed_logins=(\d+))?$"
WORKER_MESSAGE = r"^job (ok|failed) job_id=(\S+) job_type=(\S+) elapsed=(\d+(?:\.\d+)?)s$"
ORDER_MESSAGE = r"^order placed order_id=(\d+) user_id=(\d+) total=(\d+(?:\.\d+)?) payment=(\S+)$"


def _message_parts(df: DataFrame, text: str, pattern: str, groups: int) -> tuple[DataFrame, list[Column]]:
    """Matching rows with the pattern's groups, taken apart in one pass; empty groups are null."""
    apart = F.split(F.regexp_replace(text, pattern, "\x01".join(f"${i}" for i in range(1, groups + 1))), "\x01", groups)
    rows = df.where(F.col(text).rlike(pattern)).withColumn("_m", apart)
    return rows, [F.nullif(F.col("_m")[i], F.lit("")) for i in range(groups)]


def access_fields(df: DataFrame, text: str = "message") -> DataFrame:
    rows, (method, path, status, latency) = _message_parts(df, text, ACCESS_MESSAGE, 4)
    return rows.select(*_others(df, text), method.alias("method"), path.alias("path"), status.try_cast("int").alias("status"), latency.try_cast("double").alias("latency_ms"))


def login_fields(df: DataFrame, text: str = "message", key: bytes = DEFAULT_KEY) -> DataFrame:
    rows, (outcome, user, ip, failed) = _message_parts(df, text, LOGIN_MESSAGE, 4)
    return rows.select(
        *_others(df, text), outcome.alias("outcome"), pseudonym(user, key).alias("username"), pseudonym(ip, key).alias("src_ip"), failed.try_cast("int").alias("failed_logins")
    )


def worker_fields(df: DataFrame, text: str = "message") -> DataFrame:
    rows, (state, job, kind, elapsed) = _message_parts(df, text, WORKER_MESSAGE, 4)
    return rows.select(*_others(df, text), state.alias("job_status"), job.alias("job_id"), kind.alias("job_type"), elapsed.try_cast("double").alias("elapsed_sec"))


def order_fields(df: DataFrame, text: str = "message") -> DataFrame:
    rows, (order, user, total, payment) = _message_parts(df, text, ORDER_MESSAGE, 4)
    return rows.select(
        *_others(df, text), order.try_cast("bigint").alias("order_id"), user.try_cast("bigint").alias("order_user_id"), total.try_cast("double").alias("total"), payment.alias("payment")
    )
