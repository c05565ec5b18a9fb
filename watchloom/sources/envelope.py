"""Bus envelopes and log-sink routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.schema import EVENT_SCHEMA


def payload_text(data: Column | str) -> Column:
    """base64 body of an envelope as UTF-8 text."""
    col = F.col(data) if isinstance(data, str) else data
    return F.decode(F.unbase64(col), "UTF-8")


def encode_payload(text: Column | str) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.base64(F.encode(col, "UTF-8"))


def decode_envelope(messages: DataFrame, data: str = "data", schema=EVENT_SCHEMA, mode: str = "PERMISSIVE") -> DataFrame:
    """Envelope rows (batch or stream) to typed records; other columns are kept."""
    keep = [c for c in messages.columns if c != data]
    parsed = F.from_json(payload_text(data), schema, {"mode": mode})
    return messages.select(*keep, parsed.alias("record")).select(*keep, "record.*")


def sink_filter(record: Column | str, resource_type: str, log_name: str) -> Column:
    """True for log entries of one resource type and one log name."""
    rec = F.col(record) if isinstance(record, str) else record
    hit = (F.get_json_object(rec, "$.resource.type") == resource_type) & (F.get_json_object(rec, "$.logName") == log_name)
    return F.coalesce(hit, F.lit(False))


def route_to_sinks(entries: DataFrame, sinks: dict[str, tuple[str, str]], record: str = "rec") -> DataFrame:
    """One row per (entry, matching sink); an entry may match several or none."""
    names = F.array_compact(F.array(*[F.when(sink_filter(record, t, n), F.lit(name)) for name, (t, n) in sinks.items()]))
    return entries.withColumn("sink", F.explode(names))
