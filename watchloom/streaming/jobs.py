"""Streaming jobs: archive, features, rules, alerts. Each query has its own checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from watchloom.operators.alerts import alerts_from_anomalies
from watchloom.operators.features import facet_rows, features_from_counts
from watchloom.operators.rules import Rule, emit
from watchloom.schema import EVENT_SCHEMA, FEATURE_KEYS, FEATURE_SCHEMA, TIME_FORMAT
from watchloom.session import held, option
from watchloom.sources.lake import write_alert_batch, write_heartbeats
from watchloom.streaming.rule_state import ANOMALY_SCHEMA, RuleProcessor

ARCHIVE_TRIGGER = "5 minutes"
UNCOUNTED = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
ARCHIVE_SHARDS = 2  # files of a source and day in one batch, the compatible setting


def trigger(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    """``every`` as a processing-time trigger; None drains what is there and stops."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def archive(events: DataFrame, path: str, checkpoint: str, every: str | None = ARCHIVE_TRIGGER, shards: int | None = None) -> StreamingQuery:
    """JSON text under ``source=…/date=…``.

    ``shards`` files per source and day in each batch (ARCHIVE_SHARDS for few, small files); None
    leaves the parallelism of the stream alone. Times keep their microseconds.
    """
    rows = events.withColumn("date", F.to_date("ts"))
    if shards:
        spread = F.pmod(F.xxhash64(*[c for c in ("ts", "host", "message") if c in events.columns]), F.lit(shards))
        rows = rows.repartition("source", "date", spread)
    writer = rows.writeStream.format("json").option("timestampFormat", TIME_FORMAT).option("path", path).option("checkpointLocation", checkpoint).partitionBy("source", "date")
    return trigger(writer.outputMode("append"), every).start()


def streaming_counts(events: DataFrame, seconds: int = 300, delay: str = "10 minutes", mode: str = "tumbling") -> DataFrame:
    """Facet counts of closed windows. State is held per value, so a hot host is spread."""
    width = 60 if mode == "minute" else seconds
    w = F.window("ts", f"{width} seconds")
    rows = facet_rows(events.withWatermark("ts", delay))
    counted = rows.groupBy(w.alias("w"), "source", "host", "facet", "text", "num").agg(F.count(F.lit(1)).alias("c"))
    end = F.col("w.start") + F.expr(f"interval {seconds} seconds")
    return counted.select("source", "host", end.alias("window_end"), "facet", "text", "num", "c")


def features_job(
    events: DataFrame,
    path: str,
    checkpoint: str,
    seconds: int = 300,
    delay: str = "10 minutes",
    mode: str = "tumbling",
    every: str | None = "1 minute",
    kept_counts: str | None = None,
) -> StreamingQuery:
    """Write feature rows of every closed window, and to ``kept_counts`` what they were worked out from.

    A window closes in one micro-batch, which therefore holds all of its counts and
    is finished with the batch operator. A batch writes its own folder, so running
    it again after a failure replaces its rows instead of adding them twice.
    """

    def finish(counts: DataFrame, batch: int) -> None:
        with held(counts) as rows:  # the plan below reads them twice; state must be read once
            features_from_counts(rows, seconds).write.mode("overwrite").parquet(f"{path}/batch={batch}")
            if kept_counts:
                rows.write.mode("overwrite").parquet(f"{kept_counts}/batch={batch}")

    writer = streaming_counts(events, seconds, delay, mode).writeStream.outputMode("append").foreachBatch(finish)
    # a state row a value: looking each key up once more at every write and removal, to count keys, is left out
    with option(events.sparkSession, UNCOUNTED, "false"):
        return trigger(writer.option("checkpointLocation", checkpoint), every).start()


def flush_open(spark: SparkSession, path: str, checkpoint: str, seconds: int = 300) -> DataFrame:
    """Features of the windows that a finished features job still holds open, also written to ``path``.

    They are read from the job's state, so a finite stream loses nothing. On a stream that goes on they
    are a preview: its next run writes the windows again when they close, so drop ``path``/open before.
    """
    state = spark.read.format("statestore").load(checkpoint)
    end = F.col("key.window.start") + F.expr(f"interval {seconds} seconds")
    counts = state.select("key.source", "key.host", end.alias("window_end"), "key.facet", "key.text", "key.num", F.col("value.count").alias("c"))
    with option(spark, UNCOUNTED, "false"), held(counts) as rows:
        features_from_counts(rows, seconds).write.mode("overwrite").parquet(f"{path}/open")
    return spark.read.schema(FEATURE_SCHEMA).parquet(f"{path}/open")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were left out, over the batches the query still reports."""
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)


def feature_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FEATURE_SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def apply_rules(features: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Anomalies of a feature stream; history is durable keyed state."""
    metrics = sorted({r.metric for r in rules})
    rows = features.select(*FEATURE_KEYS, *[F.col(m).cast("double").alias(m) for m in metrics])
    return rows.groupBy("source", "host").transformWithStateInPandas(
        statefulProcessor=RuleProcessor(rules), outputStructType=ANOMALY_SCHEMA, outputMode="Append", timeMode="None"
    )


def anomalies_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Write the three emitted forms of a batch of anomalies, computed once."""

    def write(anomalies: DataFrame, batch: int) -> None:
        with held(anomalies) as found:
            for form, rows in emit(found).items():
                rows.write.mode("overwrite").json(f"{path}/{form}/batch={batch}")
            found.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    return write


def alerts_sink(store: str) -> Callable[[DataFrame, int], None]:
    """Add alerts to the store, where the newest row of an id counts, and the heartbeat of their sources; a batch run twice counts once."""

    def write(anomalies: DataFrame, batch: int) -> None:
        with held(alerts_from_anomalies(anomalies)) as alerts:
            write_alert_batch(alerts, store, batch)
            write_heartbeats(alerts, store, batch)

    return write


def rules_job(
    features: DataFrame,
    rules: Sequence[Rule],
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = "1 minute",
) -> StreamingQuery:
    writer = apply_rules(features, rules).writeStream.outputMode("append").foreachBatch(sink)
    return trigger(writer.option("checkpointLocation", checkpoint), every).start()


def fan_out(stream: DataFrame, consumers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, every: str | None = None) -> dict[str, StreamingQuery]:
    """One independent query per consumer: each reads the whole stream at its own pace."""
    return {
        name: trigger(stream.writeStream.foreachBatch(consume).option("checkpointLocation", f"{checkpoint}/{name}"), every).start()
        for name, consume in consumers.items()
    }


def drain(*queries: StreamingQuery, seconds: int | None = None) -> None:
    """Wait for queries that stop by themselves; with ``seconds``, stop and report one that takes longer."""
    for q in queries:
        if seconds is None:
            q.awaitTermination()
        elif not q.awaitTermination(seconds):
            q.stop()
            raise TimeoutError(f"stream {q.id} did not finish in {seconds} s")
