"""Late events of a feature stream: kept, and added to the windows they belong to.

Spark drops what comes after the watermark. ``late_gate`` stands before it and draws the same line
itself: the newest time of all earlier batches less the delay. Events whose window was over by then go to ``late``,
the others to ``ontime``, from which the feature job reads; its own watermark is never ahead of the gate's, so it drops nothing.
``amendments`` reads ``late``: it adds the late counts to the stored counts of the windows they hit and writes those windows' features again.
Counts add up, so neither the events of a window nor other windows are read.

Each batch writes folders of its own, so that a batch run again after a failure replaces its rows. A batch's mark
holds the newest time so far, so only the mark before it is read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from watchloom.operators.features import facet_counts, features_from_counts, window_end
from watchloom.schema import FEATURE_COLUMNS, FEATURE_KEYS
from watchloom.session import held
from watchloom.streaming.jobs import trigger

MARK = T.StructType([T.StructField("newest", T.TimestampType())])
COUNTS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("facet", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("num", T.DoubleType()),
        T.StructField("c", T.LongType()),
    ]
)


def late_gate(events: DataFrame, path: str, checkpoint: str, seconds: int = 300, delay: str = "10 minutes", mode: str = "tumbling", every: str | None = "1 minute") -> StreamingQuery:
    """Write on-time events to ``path/ontime`` and late ones to ``path/late``; together they are all events.

    An event without a time belongs to no window and is on time.
    """

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(MARK).parquet(f"{path}/marks/batch={number - 1}").first()["newest"] if number else None
        with held(batch) as rows:
            newest = rows.agg(F.greatest(F.max("ts"), F.lit(before).cast("timestamp")).alias("newest"))
            line = F.lit(before).cast("timestamp") - F.expr(f"interval {delay}")
            late = F.coalesce(window_end("ts", seconds, mode) <= line, F.lit(False))
            marked = rows.withColumn("_late", late)
            marked.where(~F.col("_late")).drop("_late").write.mode("overwrite").parquet(f"{path}/ontime/batch={number}")
            marked.where("_late").drop("_late").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            # the mark comes last: a batch without one is run again
            newest.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    return trigger(events.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint), every).start()


def gated(spark: SparkSession, path: str, part: str, schema: T.StructType) -> DataFrame:
    """The ``ontime`` or ``late`` events of a gate as a stream."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/{part}")


def amendments(late: DataFrame, counts: str, path: str, checkpoint: str, seconds: int = 300, mode: str = "tumbling", every: str | None = "1 minute") -> StreamingQuery:
    """Features of the windows that late events hit, written to ``path/features``.

    ``counts`` is where the feature job keeps the counts of closed windows; it has to have closed them first.
    """

    def amend(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        facet_counts(batch, seconds, mode).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        fresh = spark.read.schema(COUNTS).parquet(f"{path}/counts/batch={number}")
        hit = fresh.select(*FEATURE_KEYS).distinct()
        span = fresh.agg(F.min("window_end").alias("a"), F.max("window_end").alias("b")).first()
        if span["a"] is None:
            return
        between = F.col("window_end").between(F.lit(span["a"]), F.lit(span["b"]))
        earlier = spark.read.schema(T.StructType([*COUNTS.fields, T.StructField("batch", T.IntegerType())])).option("basePath", f"{path}/counts").parquet(f"{path}/counts").where(F.col("batch") <= number).drop("batch")
        known = _stored(spark, counts)
        every_row = (earlier if known is None else earlier.unionByName(known)).where(between)
        rows = every_row.join(hit, list(FEATURE_KEYS), "left_semi").groupBy(*FEATURE_KEYS, "facet", "text", "num").agg(F.sum("c").alias("c"))
        with held(rows) as both:
            features_from_counts(both, seconds).write.mode("overwrite").parquet(f"{path}/features/batch={number}")

    return trigger(late.writeStream.foreachBatch(amend).option("checkpointLocation", checkpoint), every).start()


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored counts; None while no window has closed."""
    try:
        return spark.read.schema(COUNTS).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException:
        return None


def amended_features(features: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """``features`` with the last amendment of each window that has one; windows that only late events hit are added."""
    names = [*FEATURE_KEYS, *FEATURE_COLUMNS]
    first = features.select(*names, F.lit(-1).alias("batch"))
    later = spark.read.option("basePath", f"{path}/features").parquet(f"{path}/features").select(*names, "batch")
    newest = first.unionByName(later).groupBy(*FEATURE_KEYS).agg(F.max_by(F.struct(*FEATURE_COLUMNS), "batch").alias("f"))
    return newest.select(*FEATURE_KEYS, "f.*")
