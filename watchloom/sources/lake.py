"""Lake tables: NDJSON events, feature Parquet, anomalies, retention."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.operators.alerts import anomaly_rows, upsert
from watchloom.schema import EVENT_SCHEMA, FEATURE_SCHEMA, TIME_FORMAT

RETENTION_DAYS = 90
CORRUPT = "_corrupt_record"


def read_events(spark: SparkSession, path: str, strict: bool = True, partitioned: bool = False, named: bool = False) -> DataFrame:
    """NDJSON events from the ``.json`` / ``.jsonl`` files below ``path``.

    Blank lines are skipped. ``strict`` fails on a malformed line; otherwise such
    lines come back in ``_corrupt_record``. With ``partitioned`` the ``source=…`` and
    ``date=…`` folders become columns that prune the scan. ``named`` adds ``file``, the path that a line came from.
    """
    read = _events_reader(spark, path, strict, partitioned).json(path)
    return read.select("*", F.col("_metadata.file_path").alias("file")) if named else read


def _events_reader(spark: SparkSession, path: str, strict: bool, partitioned: bool) -> DataFrameReader:
    reader = spark.read.option("recursiveFileLookup", str(not partitioned).lower()).option("pathGlobFilter", "*.{json,jsonl}")
    schema = T.StructType(list(EVENT_SCHEMA.fields))
    if partitioned:
        reader = reader.option("basePath", path)
        schema = T.StructType([f for f in schema.fields if f.name != "source"])
    if strict:
        return reader.option("mode", "FAILFAST").schema(schema)
    return reader.option("columnNameOfCorruptRecord", CORRUPT).schema(schema.add(CORRUPT, "string"))


def split_corrupt(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): a reject is the line as it came and, if the scan named them, its file."""
    kept = [c for c in (CORRUPT, "file") if c in events.columns]
    # Spark does not read broken lines alone, so a column of the events takes part in the test
    broken = F.col(CORRUPT).isNotNull() & (F.coalesce(F.length("message"), F.lit(0)) >= 0)
    return events.where(F.col(CORRUPT).isNull()).drop(CORRUPT), events.where(broken).select(*kept)


def write_raw_events(events: DataFrame, path: str) -> None:
    """Append NDJSON under ``source=…/date=…``."""
    events.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("source", "date").json(path, timestampFormat=TIME_FORMAT)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """All feature files below ``path``; none at all is an error."""
    df = spark.read.schema(FEATURE_SCHEMA).option("recursiveFileLookup", "true").parquet(path)
    if df.isEmpty():
        raise ValueError("no features")
    return df


def write_features(features: DataFrame, path: str) -> bool:
    """Replace the days present in ``features``; with no rows nothing is written."""
    if features.isEmpty():
        return False
    (
        features.withColumn("date", F.to_date("window_end"))
        .repartition("date", F.pmod(F.xxhash64("source", "host"), F.lit(16)))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    )
    return True


def append_anomalies(alerts: DataFrame, path: str, quarantine: str) -> None:
    """Append complete rows by day; rows that miss a required field go to quarantine."""
    good, bad = anomaly_rows(alerts)
    good.write.mode("append").partitionBy("date").parquet(path)
    bad.write.mode("append").parquet(quarantine)


def read_anomalies(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where((F.col("date") >= F.to_date(F.lit(since))) & (F.col("ts") >= F.lit(since).cast("timestamp"))) if since else df


def write_alert_batch(alerts: DataFrame, store: str, batch: int, version: str = "ingest_seq") -> None:
    """Add one batch of alerts to the store; writing a batch again replaces it.

    The cost is that of the batch: ids are settled when the store is read.
    """
    rows = alerts.withColumn(version, F.lit(batch).cast("bigint"))
    rows.write.mode("overwrite").parquet(f"{store.rstrip('/')}/deltas/batch={batch}")


def write_heartbeats(alerts: DataFrame, store: str, batch: int) -> None:
    """When each source of a batch last spoke; writing a batch again replaces it."""
    alerts.groupBy("source").agg(F.max("ts").alias("last_seen")).write.mode("overwrite").parquet(f"{store.rstrip('/')}/heartbeats/batch={batch}")


def read_heartbeats(spark: SparkSession, store: str) -> DataFrame:
    """Last time of each source over all batches."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{store}/heartbeats").groupBy("source").agg(F.max("last_seen").alias("last_seen"))


def read_alerts(spark: SparkSession, store: str, version: str = "ingest_seq") -> DataFrame:
    """The newest row per alert id over the last snapshot and the batches after it."""
    return _newest(spark, store, version).drop(version)


def compact_alerts(spark: SparkSession, store: str, version: str = "ingest_seq") -> str:
    """Fold all batches into a new snapshot and return its path.

    A failed run leaves the last snapshot whole. Batches that are in a snapshot are not
    read again, so they may be deleted at any later time.
    """
    last = latest_snapshot(spark, store)
    number = int(last.rsplit("=", 1)[1]) + 1 if last else 0
    target = f"{store.rstrip('/')}/snapshots/snapshot={number}"
    _newest(spark, store, version).write.mode("overwrite").parquet(target)
    return target


def _newest(spark: SparkSession, store: str, version: str) -> DataFrame:
    """A snapshot's highest version is the last batch in it: that batch's newest rows always survive.
    The folder of a later batch is all that is listed and read besides."""
    snapshot, deltas = _snapshot(spark, store), spark.read.parquet(f"{store}/deltas")
    if snapshot is not None:
        last = snapshot.agg(F.max(version)).first()[0]
        deltas = deltas.where(F.col("batch") > F.lit(-1 if last is None else last))
    return upsert(snapshot, deltas.drop("batch"), version=version)


def _snapshot(spark: SparkSession, store: str) -> DataFrame | None:
    path = latest_snapshot(spark, store)
    return spark.read.parquet(path) if path else None


def latest_snapshot(spark: SparkSession, store: str) -> str | None:
    """Path of the newest complete snapshot, from a listing of the store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{store}/snapshots")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [
        s.getPath() for s in fs.listStatus(path)
        if s.getPath().getName().startswith("snapshot=") and fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))
    ]
    return max((str(p) for p in done), key=lambda p: int(p.rsplit("=", 1)[1]), default=None)


def kept(date: Column | str, today: Column, days: int = RETENTION_DAYS) -> Column:
    """Partition predicate: inside the retention period."""
    col = F.col(date) if isinstance(date, str) else date
    return col >= F.date_sub(F.to_date(today), days)


def expired_days(df: DataFrame, today: Column, date: str = "date", days: int = RETENTION_DAYS) -> DataFrame:
    """Days whose partitions may be deleted, with their row counts."""
    return df.where(~kept(date, today, days)).groupBy(date).agg(F.count(F.lit(1)).alias("rows"))


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified, bytes) of all files below ``path``, from a listing alone: contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def expired_objects(spark: SparkSession, path: str, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Files that were written more than ``days`` days before ``now``."""
    return objects(spark, path).where(F.col("modified") < now - F.make_dt_interval(F.lit(days)))


def delete_objects(files: DataFrame) -> int:
    """Delete the listed files and return how many went; files that are gone already do not count.

    The list goes through the driver piece by piece; each deletion is one call to the file system.
    """
    spark, gone = files.sparkSession, 0
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for row in files.select("file").toLocalIterator():
        target = hadoop.Path(row["file"])
        gone += bool(target.getFileSystem(conf).delete(target, False))
    return gone


def append_feedback(feedback: DataFrame, path: str) -> None:
    from watchloom.operators.alerts import valid_feedback

    valid_feedback(feedback).write.mode("append").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Evaluation metrics (one row per detector) as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)




def materialised(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once and return the written table, for plans that read it several times."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
