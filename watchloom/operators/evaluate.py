"""Detector evaluation, gating and registry."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions.columns import share
from watchloom.functions.ordered import interpolated_quantile, running_before
from watchloom.operators.alerts import latest_by

MIN_ROWS = 100


@dataclass(frozen=True)
class Detector:
    """One detector: its gate, retrain cadence and the paths derived from its name."""

    name: str
    metric: str
    threshold: float
    cadence: str  # daily | weekly (Saturday)
    at: str  # UTC time of day
    op: str = ">="
    environment: str = "dev"
    bucket: str = ""

    @property
    def pipeline_name(self) -> str:
        return f"{self.name}-{self.environment}-pipeline"

    @property
    def endpoint_name(self) -> str:
        return f"{self.name}-{self.environment}"

    def path(self, kind: str) -> str:
        tail = f"models/{self.name}/" if kind == "models" else f"{kind}/"
        return f"{self.bucket}/{self.environment}/{tail}"


# The four detectors, their gates and schedules.
DETECTORS = (
    Detector("rcf-metrics", "f1", 0.70, "daily", "02:00"),
    Detector("iforest-logs", "precision_top1pct", 0.80, "daily", "02:30"),
    Detector("lstm-ae-traces", "auc", 0.80, "weekly", "20:30"),
    Detector("log-embedding-anomaly", "precision_top1pct", 0.75, "weekly", "21:00"),
)


def detector_table(spark: SparkSession, detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    rows = [
        (d.name, d.metric, d.op, d.threshold, d.cadence, d.at, d.pipeline_name, d.endpoint_name, d.path("features"), d.path("eval"), d.path("models"))
        for d in detectors
    ]
    return spark.createDataFrame(
        rows,
        "detector string, metric string, op string, threshold double, cadence string, at string, pipeline_name string, "
        "endpoint_name string, input_path string, eval_path string, model_path string",
    )


def validate_input(df: DataFrame, min_rows: int = MIN_ROWS) -> dict[str, int]:
    """Count files and rows (one job) and fail on no files or too few rows."""
    per_file = df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    row = per_file.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    report = {"n_files": int(row["files"]), "n_rows": int(row["rows"])}
    if report["n_files"] == 0:
        raise ValueError("no input feature files found")
    if report["n_rows"] < min_rows:
        raise ValueError(f"only {report['n_rows']} rows, at least {min_rows} are needed")
    return report


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(s, pos, neg, c): one row per score; the one pass over the rows that all measures read off.

    A null label counts as negative; rows without a score are the row of the null score.
    """
    y = F.coalesce(F.col(label).cast("int") == 1, F.lit(False)) if label in df.columns else F.lit(False)
    rows = df.select(y.alias("y"), F.col(score).cast("double").alias("s"))
    return rows.groupBy("s").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"), F.count(F.lit(1)).alias("c"))


def is_counts(df: DataFrame) -> bool:
    return df.columns == ["s", "pos", "neg", "c"]


def _counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """``score_counts`` of rows; counts are taken as they are, so that stored ones serve several measures."""
    return df if is_counts(df) else score_counts(df, label, score)


def _with_cut(counts: DataFrame, q: float) -> DataFrame:
    """Add the quantile of all scores (a scalar subquery over the same counts; null without scores)."""
    return counts.withColumn("cut", interpolated_quantile(counts, [], "s", q, "cut", "c").scalar())


def _total(column: str, test: Column | None = None) -> Column:
    return F.coalesce(F.sum(column if test is None else F.when(test, F.col(column))), F.lit(0))


def f1_at_quantile(df: DataFrame, label: str = "is_anomaly", score: str = "anomaly_score", q: float = 0.99) -> DataFrame:
    """f1, precision, recall, n with 'anomalous' meaning score > the quantile."""
    flagged = F.coalesce(F.col("s") > F.col("cut"), F.lit(False))
    counts = _with_cut(_counts(df, label, score), q).agg(
        _total("pos", flagged).alias("tp"), _total("neg", flagged).alias("fp"), _total("pos", ~flagged).alias("fn"), _total("c").alias("n")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        share(tp * 2, tp * 2 + fp + fn).alias("f1"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        "n",
        F.when(F.col("n") == 0, F.lit("nothing to evaluate")).alias("note"),
    )


def precision_at_top(df: DataFrame, label: str = "is_anomaly", score: str = "anomaly_score", q: float = 0.99) -> DataFrame:
    """precision_top1pct, n: share of true anomalies with score >= the quantile."""
    top = F.coalesce(F.col("s") >= F.col("cut"), F.lit(False))
    counts = _with_cut(_counts(df, label, score), q).agg(_total("pos", top).alias("hit"), _total("c", top).alias("top"), _total("c").alias("n"))
    return counts.select(share(F.col("hit"), F.col("top")).alias("precision_top1pct"), "n")


def roc_auc(df: DataFrame, label: str = "is_anomaly", score: str = "recon_error") -> DataFrame:
    """auc, n: ties count half; a single class or a missing label column gives 0.0."""
    if label not in df.columns and not is_counts(df):
        return df.limit(0).agg(F.lit(0.0).alias("auc"), F.count(F.lit(1)).alias("n"))
    hist = _counts(df, label, score)
    # doubles: the product of two class sizes does not fit a long on large sets
    wins = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))
    totals = running_before(hist, [], "s", ["neg"]).agg(F.sum(wins).alias("u"), _total("pos").alias("p"), _total("neg").alias("q"))
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    return totals.select(
        F.when((p > 0) & (q > 0), F.col("u") / F.nullif(p * q, F.lit(0.0))).otherwise(F.lit(0.0)).alias("auc"),
        (F.col("p") + F.col("q")).cast("bigint").alias("n"),
    )


def metric_rows(metrics: DataFrame, detector: str) -> DataFrame:
    """One-row metric result to (detector, metric, value) rows."""
    names = [c for c in metrics.columns if c not in ("n", "note")]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return metrics.select(F.lit(detector).alias("detector"), F.explode(pairs).alias("m")).select("detector", "m.metric", "m.value")


def gate(metrics: DataFrame, detectors: DataFrame) -> DataFrame:
    """Verdict per detector on its gate metric; a missing metric counts as 0.0.

    Both sides hold one row per detector and metric; the join is left to the planner.
    """
    rows = detectors.select("detector", "metric", "op", "threshold").join(metrics, ["detector", "metric"], "left")
    value = F.coalesce("value", F.lit(0.0))
    passed = F.when(F.col("op") == ">=", value >= F.col("threshold")).otherwise(value <= F.col("threshold"))
    return rows.select("detector", "metric", value.alias("value"), "op", "threshold", passed.alias("passed"))


def verdict_text() -> Column:
    failed = F.concat(F.lit("GATE_FAILED "), F.col("metric"), F.lit("="), F.col("value"), F.lit(" op="), F.col("op"), F.lit(" thr="), F.col("threshold"))
    return F.when(F.col("passed"), F.concat(F.lit("REGISTERED "), F.col("detector"))).otherwise(failed)


def register_passed(verdicts: DataFrame, model_path: Column, created: Column, registry: DataFrame | None = None) -> DataFrame:
    """Registry rows to append for the detectors that passed, each with the version after its last one.

    ``registry`` has (detector, version); without it versions start at 1.
    """
    rows = verdicts.where("passed").select("detector", model_path.alias("model_path"), created.alias("created"), "metric", "value")
    if registry is None:
        return rows.withColumn("version", F.lit(1).cast("bigint"))
    last = registry.groupBy("detector").agg(F.max("version").alias("_last"))
    return rows.join(last, "detector", "left").withColumn("version", (F.coalesce("_last", F.lit(0)) + 1).cast("bigint")).drop("_last")


def append_registry(rows: DataFrame, path: str) -> None:
    """Add versions to the registry table; ``served_versions`` picks the newest of each detector."""
    rows.write.mode("append").parquet(path)


def commit_versions(rows: DataFrame, path: str) -> DataFrame:
    """Add a version of each detector in ``rows`` (detector, …); returns them with the version each one got.

    A version is claimed by creating a file that must not be there yet, which the file system grants to one writer
    alone; the loser of a race claims the next number. Rows are written under the claimed version, so two
    writers never share one, and a claim without rows (its writer died) is a number that is skipped. ``rows`` has a row a detector.
    """
    spark = rows.sparkSession
    names = sorted(r["detector"] for r in rows.select("detector").collect())
    versions = spark.createDataFrame([(n, claim_version(spark, path, n)) for n in names], "detector string, version long")
    given = rows.drop("version").join(versions, "detector")
    # a folder for each writer: two that commit into one folder would clear away each other's unfinished files
    given.write.parquet(f"{path.rstrip('/')}/rows/write={uuid.uuid4().hex}")
    return given


def claim_version(spark: SparkSession, path: str, detector: str) -> int:
    """The lowest number above all claimed ones that this writer gets."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path.rstrip('/')}/claims/{detector}")
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    system.mkdirs(folder)
    number = max((int(s.getPath().getName()) for s in system.listStatus(folder)), default=0) + 1
    while True:
        try:
            if system.createNewFile(hadoop.Path(folder, str(number))):
                return number
        except Py4JJavaError as error:
            if not system.exists(hadoop.Path(folder, str(number))):
                raise error
        number += 1


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """All committed versions."""
    return spark.read.parquet(f"{path.rstrip('/')}/rows").drop("write")


def served_versions(registry: DataFrame) -> DataFrame:
    """The newest registered version of each detector."""
    return latest_by(registry, ["detector"], [F.desc("created"), F.desc("version")])


def last_fire(now: Column, cadence: Column, at: Column) -> Column:
    """Latest scheduled start at or before ``now``: daily, or weekly on Saturday."""
    minutes = F.split_part(at, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(at, F.lit(":"), F.lit(2)).cast("int")
    daily = cadence == "daily"
    start = F.when(daily, F.date_trunc("day", now)).otherwise(F.date_trunc("week", now))
    days = F.when(daily, 0).otherwise(5)
    fire = start + F.make_dt_interval(days, F.lit(0), minutes)
    return F.when(fire > now, fire - F.make_dt_interval(F.when(daily, 1).otherwise(7))).otherwise(fire)


def retrain_due(runs: DataFrame, detectors: DataFrame, now: Column) -> DataFrame:
    """Detectors whose last run is older than their latest scheduled start."""
    last = runs.groupBy("detector").agg(F.max("finished").alias("last_run"))
    rows = detectors.select("detector", "cadence", "at").join(last, "detector", "left")
    fire = last_fire(now, F.col("cadence"), F.col("at"))
    return rows.select("detector", "cadence", "last_run", fire.alias("last_fire"), F.coalesce(F.col("last_run") < fire, F.lit(True)).alias("due"))
