"""Input drift against a reference period, and seasonal residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.columns import nonzero
from watchloom.functions.ordered import running_before


def mean_shift(df: DataFrame, columns: Sequence[str], is_reference: Column, sigmas: float = 3.0) -> DataFrame:
    """|mean now - mean then| / deviation then, per column, and whether it drifted."""
    then, now = is_reference, ~is_reference
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [
            F.avg(F.when(then, v)).alias(f"{c}|ref"), F.stddev_pop(F.when(then, v)).alias(f"{c}|std"), F.avg(F.when(now, v)).alias(f"{c}|cur"),
        ]
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}|ref").alias("ref_mean"), F.col(f"{c}|std").alias("ref_std"), F.col(f"{c}|cur").alias("cur_mean"))
        for c in columns
    ])
    out = df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    shift = F.abs(F.col("cur_mean") - F.col("ref_mean")) / nonzero(F.col("ref_std"))
    return out.withColumn("shift", shift).withColumn("drifted", F.col("shift") >= sigmas)


def _stacked(df: DataFrame, columns: Sequence[str], is_reference: Column) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(is_reference.alias("ref"), F.explode(pairs).alias("p")).select("ref", "p.feature", "p.value").where(F.col("value").isNotNull())


def kl_divergence(df: DataFrame, columns: Sequence[str], is_reference: Column, bins: int = 20, smoothing: float = 1.0) -> DataFrame:
    """KL(current || reference) over equal bins of the reference range, add-one smoothed.

    Values outside the reference range fall into the outermost bins.
    """
    long = _stacked(df, columns, is_reference)
    # one row per feature name given by the caller, so this side is of a known size
    span = long.where("ref").groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = nonzero((F.col("hi") - F.col("lo")) / F.lit(float(bins)))
    bin_no = F.least(F.greatest(F.floor((F.col("value") - F.col("lo")) / width), F.lit(0)), F.lit(bins - 1))
    cells = (
        long.join(F.broadcast(span), "feature")
        .groupBy("feature", bin_no.alias("bin"))
        .agg(F.count_if(F.col("ref")).alias("q"), F.count_if(~F.col("ref")).alias("p"))
    )
    whole = Window.partitionBy("feature")
    mass = F.lit(smoothing * bins)
    cells = cells.withColumn("pn", F.sum("p").over(whole) + mass).withColumn("qn", F.sum("q").over(whole) + mass)
    pr, qr = (F.col("p") + smoothing) / F.col("pn"), (F.col("q") + smoothing) / F.col("qn")
    empty_p, empty_q = F.lit(smoothing) / F.first("pn"), F.lit(smoothing) / F.first("qn")
    absent = F.lit(bins) - F.count(F.lit(1))
    return cells.groupBy("feature").agg(
        (F.sum(pr * F.ln(pr / qr)) + absent * empty_p * F.ln(empty_p / empty_q)).alias("kl"), F.count(F.lit(1)).alias("bins_used")
    )


def ks_statistic(df: DataFrame, columns: Sequence[str], is_reference: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per column."""
    hist = _stacked(df, columns, is_reference).groupBy("feature", "value").agg(F.count_if(F.col("ref")).alias("r"), F.count_if(~F.col("ref")).alias("c"))
    # one row per feature name given by the caller, so this side is of a known size
    totals = hist.groupBy("feature").agg(F.sum("r").alias("rn"), F.sum("c").alias("cn"))
    cum = running_before(hist, ["feature"], "value", ["r", "c"]).join(F.broadcast(totals), "feature")
    gap = F.abs((F.col("r_before") + F.col("r")) / F.col("rn") - (F.col("c_before") + F.col("c")) / F.col("cn"))
    return cum.where((F.col("rn") > 0) & (F.col("cn") > 0)).groupBy("feature").agg(
        F.max(gap).alias("ks"), F.max("rn").alias("n_ref"), F.max("cn").alias("n_cur")
    )


PROFILE_BINS = 200


def profile(df: DataFrame, columns: Sequence[str], bins: int = PROFILE_BINS) -> DataFrame:
    """A reference period in one row a column, to be stored and compared with later periods.

    (feature, n, mean, std, lo, hi, counts): moments, range, and how many values fall into each of ``bins`` equal
    parts of the range. Nulls do not count; a column without values has a row with n = 0.
    """
    long = _stacked(df, columns, F.lit(True))
    v = F.col("value")
    spans = long.groupBy("feature").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    # one row per feature name given by the caller, so this side is of a known size
    cells = long.join(F.broadcast(spans.select("feature", "lo", "hi")), "feature").groupBy("feature", _bin(bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    counts = cells.groupBy("feature").agg(_counted(bins).alias("counts"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    none = F.array_repeat(F.lit(0).cast("bigint"), bins)
    return names.join(spans, "feature", "left").join(counts, "feature", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "counts": F.coalesce("counts", none)})


def _bin(bins: int) -> Column:
    """Which part of the reference range a value falls into; values outside fall into the outermost."""
    width = nonzero((F.col("hi") - F.col("lo")) / F.lit(float(bins)))
    return F.least(F.greatest(F.floor((F.col("value") - F.col("lo")) / width), F.lit(0)), F.lit(bins - 1)).cast("int")


def _counted(bins: int) -> Column:
    """(bin, c) rows of a feature as an array of ``bins`` counts."""
    pairs = F.map_from_entries(F.collect_list(F.struct("bin", "c")))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(pairs, i), F.lit(0).cast("bigint")))


def against_profile(df: DataFrame, reference: DataFrame, bins: int = PROFILE_BINS, sigmas: float = 3.0, smoothing: float = 1.0) -> DataFrame:
    """A period against a stored profile: mean shift, KL divergence and Kolmogorov-Smirnov distance per column.

    The reference period is not read again. KL is add-one smoothed; the distance is taken at the borders of
    the parts, so it misses at most what one part holds. ``n_cur`` = 0 gives null distances.
    """
    columns = [r["feature"] for r in reference.select("feature").collect()]
    long = _stacked(df, columns, F.lit(True))
    cells = (
        long.join(F.broadcast(reference.select("feature", "lo", "hi")), "feature")
        .groupBy("feature", _bin(bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("c"), F.sum("value").alias("s"))
    )
    now = cells.groupBy("feature").agg(F.sum("c").alias("n_cur"), (F.sum("s") / F.sum("c")).alias("cur_mean"), _counted(bins).alias("now"))
    both = reference.join(now, "feature", "left").withColumn("n_cur", F.coalesce("n_cur", F.lit(0)))
    shift = F.abs(F.col("cur_mean") - F.col("mean")) / nonzero(F.col("std"))
    mass = F.lit(smoothing * bins)
    each = F.zip_with("now", "counts", lambda p, q: ((p + smoothing) / (F.col("n_cur") + mass)) * F.ln(((p + smoothing) / (F.col("n_cur") + mass)) / ((q + smoothing) / (F.col("n") + mass))))
    kl = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    steps = F.zip_with("now", "counts", lambda p, q: p / F.col("n_cur") - q / F.col("n"))
    start = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("most"))
    ks = F.aggregate(steps, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.greatest(a["most"], F.abs(a["at"] + x)).alias("most")))["most"]
    known = (F.col("n_cur") > 0) & (F.col("n") > 0)
    return both.select(
        "feature", F.col("n").alias("n_ref"), "n_cur", shift.alias("shift"), (shift >= sigmas).alias("drifted"), F.when(known, kl).alias("kl"), F.when(known, ks).alias("ks")
    )


def seasonal_z(points: DataFrame, series: Sequence[str], value: str = "value", how: str = "sum", threshold: float = 3.0) -> DataFrame:
    """Hourly totals against the mean and deviation of the other totals of the same hour of the week.

    Leaving the total itself out lets a single outlier stand out however few weeks there are; a slot needs three.
    The sums are of distances from the slot's mean, so no digits are lost to large totals.
    """
    hour = F.date_trunc("hour", "ts")
    agg = {"sum": F.sum(value), "mean": F.avg(value), "count": F.count(F.lit(1)).cast("double")}[how]
    hourly = points.groupBy(*series, hour.alias("hour")).agg(agg.alias("value"))
    slot = F.dayofweek("hour") * 24 + F.hour("hour")
    w = Window.partitionBy(*series, "slot")
    others = F.col("_n") - 1
    return (
        hourly.withColumn("slot", slot)
        .withColumns({"_n": F.count("value").over(w), "_mean": F.avg("value").over(w), "_all": F.var_pop("value").over(w)})
        .withColumn("_away", F.col("value") - F.col("_mean"))
        .withColumn("expected", F.when(others > 0, F.col("_mean") - F.col("_away") / others))
        .withColumn("_left", (F.col("_n") * F.col("_all") - F.col("_away") * F.col("_away")) / others - F.pow(F.col("_away") / others, 2))
        .withColumn("spread", F.when(others > 1, F.sqrt(F.greatest(F.col("_left"), F.lit(0.0)))))
        .drop("_n", "_mean", "_all", "_away", "_left")
        .withColumn("z", F.when(F.col("spread") > 1e-9, (F.col("value") - F.col("expected")) / F.col("spread")).otherwise(F.lit(0.0)))
        .withColumn("anomalous", F.abs("z") > threshold)
    )
