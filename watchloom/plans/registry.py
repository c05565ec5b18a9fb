"""The table of registered queries and what queries share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query; results carry zone-free timestamps read as UTC."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        df = fn(spark, sf_dir)
        return df.select(*[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ])

    CATALOG[fn.__name__] = run
    return run


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Drop the last digits of sums whose order of addition is not fixed."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")
