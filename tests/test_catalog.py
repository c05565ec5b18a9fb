"""Every catalogue query against its SQL, on the smallest data set."""

import os
import sys
from pathlib import Path

import pandas as pd
import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as spark_entry  # noqa: E402

from watchloom.plans.catalog import CATALOG as QUERIES  # noqa: E402
from watchloom.plans.oracle import ORACLE as SQL  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
ROWS_ONLY = {"distinct_ips_sketch", "tfidf_outliers", "recon_error"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def cells(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return "-"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return v if isinstance(v, str) else repr(float(v))

    df = df[sorted(df.columns)]
    return sorted(tuple(text(v) for v in row) for row in df.itertuples(index=False))


def test_every_query_has_sql_or_is_known_not_to():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY and not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["ts", "rule", "metric", "value", "source", "host", "severity", "detector"] and df.count() > 0
