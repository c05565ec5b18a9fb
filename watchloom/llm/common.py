"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.session import new_run_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = new_run_dir(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, *keys: str, most: int = 10_000) -> DataFrame:
    """Deal a short table of work items out to tasks of their own (adaptive execution would join them into one)."""
    return rows.repartition(max(1, min(rows.count(), most)), *keys)


def utf8_bytes(text: Column) -> Column:
    """Length of the UTF-8 form, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
# what str.split() takes for white space besides those
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str) -> list[str]:
    """The runs of characters that are not ASCII white space."""
    return _WORDS.findall(text) if _OTHER_SPACE.search(text) else text.split()


def by_key(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Regroup batches that are sorted by ``key``: every table holds whole groups, many small ones together."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() if batch.num_rows < 2 else batch.column(k) for k in key]
        last = [c[batch.num_rows - 1] for c in columns]
        cut = batch.num_rows
        # rows of the group that may go on in the next batch stay behind
        while cut and all(c[cut - 1] == v for c, v in zip(columns, last, strict=True)):
            cut -= 1
        if cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = []
        kept.append(batch.slice(cut))
        if len(kept) > 1 and [kept[0].column(k)[0].as_py() for k in key] != [kept[-1].column(k)[0].as_py() for k in key]:
            yield pa.Table.from_batches(kept[:-1])
            kept = kept[-1:]
    if kept:
        yield pa.Table.from_batches(kept)
