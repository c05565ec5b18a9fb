"""Session construction and the few cluster settings the library relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "watchloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here assumes (UTC, AQE, RocksDB state)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for stream checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is used
    only where that is unset and the session is local.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return _local_dir()


@lru_cache(maxsize=1)
def _local_dir() -> str:
    """One temporary folder for a process that runs Spark in itself; it goes when the process ends."""
    path = tempfile.mkdtemp(prefix="watchloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def new_run_dir(spark: SparkSession, label: str) -> str:
    """A fresh subfolder of the shared folder for one run."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"




@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """Keep ``df`` cached for a few passes; a cache the caller already had is left alone.

    Blocks lost with an executor are recomputed from the input.
    """
    level = df.storageLevel
    if level.useMemory or level.useDisk:
        yield df
        return
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


@contextmanager
def option(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Hold a session option for a while; a stream started meanwhile keeps it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
