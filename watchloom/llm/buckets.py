"""Comparing the members of hash buckets without emitting their pairs.

A node has several codes. A pair that meets in many buckets belongs to the first of them, so
counts of links need no pair table. A bucket of more than ``BLOCK`` members is cut into chunks
and every pair of chunks is a task's work item, so no bucket is gathered in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048


def shared_keys(keys: DataFrame, key: list[str], node: str = "node") -> DataFrame:
    """Rows of ``keys`` (key columns, node) whose bucket has other members too, with their work items lo, hi."""
    sizes = keys.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("_m", F.ceil(F.col("_n") / BLOCK).cast("int"))
    rows = keys.join(sizes.select(*key, "_m"), key).withColumn("_c", F.pmod(F.xxhash64(node), F.col("_m")).cast("int"))
    rows = rows.withColumn("_d", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    return rows.select(*key, node, F.least("_c", "_d").alias("lo"), F.greatest("_c", "_d").alias("hi"), F.col("_c").alias("chunk"))


def dealt(rows: DataFrame, key: list[str], node: str = "node") -> DataFrame:
    """Work items together and in order, for a task that reads them as a stream."""
    return rows.repartition(*key, "lo", "hi").sortWithinPartitions(*key, "lo", "hi", node)


def group_ids(columns: list[np.ndarray]) -> np.ndarray:
    """Number of each row's group in rows that are sorted by ``columns``."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def pairs_within(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every i < j of one group, for groups in order."""
    left, right = [], []
    for d in range(1, int(np.bincount(group).max(initial=1))):
        i = np.flatnonzero(group[d:] == group[:-d])
        if not len(i):
            break
        left.append(i)
        right.append(i + d)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def spanning(pairs_i: np.ndarray, pairs_j: np.ndarray, n: int) -> np.ndarray:
    """Places of pairs that connect what all of them connect; at most n - 1."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (i, j) in enumerate(zip(pairs_i.tolist(), pairs_j.tolist(), strict=True)):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(k)
    return np.array(kept, np.int64)
