"""Isolation forest (Liu, Ting and Zhou 2008) trained and scored as Spark jobs.

A forest needs only ``psi`` rows per tree, picked by a row hash, so a training job
shuffles a small multiple of trees * psi rows whatever the table's size. Each tree
is built from its bounded sample in one group; the node table has at most
trees * (2 * psi - 1) rows, which is what the driver reads back and ships to the
scoring tasks.

No generator keeps state: every draw is a hash of the seed and of what it is for (a row's keys, a tree, a node), so that a
retry, another partitioning or another engine draws the same. Nodes are numbered as in a heap (1; 2n and 2n + 1 below n).
Scores are rounded to 12 digits, so that rows with equal paths have equal scores.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.functions.ordered import interpolated_quantile
from watchloom.schema import FEATURE_COLUMNS
from watchloom.session import held

TREES, PSI, CONTAMINATION, SEED = 100, 256, 0.01, 42
SPARE = 4  # sampled rows per needed row, so that every tree fills its sample
NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, depth int, size int"


def mean_path(n: float) -> float:
    """Average path length of an unsuccessful search in a tree of n leaves."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


@dataclass
class Forest:
    nodes: pd.DataFrame
    columns: list[str]
    psi: int
    trees: int
    threshold: float = 0.5
    mean: float = 0.5
    std: float = 1.0

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"columns": self.columns, "psi": self.psi, "trees": self.trees, "threshold": self.threshold, "mean": self.mean, "std": self.std}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        return cls(nodes=spark.read.parquet(f"{path}/nodes").toPandas(), **meta)


DRAW_DIGITS = 13  # hexadecimal digits of a hash that make a draw: 52 bits, exact in a double


def _draw(*parts: object) -> float:
    """A number from 0 to 1 for the parts."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:DRAW_DIGITS], 16) / 16.0**DRAW_DIGITS


def _key_text(df: DataFrame, keys: Sequence[str]) -> Column:
    """Row keys as text, times as microseconds, whatever the session's time zone."""
    times = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    return F.concat_ws("|", *[F.coalesce((F.unix_micros(k) if k in times else F.col(k)).cast("string"), F.lit("")) for k in keys])


def tree_samples(df: DataFrame, keys: Sequence[str], columns: Sequence[str], n: int, trees: int, psi: int, seed: int) -> DataFrame:
    """(tree, columns…): psi rows for each tree, chosen by hashes of the row keys."""
    want = SPARE * psi * trees
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]

    def digest(*salt) -> Column:
        return F.md5(F.concat_ws("|", *[s if isinstance(s, Column) else F.lit(str(s)) for s in salt], F.col("_key")).cast("binary"))

    def unit(*salt) -> Column:
        return F.conv(F.substring(digest(*salt), 1, DRAW_DIGITS), 16, 10).cast("double") / F.lit(16.0**DRAW_DIGITS)

    # one rule at every size: a hash keeps a pool of about ``want`` rows (all, if there are fewer), and every tree draws from that
    share = min(1.0, want / max(n, 1))
    pool = df.withColumn("_key", _key_text(df, keys)).where(unit(seed) < share).select(*values, *keys, "_key", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    tree = F.col("tree").cast("string")
    rows = pool.where(unit(seed + 1, tree) < min(1.0, SPARE * psi / max(n * share, 1))).withColumn("draw", digest(seed + 2, tree))
    w = Window.partitionBy("tree").orderBy("draw", *keys)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= psi).select("tree", "rn", *columns)


def grow(x: np.ndarray, seed: int, tree: int, limit: int) -> list[tuple]:
    """Nodes of one isolation tree over a bounded sample: (node, feature, split, left, right, depth, size)."""
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, 1)]
    while todo:
        rows, depth, me = todo.pop()
        leaf = (me, -1, 0.0, -1, -1, depth, len(rows))
        lo, hi = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append(leaf)
            continue
        f = int(usable[int(_draw(seed, tree, me, "f") * len(usable))])
        cut = float(lo[f] + _draw(seed, tree, me, "c") * (hi[f] - lo[f]))
        if not lo[f] < cut <= hi[f]:
            nodes.append(leaf)
            continue
        below = x[rows, f] < cut
        nodes.append((me, f, cut, 2 * me, 2 * me + 1, depth, len(rows)))
        todo += [(rows[~below], depth + 1, 2 * me + 1), (rows[below], depth + 1, 2 * me)]
    return nodes


def fit_forest(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] = FEATURE_COLUMNS,
    trees: int = TREES,
    psi: int = PSI,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
) -> Forest:
    """Train on ``df``; ``keys`` identify a row, so retries draw the same sample."""
    columns = list(columns)
    with held(df.select(*keys, *columns)) as rows:
        n = rows.count()
        if n == 0:
            raise ValueError("no features")
        psi = min(psi, n)
        limit = max(1, math.ceil(math.log2(psi)))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            pdf = pdf.sort_values("rn")
            nodes = grow(pdf[columns].to_numpy(dtype=float), seed, tree, limit)
            out = pd.DataFrame(nodes, columns=["node", "feature", "split", "left", "right", "depth", "size"])
            out.insert(0, "tree", tree)
            return out

        nodes = tree_samples(rows, keys, columns, n, trees, psi, seed).groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
        forest = Forest(nodes.sort_values(["tree", "node"], ignore_index=True), columns, psi, trees)
        with held(score_forest(rows, forest, flag=False).select(F.col("anomaly_score").alias("v"))) as scores:
            stats = scores.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).first()
            cut = interpolated_quantile(scores, [], "v", 1.0 - contamination, "cut").first()
    forest.mean, forest.std, forest.threshold = float(stats["m"]), float(stats["s"]) or 1.0, float(cut["cut"])
    return forest


def path_lengths(x: np.ndarray, tables: list[dict[str, np.ndarray]]) -> np.ndarray:
    """Mean path length of each row over all trees, one vectorised walk per tree."""
    total = np.zeros(len(x))
    every = np.arange(len(x))
    for t in tables:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = t["feature"][at]
            inner = f >= 0
            if not inner.any():
                break
            go_left = x[every, np.where(inner, f, 0)] < t["split"][at]
            at = np.where(inner, np.where(go_left, t["left"][at], t["right"][at]), at)
        total += t["length"][at]
    return total / max(len(tables), 1)


def score_forest(df: DataFrame, forest: Forest, flag: bool = True) -> DataFrame:
    """Add ``anomaly_score`` in (0, 1], and with ``flag`` also ``is_anomaly`` and ``score_z``.

    ``score_z`` is the score in deviations from the training mean; alert thresholds
    such as 3.0 and 5.0 apply to it, not to the raw forest score.
    """
    tables = []
    for _, g in forest.nodes.sort_values(["tree", "node"]).groupby("tree", sort=True):
        size, node = g["size"].to_numpy(), g["node"].to_numpy()
        length = g["depth"].to_numpy(dtype=float) + np.array([mean_path(int(s)) for s in size])
        tables.append({
            "feature": g["feature"].to_numpy(), "split": g["split"].to_numpy(), "left": np.searchsorted(node, g["left"].to_numpy()), "right": np.searchsorted(node, g["right"].to_numpy()), "length": length,
        })
    norm = mean_path(forest.psi) or 1.0

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            x = np.stack(rows.to_numpy()).astype(float) if len(rows) else np.zeros((0, 1))
            yield pd.Series(np.round(np.power(2.0, -path_lengths(x, tables) / norm), 12))

    packed = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in forest.columns])
    out = df.withColumn("anomaly_score", score(packed))
    if not flag:
        return out
    return out.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(forest.threshold)).withColumn(
        "score_z", (F.col("anomaly_score") - F.lit(forest.mean)) / F.lit(forest.std)
    )
