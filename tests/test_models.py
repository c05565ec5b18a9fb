import numpy as np
import pytest
from pyspark.sql import functions as F

from watchloom.operators.forest import Forest, fit_forest, grow, mean_path, path_lengths, score_forest, tree_samples
from watchloom.operators.outliers import reconstruction_error, text_outliers
from watchloom.sources.generators import normal


def blob(spark, n=1500, odd=15):
    r = F.col("id")
    base = spark.range(n).select("id", normal(r, 1).alias("x"), normal(r, 11).alias("y"), F.lit(0).alias("is_anomaly"))
    far = spark.range(odd).select((r + n).alias("id"), (normal(r, 21) + 9).alias("x"), (normal(r, 31) - 9).alias("y"), F.lit(1).alias("is_anomaly"))
    return base.unionByName(far)


def test_forest_finds_injected_points(spark, tmp_path):
    df = blob(spark)
    forest = fit_forest(df, ["id"], ["x", "y"], trees=40)
    out = score_forest(df, forest)
    rows = out.select("anomaly_score", "is_anomaly", "score_z", "id").collect()
    assert all(0 < r.anomaly_score <= 1 for r in rows)
    assert {r.id for r in sorted(rows, key=lambda r: -r.anomaly_score)[:15]} == set(range(1500, 1515))
    assert 10 <= sum(r.is_anomaly for r in rows) <= 16
    assert abs(np.mean([r.score_z for r in rows])) < 1e-6
    forest.save(spark, str(tmp_path / "m"))
    again = Forest.load(spark, str(tmp_path / "m"))
    assert score_forest(df, again).select("anomaly_score").exceptAll(out.select("anomaly_score")).count() == 0


def test_forest_is_repeatable_whatever_the_partitions(spark):
    df = blob(spark, 600, 6)
    a = fit_forest(df, ["id"], ["x", "y"], trees=10)
    b = fit_forest(df.repartition(7), ["id"], ["x", "y"], trees=10)
    assert a.nodes.equals(b.nodes) and a.threshold == pytest.approx(b.threshold)
    assert not a.nodes.equals(fit_forest(df, ["id"], ["x", "y"], trees=10, seed=1).nodes)


@pytest.mark.parametrize("n, trees, psi", [(100, 5, 64), (20000, 10, 32), (2500, 10, 32), (3000, 10, 32)])
def test_every_tree_gets_its_sample(spark, n, trees, psi):
    df = spark.range(n).withColumn("x", F.col("id").cast("double"))
    got = tree_samples(df, ["id"], ["x"], n, trees, psi, 42).groupBy("tree").agg(F.count("*").alias("c"), F.count_distinct("x").alias("d")).collect()
    assert len(got) == trees and all(r.c == psi == r.d for r in got)


def test_empty_and_constant_input(spark):
    df = spark.createDataFrame([], "id long, x double")
    with pytest.raises(ValueError, match="no features"):
        fit_forest(df, ["id"], ["x"])
    same = spark.range(50).withColumn("x", F.lit(1.0))
    scores = {r[0] for r in score_forest(same, fit_forest(same, ["id"], ["x"], trees=5)).select("anomaly_score").collect()}
    assert len(scores) == 1


def test_tree_walk_matches_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    nodes = sorted(grow(x, 1, 0, 8))
    number = {n[0]: i for i, n in enumerate(nodes)}
    nodes = [(*n[:3], number.get(n[3], -1), number.get(n[4], -1), *n[5:]) for n in nodes]
    assert sum(n[6] for n in nodes if n[1] < 0) == 200 and len(nodes) <= 2 * 200 - 1

    def walk(row):
        at = nodes[0]
        while at[1] >= 0:
            at = nodes[at[3] if row[at[1]] < at[2] else at[4]]
        return at[5] + mean_path(at[6])

    t = list(zip(*nodes))
    table = {"feature": np.array(t[1]), "split": np.array(t[2]), "left": np.array(t[3]), "right": np.array(t[4]), "length": np.array([n[5] + mean_path(n[6]) for n in nodes])}
    assert path_lengths(x, [table]).tolist() == pytest.approx([walk(r) for r in x])


def test_mean_path_values():
    assert [mean_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert mean_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_text_outliers(spark):
    usual = [(i, f"user {i % 7} logged in from host {i % 5} ok") for i in range(300)]
    odd = [(1000 + i, "SELECT password FROM accounts UNION DROP TABLE ledger NOW") for i in range(3)]
    df = spark.createDataFrame(usual + odd, "id int, text string")
    scored, _ = text_outliers(df, ["id"], "text", dims=64, components=3, trees=30)
    top = [r.id for r in scored.orderBy(F.desc("anomaly_score")).limit(3).collect()]
    assert set(top) == {1000, 1001, 1002}


def test_reconstruction_error_rises_at_a_jump(spark):
    rows = [("s", i, float(np.sin(i / 3.0)) + (25.0 if i == 150 else 0.0)) for i in range(300)]
    out = reconstruction_error(spark.createDataFrame(rows, "s string, i int, v double"), ["s"], ["i"], "v")
    assert out.count() == 300 and out.where("recon_error is null").count() == 4
    top = [r.i for r in out.orderBy(F.desc("recon_error")).limit(5).collect()]
    assert set(top) <= set(range(150, 155))
