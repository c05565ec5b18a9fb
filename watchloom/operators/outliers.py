"""Outliers in message text and in value sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.operators.forest import Forest, fit_forest, score_forest
from watchloom.session import held


def text_vectors(df: DataFrame, text: str, dims: int = 256, components: int = 8) -> DataFrame:
    """TF-IDF over hashed terms, projected to a few dense columns c0, c1, …

    The covariance the projection needs is dims x dims, independent of the row count.
    """
    from pyspark.ml.feature import IDF, PCA, HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    keep = df.columns
    rows = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+").transform(rows)
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims).transform(words).select(*keep, "_tf")
    # both fits pass over the term counts; keep those and not the text
    with held(counts.select("_tf")) as fitting:
        idf = IDF(inputCol="_tf", outputCol="_tfidf").fit(fitting)
        pca = PCA(k=components, inputCol="_tfidf", outputCol="_pc").fit(idf.transform(fitting))
    arr = pca.transform(idf.transform(counts)).withColumn("_a", vector_to_array("_pc"))
    return arr.select(*keep, *[F.col("_a")[i].alias(f"c{i}") for i in range(components)])


def text_outliers(df: DataFrame, keys: Sequence[str], text: str, dims: int = 256, components: int = 8, trees: int = 100) -> tuple[DataFrame, Forest]:
    vectors = text_vectors(df.select(*keys, text), text, dims, components).drop(text)
    forest = fit_forest(vectors, keys, [f"c{i}" for i in range(components)], trees=trees)
    return score_forest(vectors, forest), forest


def reconstruction_error(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, width: int = 5, components: int = 2) -> DataFrame:
    """Add ``recon_error``: distance of each sliding vector of values from a linear subspace.

    A linear stand-in for a sequence autoencoder (it is not one). The first
    width - 1 rows of a series have no full vector; their error is null.
    """
    from pyspark.ml.feature import PCA, VectorAssembler

    w = Window.partitionBy(*series).orderBy(*order)
    names = [f"_v{i}" for i in range(width)]
    rows = df.select("*", *[F.lag(value, i).over(w).alias(n) for i, n in enumerate(names)])
    with held(rows.select(*names).dropna()) as fitting:
        vec = VectorAssembler(inputCols=names, outputCol="_vec").transform(fitting)
        pc = PCA(k=components, inputCol="_vec", outputCol="_pc").fit(vec).pc.toArray()
        means = fitting.agg(*[F.avg(n).alias(n) for n in names]).first()
    centred = [F.col(n) - F.lit(float(means[n])) for n in names]

    def weighted(cols, weights):
        out = F.lit(0.0)
        for c, wt in zip(cols, weights):
            out = out + c * F.lit(float(wt))
        return out

    rows = rows.select("*", *[weighted(centred, pc[:, j]).alias(f"_p{j}") for j in range(components)])
    left = F.lit(0.0)
    for i in range(width):
        gap = centred[i] - weighted([F.col(f"_p{j}") for j in range(components)], pc[i, :])
        left = left + gap * gap
    return rows.select(*df.columns, F.sqrt(left).alias("recon_error"))
