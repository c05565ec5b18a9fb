"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, benchmark leaks go,
sources are mixed to target weights, and the result becomes token files.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. ``run`` writes
each stage's rows as Parquet to the shared folder and reads them back for the next.
SQL cannot express the stages, so ``ORACLE_SQL`` is None; tests hold ``run`` against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchloom.llm import decontaminate, mixing, nearjoin, tokens, toxicity
from watchloom.llm.common import stored, table
from watchloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, base = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model, base)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearjoin.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    indexes = decontaminate.build_indexes(table(spark, sf_dir, "benchmark"))
    return decontaminate.without_leaks(docs, indexes)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_table(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("mix_sources", mix_sources),
    ("token_files", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
