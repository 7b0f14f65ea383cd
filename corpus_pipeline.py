"""A corpus through five stages: quality, near duplicates, benchmark decontamination, secrets, and the mixture.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which the caller writes as Parquet and reads again as the next
stage's ``docs``. All but the last return the columns of ``documents``; what a stage decides takes effect in its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wideframe.llm import stages

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", stages.keep_quality),
    ("near_duplicates", stages.keep_first_of_near_duplicates),
    ("decontaminate", stages.drop_contaminated),
    ("secrets", stages.redact_secrets),
    ("mixture", stages.mix),
]

#: The quality stage trains a network, which SQL cannot express; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stages.written(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
