"""The corpus pipeline: stages over the documents, each written as Parquet and read again for the next.

Documents may be long, so every stage sets the session to read and to hand over few of them at a time (``SETTINGS``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from umbra.llm import dedup, mixing, ngram_join, packing, quality
from umbra.llm.common import staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Of the session while the pipeline runs: what a task holds of the documents at once. Results do not depend on it.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304b",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}


def with_settings(stage: Stage) -> Stage:
    """The stage's result is computed later, so the settings stay."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        return stage(spark, docs, sf_dir)

    return run_stage


@with_settings
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


@with_settings
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return dedup.drop_copies(docs)


@with_settings
def ngram_join_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays."""
    return ngram_join.drop_similar(docs)


@with_settings
def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics have their target shares."""
    return mixing.sampled(docs)


@with_settings
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_join_dedup),
    ("mixing", mixing_to_targets),
    ("packing", pack),
]

#: The classifier, the raking loop and the packer have no SQL form; the operators are held against brute force, the stages' effects in tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
