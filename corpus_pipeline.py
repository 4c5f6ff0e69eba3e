"""A corpus pipeline over ``documents`` in stages, each of which is written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exactdup, langid, neardup, packing, pii
from factloom.llm.settings import small_batches
from factloom.plans.staging import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language can be told, under that language; others, and those without a letter, go."""
    small_batches(spark)
    return langid.identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts the row with the smallest ``doc_id``."""
    small_batches(spark)
    return exactdup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near copies."""
    small_batches(spark)
    return neardup.without_near_copies(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document, its personal data replaced by the kind in brackets; ``n_chars`` follows."""
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents with their place in a sequence of 1024 tokens."""
    small_batches(spark)
    return packing.pack_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near-dedup", drop_near_copies),
    ("personal data", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

#: Classifiers, weighted sampling and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
