"""The registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, exactdup, langid, lexical, linedup, neardup, packing, pii, quality, secrets, spelling, suffixes, warc
from factloom.llm.settings import small_batches

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_digests(_documents(spark, folder))


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(_documents(spark, folder))


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(_documents(spark, folder))


def op4_quality_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(_documents(spark, folder))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exactdup.groups(_documents(spark, folder))


def op6_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return warc.digests(spark.read.parquet(f"{folder}/pages.parquet"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linedup.digests(_documents(spark, folder))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(_documents(spark, folder))


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan(_documents(spark, folder))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.digests(_documents(spark, folder))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digests(_documents(spark, folder))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_documents(spark, folder))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_best_fit_packing, op2_minhash_near_dedup, op3_secret_scan, op4_quality_divergence, op5_exact_dedup, op6_warc_revisits, op7_line_dedup, op8_bpe, op9_personal_data, op10_language_id, op11_lexical_search, op12_suffix_dedup, op13_spelling_variants)}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op6_warc_revisits": warc.SQL,
    "op7_line_dedup": linedup.SQL,
    "op11_lexical_search": lexical.SQL,
}
