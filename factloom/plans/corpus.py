"""The indexed corpus of one folder: pages, chunks, tables and facts, each built once in a session."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import chunking, tables
from factloom.plans.staging import staged
from factloom.sources import reports


class Corpus:
    """Written tables of paged reports; each is made when it is first asked for, from those before it."""

    def __init__(self, pages: DataFrame) -> None:
        self.pages = pages

    @cached_property
    def chunks(self) -> DataFrame:
        return staged(chunking.chunk_pages(self.pages), "chunks")

    @cached_property
    def tables(self) -> DataFrame:
        return staged(tables.statement_tables(self.pages), "tables")

    @cached_property
    def columns(self) -> DataFrame:
        return staged(tables.table_columns(self.tables), "columns")

    @cached_property
    def rows(self) -> DataFrame:
        return staged(tables.table_rows(self.tables, self.chunks), "rows")

    @cached_property
    def facts(self) -> DataFrame:
        return staged(tables.facts_of(self.columns, self.rows), "facts")


_built: dict[tuple, Corpus] = {}


def _version(spark: SparkSession, folder: str) -> tuple:
    """Sizes and times of the files that reports are made of: a changed one is another corpus."""
    context = spark.sparkContext
    out = []
    for name in ("orders", "customer", "nation", "region"):
        at = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        status = at.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(at)
        out.append((status.getLen(), status.getModificationTime()))
    return tuple(out)


def built(pages: DataFrame) -> Corpus:
    """Written pages of reports, and chunks, printed tables, their columns, rows and facts as they are asked for."""
    return Corpus(staged(pages, "pages"))


def corpus(spark: SparkSession, folder: str, source: str = "state") -> Corpus:
    """Ingest the reports of a folder: written tables that all queries of the session share."""
    key = (spark.sparkContext.applicationId, folder, source, _version(spark, folder))
    if key not in _built:
        _built[key] = built((reports.state_reports if source == "state" else reports.irregular_reports)(spark, folder))
    return _built[key]
