"""Commands over a folder of tables: ingest, search, tables, audit, answer, query."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import service
from factloom.operators import index
from factloom.plans.queries import QUERIES
from factloom.sources import reports


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="python -m factloom", description=__doc__)
    parser.add_argument("command", choices=("ingest", "search", "tables", "audit", "answer", "query"))
    parser.add_argument("folder", help="folder with the tables as Parquet")
    parser.add_argument("--name", help="query: its name")
    parser.add_argument("--text", default="", help="search: what to look for")
    parser.add_argument("--top-k", type=int, default=10)
    parser.add_argument("--region", help="search and answer: the report's region")
    parser.add_argument("--metric", default="order count")
    parser.add_argument("--years", type=int, nargs="*", default=[])
    parser.add_argument("--residence", default=None)
    parser.add_argument("--rank", action="store_true", help="answer: rank the entities of the region's report")
    parser.add_argument("--rows", type=int, default=50, help="rows that are shown")
    return parser


def _answer(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    corpus = service.corpus_of(spark, a.folder)
    documents = corpus.pages.select("document_id", "region").distinct().filter(F.lower("region") == (a.region or "").lower())
    kind = "ranking" if a.rank else "year_change" if len(a.years) > 1 else "lookup"
    none = F.lit(None).cast("string")
    year = F.lit(a.years[0] if a.years else None).cast("int")
    years = F.array(*map(F.lit, a.years)).cast("array<int>")
    specs = documents.select(F.lit("asked").alias("spec_id"), F.lit(kind).alias("kind"), "document_id", "region", F.lit(a.metric).alias("metric"), year.alias("year"), years.alias("years"), F.lit(a.residence).cast("string").alias("residence"), none.alias("population"), none.alias("entity_kind"))
    return service.answer(corpus, specs)


def run(spark: SparkSession, arguments: Sequence[str]) -> DataFrame:
    """The rows that a command line asks for."""
    a = _parser().parse_args(arguments)
    if a.command == "query":
        if a.name not in QUERIES:
            raise SystemExit(f"no such query: {a.name}; there are {', '.join(sorted(QUERIES))}")
        return QUERIES[a.name](spark, a.folder)
    if a.command == "ingest":
        return service.ingest(reports.state_reports(spark, a.folder)).report
    if a.command == "answer":
        return _answer(spark, a)
    corpus = service.corpus_of(spark, a.folder)
    if a.command == "search":
        asked = spark.range(1).select(F.lit("asked").alias("query_id"), F.lit(a.text).alias("query"), F.lit(None).cast("array<double>").alias("vector"))
        none = corpus.chunks.select("chunk_id", F.lit(None).cast("array<double>").alias("vector")).limit(0)
        rows, _ = service.search(corpus, asked, none, a.top_k, regions=[a.region] if a.region else None)
        return rows.select("rank", "score", "document_id", "page_number", F.array_join("section_path", " > ").alias("section"), "citation_snippet").orderBy("rank")
    if a.command == "tables":
        return corpus.facts.groupBy("document_id", "table_id", "title").agg(F.count("*").alias("n_facts")).orderBy("document_id", "table_id")
    return index.audit(corpus.chunks, corpus.chunks.count())


def main() -> None:
    rows = _parser().parse_args().rows
    spark = SparkSession.builder.appName("factloom").getOrCreate()
    run(spark, sys.argv[1:]).show(rows, truncate=120)


if __name__ == "__main__":
    main()
