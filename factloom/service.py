"""One call each: ingest reports, search them, answer typed requests.

Nothing raises for a condition of the data: failures are rows with a status
and a reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import calculations, chunking, collect, facts, index, pages, retrieval
from factloom.plans.corpus import Corpus, built
from factloom.plans.staging import release, staged

#: Chunks of a request to an embedder, and the error codes that a caller may see with their status.  A refusal and thin
#: evidence are answers (200) that say so in their body; only a request that is at fault, something unknown and a
#: provider's failure have other codes.
REQUEST_CHUNKS = 16
STATUS = {"ok": 200, "blank_query": 422, "insufficient_evidence": 200, "candidate_evidence": 200, "refused": 200, "DOCUMENT_WITHDRAWN": 404, "UNKNOWN_DOCUMENT": 404, "PROVIDER_RATE_LIMITED": 429, "PROVIDER_TIMEOUT": 504, "PROVIDER_UNAVAILABLE": 503, "PROVIDER_AUTH": 502, "PROVIDER_ERROR": 502}


@dataclass(frozen=True)
class Ingested:
    """What an ingestion made: the corpus, one report row for each document, and the sum of all."""

    corpus: Corpus
    report: DataFrame
    summary: DataFrame


def ingest(report_pages: DataFrame, state: DataFrame | None = None, version: int = 1) -> Ingested:
    """Take in paged reports, document by document: a document with an unsafe page or chunk fails alone.

    With ``state`` (``document_id, source_checksum, fingerprint, version,
    n_chunks`` of an earlier run) documents that are as they were are skipped.
    The report tells ``document_id, status, reason, n_pages, n_chunks,
    n_requests, fingerprint``.
    """
    given = staged(report_pages, "given")
    bad_pages = chunking.unsafe_pages(given).groupBy("document_id").agg(F.min("reason").alias("reason"))
    chunks = staged(chunking.chunk_pages(given.join(bad_pages, "document_id", "left_anti")), "all-chunks")
    bad_chunks = chunking.unsafe_chunks(chunks).groupBy("document_id").agg(F.min(F.get("reasons", F.lit(0))).alias("reason"))
    failed = staged(bad_pages.unionByName(bad_chunks), "failed")
    prints = index.fingerprints(chunks.drop("document_title"))
    sums = given.groupBy("document_id").agg(F.count("*").alias("n_pages"), F.min("source_checksum").alias("source_checksum"))
    now = sums.join(prints, "document_id", "left").withColumn("version", F.lit(version)).fillna({"n_chunks": 0})
    same = index.unchanged(state, now).filter("skip").select("document_id", F.lit(True).alias("skip")) if state is not None else now.select("document_id", F.lit(None).cast("boolean").alias("skip")).limit(0)
    told = now.join(failed, "document_id", "left").join(same, "document_id", "left")
    status = F.when(F.col("reason").isNotNull(), "failed").when(F.col("skip"), "skipped").when(F.col("n_chunks") == 0, "empty").otherwise("indexed")
    told = told.withColumn("status", status)
    report = staged(told.select("document_id", "status", "reason", "n_pages", "n_chunks", F.when(F.col("status") == "indexed", F.ceil(F.col("n_chunks") / REQUEST_CHUNKS)).otherwise(0).alias("n_requests"), "fingerprint", "source_checksum", "version"), "report")
    live = report.filter("status = 'indexed'").select("document_id")
    summary = report.agg(F.count("*").alias("n_documents"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("indexed", "skipped", "failed", "empty")], F.sum("n_pages").alias("n_pages"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_requests").alias("n_requests"), (F.count_if(F.col("status") == "failed") > 0).alias("review_required"))
    made = built(given.join(live, "document_id", "left_semi"))
    release(given, chunks, failed)
    return Ingested(made, report, summary)


def search(corpus: Corpus, queries: DataFrame, vectors: DataFrame, top_k: int = 10, **scope: object) -> tuple[DataFrame, DataFrame]:
    """Evidence for queries, table chunks with their table's title in the path; and a status for each query."""
    rows, status, _ = retrieval.search(queries, corpus.chunks, vectors, top_k, **scope)
    found = collect.with_titles(rows, collect.titles(corpus.chunks))
    return found, status.withColumn("http_status", F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("status")])


def answer(corpus: Corpus, specs: DataFrame, withdrawn: DataFrame | None = None, default_year: int = facts.DEFAULT_YEAR) -> DataFrame:
    """``spec_id, kind, status, reason, answer, n_claims``: an answer for each request, from printed tables alone.

    ``specs``: ``spec_id, kind, document_id, region, metric, year, years,
    residence, population, entity_kind``.  A ranking needs a document, other
    kinds a region; a year change names two years.
    """
    gone = withdrawn.select("document_id") if withdrawn is not None else None
    live = corpus.facts if gone is None else corpus.facts.join(gone, "document_id", "left_anti")
    ranking = specs.filter("kind = 'ranking'")
    chosen = staged(facts.select_columns(ranking.select("spec_id", "document_id", "metric", "year", "residence", "population", "entity_kind"), facts.column_health(corpus.columns, corpus.rows, corpus.facts), default_year), "chosen")
    picked = facts.still_cited(facts.selected_facts(chosen, corpus.facts), corpus.chunks)
    stale = picked.groupBy("spec_id").agg(F.bool_or("stale").alias("stale"))
    told = facts.ranking_sentence(facts.ranked(picked))
    ranked = chosen.join(stale, "spec_id", "left").join(told, "spec_id", "left")
    out_of_reach = ranked.join(gone.withColumn("gone", F.lit(True)), "document_id", "left") if gone is not None else ranked.withColumn("gone", F.lit(None).cast("boolean"))
    why = F.when(F.col("gone"), "DOCUMENT_WITHDRAWN").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("stale"), "TABLE_STORE_STALE").when(F.col("sentence").isNull(), "RANKING_NO_INDIVIDUAL_ROWS")
    rankings = out_of_reach.withColumn("why", why).select("spec_id", F.lit("ranking").alias("kind"), F.col("why").alias("reason"), F.when(F.col("why").isNull(), F.col("sentence")).alias("answer"), F.when(F.col("why").isNull(), F.size("winners")).otherwise(0).cast("long").alias("n_claims"))

    scoped = specs.filter("kind <> 'ranking'")
    last = live.agg(F.max("year").alias("last"))
    asked = scoped.select("spec_id", "kind", "region", "metric", "residence", F.when(F.size(F.coalesce("years", F.array().cast("array<int>"))) > 0, F.col("years")).otherwise(F.array(F.coalesce("year", F.lit(default_year)))).alias("years"))
    beyond = asked.crossJoin(F.broadcast(last)).select("spec_id", (F.size(F.filter("years", lambda y: y > F.col("last"))) > 0).alias("beyond"))
    cells = staged(facts.year_cells(asked.select("spec_id", "region", "metric", "years", "residence"), live), "cells")
    lines = calculations.cell_sentences(cells.filter("reason is null").withColumn("population_group", F.lit(None).cast("string")))
    sides = cells.groupBy("spec_id").agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNull()).alias("n_good"), F.min("reason").alias("reason"), F.max(F.when(F.col("turn") == 1, F.struct("value", "year"))).alias("a"), F.max(F.when(F.col("turn") == 2, F.struct("value", "year"))).alias("b"), F.first("region").alias("region"), F.first("metric", ignorenulls=True).alias("metric"))
    change = facts.difference(F.col("a.value"), F.col("b.value"))
    more = F.concat(F.col("region"), F.lit("'s "), F.lower("metric"), F.lit(" was "), F.when(change >= 0, "higher").otherwise("lower"), F.lit(" in "), F.col("a.year").cast("string"), F.lit(" than in "), F.col("b.year").cast("string"), F.lit(" by "), F.abs(change).cast("double").cast("string"), F.lit("."))
    drafts = calculations.numbered_drafts(lines)
    met = asked.select("spec_id", "kind").join(sides, "spec_id", "left").join(drafts, "spec_id", "left").join(beyond, "spec_id", "left")
    is_change = F.col("kind") == "year_change"
    refused = F.when(F.col("beyond"), "YEAR_BEYOND_CORPUS").when(F.col("reason").isNotNull(), F.col("reason")).when(is_change & (F.coalesce("n", F.lit(0)) != 2), "CHANGE_NEEDS_TWO_YEARS")
    text = F.when(is_change, F.concat_ws("\n\n", "answer", more)).otherwise(F.col("answer"))
    cell_answers = met.withColumn("why", refused).select("spec_id", "kind", F.col("why").alias("reason"), F.when(F.col("why").isNull(), text).alias("answer"), F.when(F.col("why").isNull(), F.col("n_claims") + is_change.cast("int")).otherwise(0).cast("long").alias("n_claims"))
    both = rankings.unionByName(cell_answers)
    return both.select("spec_id", "kind", F.when(F.col("reason").isNull(), "answered").otherwise("refused").alias("status"), "reason", "answer", "n_claims")


def documents(corpus: Corpus) -> DataFrame:
    """Every document with its title, region, pages and the years of its tables."""
    years = corpus.facts.filter("year is not null").groupBy("document_id").agg(F.array_sort(F.collect_set("year")).alias("years"))
    one = corpus.pages.groupBy("document_id").agg(F.min("title").alias("title"), F.min("region").alias("region"), F.count("*").alias("n_pages"))
    return one.join(years, "document_id", "left")


def coverage(corpus: Corpus) -> DataFrame:
    """The coverage report of every document."""
    return pages.coverage_report(corpus.pages)


def corpus_of(spark: SparkSession, folder: str) -> Corpus:
    from factloom.plans.corpus import corpus

    return corpus(spark, folder)
