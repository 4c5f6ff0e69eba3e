"""Hybrid retrieval: dense and BM25 legs under one filter, fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import SEARCH_STOP_WORDS, tokens
from factloom.operators import scoring
from factloom.plans.staging import staged

# BM25's constants, the longest token, and the fusion's constant with ranks from 0.
K1, B, AVERAGE, TOKEN_CHARS = 1.2, 0.75, 256.0, 40
FUSION = 2


def leg_size(top_k: int) -> int:
    return max(4 * top_k, 20)


def allowed(items: DataFrame, documents: list[str] | None = None, regions: list[str] | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Items of the asked documents and regions; without asked documents, none of the excluded ones."""
    if documents is not None:
        items = items.filter(F.col("document_id").isin(documents))
    if regions is not None:
        items = items.filter(F.col("region").isin(regions))
    return items if excluded is None else items.join(excluded.select("document_id"), "document_id", "left_anti")


def _best(scored: DataFrame, n: int, item: str) -> DataFrame:
    """The best ``n`` items of each query, numbered from 0; ties by item."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), item))
    return scored.withColumn("rank", rank - 1).filter(F.col("rank") < n)


def _ranked(parts: Iterator[DataFrame], queries: DataFrame, items: DataFrame, n: int, item: str) -> DataFrame:
    found = list(parts)
    none = queries.select("query_id").join(items.select(item), F.lit(False)).withColumn("score", F.lit(0.0))
    return _best(reduce(DataFrame.unionByName, found) if found else none, n, item)


def dense_leg(queries: DataFrame, items: DataFrame, n: int, item: str = "chunk_id") -> DataFrame:
    """``query_id, item, score, rank``: cosine similarity of each of a stated set of queries with all items, in blocks."""
    return _ranked(scoring.dense(queries, items, n, item), queries, items, n, item)


def terms(text: Column) -> Column:
    """The words that BM25 counts: letters and digits in lower case, none too long."""
    return F.filter(tokens(F.coalesce(text, F.lit(""))), lambda t: F.length(t) <= TOKEN_CHARS)


def bm25_leg(queries: DataFrame, items: DataFrame, n: int, item: str = "chunk_id") -> DataFrame:
    """``query_id, item, score, rank``: the sum over the query's distinct terms of IDF and saturated frequency."""
    asked = queries.select("query_id", F.array_distinct(terms(F.col("query"))).alias("terms"))
    return _ranked(scoring.bm25(asked, items.select(item, terms(F.col("text")).alias("terms")), n, item, K1, B, AVERAGE), queries, items, n, item)


def fuse(legs: list[DataFrame], top_k: int, item: str = "chunk_id", k: int = FUSION) -> DataFrame:
    """Reciprocal-rank fusion of ranked legs."""
    every = None
    for leg in legs:
        part = leg.select("query_id", item, (1 / (F.col("rank") + k)).alias("share"))
        every = part if every is None else every.unionByName(part)
    return _best(every.groupBy("query_id", item).agg(F.round(F.sum("share"), 6).alias("score")), top_k, item)


def label_leg(queries: DataFrame, items: DataFrame, n: int, item: str = "chunk_id") -> DataFrame:
    """``query_id, item, score, rank``: the first items, by id, of each query's label; items are cut to ``n`` a label before they meet queries."""
    # Two steps, so that no task ranks all items of a label.
    part = F.pmod(F.xxhash64(item), F.lit(256))
    first = lambda df, *by: df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(item))).filter(F.col("nth") <= n).drop("nth")
    top = first(first(items.select(item, "label", part.alias("part")), "label", "part"), "label")
    return _best(queries.select("query_id", "label").join(top.select(item, "label"), "label").select("query_id", item, F.lit(1.0).alias("score")), n, item)


def evidence(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """What was found, each chunk once for a query at its best rank, with its text and place; and why it can't be cited, if so."""
    once = found.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    met = once.join(chunks, "chunk_id", "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    reason = F.when(blank("text"), "EVIDENCE_WITHOUT_TEXT").when(blank("document_id"), "EVIDENCE_WITHOUT_DOCUMENT").when(F.coalesce(F.col("page_number") < 1, F.lit(True)), "EVIDENCE_WITHOUT_PAGE")
    return met.withColumn("reason", reason)


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, top_k: int = 10, documents: list[str] | None = None, regions: list[str] | None = None, withdrawn: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Hybrid search: evidence rows, a status for each query, and the legs with what was fused.

    ``queries``: ``query_id, query, vector``; ``chunks`` with ``chunk_id, text,
    document_id, region, page_number``; ``vectors``: ``chunk_id, vector``.  The
    same filter goes under both legs, which fetch more than is asked; a chunk
    without a vector can be found by its words.
    """
    if not 1 <= top_k <= 50:
        raise ValueError("top_k is from 1 to 50")
    some = allowed(chunks, documents, regions, withdrawn)
    asked = queries.filter(F.trim(F.coalesce("query", F.lit(""))) != "")
    size = leg_size(top_k)
    legs = {"dense": dense_leg(asked.filter("vector is not null"), vectors.join(some.select("chunk_id"), "chunk_id", "left_semi"), size), "bm25": bm25_leg(asked, some, size)}
    # Written once, as the evidence, its status and the legs themselves all rest on them.
    legs = {name: staged(leg, name) for name, leg in legs.items()}
    legs["fused"] = staged(fuse([legs["dense"], legs["bm25"]], top_k), "fused")
    rows = evidence(legs["fused"], some)
    enough = sufficiency(asked, rows).withColumnRenamed("status", "found")
    counts = rows.groupBy("query_id").agg(F.count("*").alias("n_found"))
    told = queries.select("query_id", F.trim(F.coalesce("query", F.lit(""))).alias("query")).join(enough, "query_id", "left").join(counts, "query_id", "left")
    status = told.select("query_id", F.when(F.col("query") == "", "blank_query").otherwise(F.coalesce("found", F.lit("insufficient_evidence"))).alias("status"), F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"))
    return rows, status, legs


def sufficiency(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Whether any telling word of a query stands, even as part of a word, in what was found for it."""
    terms = F.filter(F.array_distinct(tokens(F.col("query"))), lambda t: (F.length(t) > 2) & ~t.isin(*SEARCH_STOP_WORDS))
    asked = queries.select("query_id", terms.alias("terms"))
    hit = F.exists("terms", lambda t: F.contains(F.lower("text"), t))
    met = asked.join(evidence.select("query_id", "text"), "query_id", "left").groupBy("query_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit"))
    return met.select("query_id", F.when(F.col("hit"), "candidate_evidence").otherwise("insufficient_evidence").alias("status"))


def sibling_pages(found: DataFrame, chunks: DataFrame, pages: int = 3) -> DataFrame:
    """All chunks of the first pages of each document that a query found, in order of first appearance."""
    first = found.groupBy("query_id", "document_id", "page_number").agg(F.min("rank").alias("first"))
    kept = first.withColumn("turn", F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("first"))).filter(F.col("turn") <= pages)
    return kept.select("query_id", "document_id", "page_number").join(chunks, ["document_id", "page_number"])


def summary_evidence(chunks: DataFrame, sections: int = 24) -> DataFrame:
    """The first chunk of each section (its path's first two parts, or its page), the first sections of each document."""
    key = F.when(F.size("section_path") > 0, F.array_join(F.slice("section_path", 1, 2), " > ")).otherwise(F.concat(F.lit("page-"), F.col("page_number").cast("string")))
    order = ["page_number", "chunk_index"]
    one = chunks.withColumn("section", key).withColumn("nth", F.row_number().over(Window.partitionBy("document_id", "section").orderBy(*order))).filter("nth = 1")
    return one.withColumn("turn", F.row_number().over(Window.partitionBy("document_id").orderBy(*order))).filter(F.col("turn") <= sections)


def first_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources, the earliest source of each key."""
    every = None
    for k, source in enumerate(sources):
        part = source.withColumn("source_no", F.lit(k))
        every = part if every is None else every.unionByName(part)
    return every.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("source_no"))).filter("nth = 1").drop("nth")


def evaluate(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """Recall at 5 and 10 over all targets, and the mean reciprocal rank over cases; ranks from 0.

    ``ranked`` has ``case_id, target, rank``, ``targets`` has ``case_id, target``.
    """
    hits = targets.join(ranked.groupBy("case_id", "target").agg(F.min("rank").alias("rank")), ["case_id", "target"], "left")
    by_case = hits.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(F.col("rank") < 5).alias("at5"), F.count_if(F.col("rank") < 10).alias("at10"), F.min("rank").alias("first"))
    rate = lambda c: F.round(F.sum(c) / F.sum("n"), 6)
    return by_case.agg(F.count("*").alias("n_cases"), rate("at5").alias("recall_at_5"), rate("at10").alias("recall_at_10"), F.round(F.avg(F.coalesce(1 / (F.col("first") + 1), F.lit(0.0))), 6).alias("mrr"))


def filter_accuracy(cases: DataFrame, found: DataFrame) -> DataFrame:
    """One row: the share of filtered cases all of whose results keep the filter, and of all results that can be cited; 1 if there is none.

    ``cases``: ``case_id, regions`` (null: no filter); ``found``: ``case_id, region, text, citation_snippet``.
    """
    met = found.join(cases, "case_id")
    by_case = met.groupBy("case_id").agg(F.bool_and(F.col("regions").isNull() | F.array_contains("regions", F.col("region"))).alias("kept"), F.first(F.col("regions").isNotNull()).alias("filtered"), F.count("*").alias("n"), F.count_if(F.coalesce(F.contains("text", "citation_snippet"), F.lit(False))).alias("cited"))
    share = lambda part, whole: F.when(whole == 0, F.lit(1.0)).otherwise(F.round(part / whole, 6))
    return by_case.agg(share(F.count_if(F.col("kept") & F.col("filtered")), F.count_if("filtered")).alias("filter_accuracy"), share(F.coalesce(F.sum("cited"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).alias("citation_accuracy"))


def gate(metrics: DataFrame, recall5: float = 0.7, recall10: float = 0.9, mrr: float = 0.6) -> DataFrame:
    """Whether metrics hold the floors."""
    failed = F.array_compact(F.array(F.when(F.col("recall_at_5") < recall5, "recall_at_5"), F.when(F.col("recall_at_10") < recall10, "recall_at_10"), F.when(F.col("mrr") < mrr, "mrr")))
    return metrics.select("*", failed.alias("failed"), (F.size(failed) == 0).alias("passed"))


def covers(text: Column, quote: Column) -> Column:
    """Whether a text holds a quote, white space aside."""
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    return F.contains(flat(text), flat(quote))
