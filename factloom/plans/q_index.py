"""Queries of the stored indexes: vectors in lists, postings in blocks, each against a scan of everything."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.stem import stems, stems_sql
from factloom.operators import postings, vectors
from factloom.operators import retrieval as R
from factloom.plans.q_retrieval import DENSE_SQL, TOP, _asked, _vectors
from factloom.plans.registry import query, table
from factloom.plans.staging import shared_folder

#: Lists that an exact search opens first.
PROBES = 8


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/index/{name}-{uuid.uuid4().hex}"


def _vector_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, vectors.VectorIndex]:
    """All vectors in an index that was built from those of even labels and grew by the others."""
    asked, items = _vectors(spark, folder)
    index = vectors.fit(items, _fresh(spark, "vectors"))
    for odd in (0, 1):
        vectors.add(index, items.filter(F.coalesce(F.col("label"), F.lit(0)) % 2 == odd).select("chunk_id", "vector"))
    return asked, items, index


@query(DENSE_SQL + "SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM d WHERE rank < 5")
def vector_index_search(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest vectors by an index: the lists nearest to a query, then those whose bound reaches its worst find."""
    asked, _, index = _vector_index(spark, folder)
    best = R._best(vectors.search(index, asked, TOP, PROBES, exact=True), TOP, "chunk_id")
    return best.select("query_id", "chunk_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT count(*) AS n_queries, count(*) * 10 AS n_best, TRUE AS recall_holds FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Of the ten nearest of each query by a scan of all vectors, at least nine in ten are in the lists that it opens; how many these are is set on other vectors."""
    asked, items, index = _vector_index(spark, folder)
    best = R.dense_leg(asked, items, 10).select("query_id", "chunk_id")
    probes = vectors.calibrated(index, items.select(F.col("chunk_id").alias("query_id"), "vector"), 10)
    near = R._best(vectors.search(index, asked, 10, probes), 10, "chunk_id").select("query_id", "chunk_id", F.lit(1).alias("hit"))
    met = best.join(near, ["query_id", "chunk_id"], "left")
    return met.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_best"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_holds"))


@query("SELECT count(*) AS n_vectors, count(DISTINCT vec_id) AS n_ids, count(*) AS n_in_lists, TRUE AS within_radius FROM embeddings")
def vector_index_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector is in one list, and lists know how many they hold."""
    _, items, index = _vector_index(spark, folder)
    held = index.segments("vectors").agg(F.count("*").alias("n_vectors"), F.countDistinct("chunk_id").alias("n_ids"))
    lists = index.segments("lists").agg(F.sum("n").alias("n_in_lists"), (F.max("radius") <= 3.1416).alias("within_radius"))
    return held.crossJoin(lists)


WORDS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: length(t) <= 40)"
STEMMED_SQL = rf"""
    WITH words AS (SELECT DISTINCT unnest({WORDS}) AS term FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)),
    {stems_sql('words')},
    tw AS MATERIALIZED (SELECT doc_id, {WORDS} AS ws FROM documents WHERE TRUE),
    ts AS MATERIALIZED (SELECT doc_id AS chunk_id, len(ws) AS length, unnest(ws) AS term FROM tw),
    p AS MATERIALIZED (SELECT chunk_id, length, stem AS term, count(*) AS tf FROM ts JOIN stems USING (term) GROUP BY ALL),
    asked AS MATERIALIZED (SELECT DISTINCT query_id, stem AS term FROM (SELECT item_id AS query_id, unnest({WORDS}) AS term FROM benchmark) JOIN stems USING (term)),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    s AS (SELECT query_id, chunk_id, round(sum(ln(1 + ((SELECT count(*) FROM documents WHERE TRUE) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 256.0))), 6) AS score
          FROM p JOIN df USING (term) JOIN asked USING (term) GROUP BY ALL),
    bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM s QUALIFY rank < 5)
    SELECT query_id, chunk_id, round(score, 3) AS score, rank FROM bm
"""


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")


def _found(index: postings.TermIndex, spark: SparkSession, folder: str) -> DataFrame:
    found = postings.search(index, _asked(spark, folder), TOP)
    return found.select("query_id", "chunk_id", F.round("score", 3).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(STEMMED_SQL)
def term_index_search(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 over stems by an inverted index that grew in two steps, with upper bounds."""
    chunks, index = _chunks(spark, folder), postings.TermIndex(spark, _fresh(spark, "terms"))
    for late in (False, True):
        postings.add(index, chunks.filter(F.coalesce(F.col("source") == "src4", F.lit(False)) == late))
    return _found(index, spark, folder)


@query(STEMMED_SQL.replace("WHERE TRUE", "WHERE source IS DISTINCT FROM 'src4'"))
def term_index_without(spark: SparkSession, folder: str) -> DataFrame:
    """The same after a source was withdrawn, whose counts no longer weigh, and another written anew."""
    chunks, index = _chunks(spark, folder), postings.TermIndex(spark, _fresh(spark, "terms"))
    postings.add(index, chunks)
    postings.remove(index, chunks.filter("source = 'src4'"))
    postings.upsert(index, chunks.filter("source = 'src2'"))
    return _found(index, spark, folder)


@query(STEMMED_SQL.replace("WHERE TRUE", "WHERE source IS DISTINCT FROM 'src4'"))
def term_index_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """The same from an index written anew without what was withdrawn."""
    chunks, index = _chunks(spark, folder), postings.TermIndex(spark, _fresh(spark, "terms"))
    postings.add(index, chunks)
    postings.remove(index, chunks.filter("source = 'src4'"))
    return _found(postings.compact(index, _fresh(spark, "terms")), spark, folder)


@query(
    rf"WITH words AS (SELECT DISTINCT unnest({WORDS}) AS term FROM documents), {stems_sql('words')} SELECT stem, count(*) AS n_words, min(term) AS first_word FROM stems GROUP BY stem"
)
def word_stems(spark: SparkSession, folder: str) -> DataFrame:
    """The words of all documents by their stems."""
    words = _chunks(spark, folder).select(F.explode(R.terms(F.col("text"))).alias("term")).distinct()
    return stems(words).groupBy("stem").agg(F.count("*").alias("n_words"), F.min("term").alias("first_word"))
