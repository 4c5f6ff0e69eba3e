"""Queries over stored tables and files: written, read back, checked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import service
from factloom.operators import index as I
from factloom.operators import pages as P
from factloom.plans.corpus import corpus
from factloom.plans.q_facts import CELLS, REPORTS
from factloom.plans.registry import query, table
from factloom.plans.staging import shared_folder
from factloom.sources import reports, stores


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/staged/{name}-{uuid.uuid4().hex}"


STORED = CELLS + ", d AS (SELECT DISTINCT slug, r_name, 'orders-' || slug AS document_id FROM cells)"


@query(
    STORED
    + """
    , c AS (SELECT 'orders-' || slug AS document_id, count(*) AS n FROM cells GROUP BY 1)
    SELECT document_id, CASE WHEN r_name LIKE 'ASIA %' THEN 'TABLE_STORE_VERSION' END AS reason, CASE WHEN r_name LIKE 'ASIA %' THEN 0 WHEN r_name LIKE 'AFRICA %' THEN 1 ELSE n END AS n FROM d JOIN c USING (document_id) UNION ALL SELECT 'nobody', 'TABLE_STORE_MISSING', 0
    """
)
def table_store(spark: SparkSession, folder: str) -> DataFrame:
    """Facts stored by document: some documents replaced as a whole, some by another version; what can be read."""
    facts = corpus(spark, folder).facts.select("document_id", "region", "entity", "column_index", "value")
    at = _folder(spark, "store")
    stores.write_store(facts, at)
    stores.write_store(facts.filter("region like 'ASIA %'"), at, version=2)
    stores.write_store(facts.filter("region like 'AFRICA %'").groupBy("document_id").agg(F.min("region").alias("region"), F.min("entity").alias("entity"), F.min("column_index").alias("column_index"), F.min("value").alias("value")), at)
    asked = facts.select("document_id").distinct().unionByName(spark.range(1).select(F.lit("nobody").alias("document_id")))
    rows, told = stores.read_store(spark, at, asked)
    counts = rows.groupBy("document_id").agg(F.count("*").alias("n"))
    return asked.join(told, "document_id", "left").join(counts, "document_id", "left").select("document_id", "reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT 'page-' || page_id || '.md' AS path, length(coalesce(html, '')) AS n_chars FROM pages")
def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as files, one each, and read back whole."""
    at = _folder(spark, "markdown")
    p = table(spark, folder, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".md")).alias("name"), F.coalesce("html", F.lit("")).alias("text"))
    if local := stores.local_path(spark, at):
        return stores.read_files(spark, local, stores.write_files(p, local)).select("path", F.length("text").cast("long").alias("n_chars"))
    # A store that only Spark writes to.
    p.write.partitionBy("name").text(at)
    # Spark names files itself: the folder tells which page a file is.
    read = spark.read.text(at, wholetext=True, recursiveFileLookup=True)
    named = read.select(F.regexp_extract(F.col("_metadata.file_path"), "name=([^/]+)/", 1).alias("path"), F.regexp_replace("value", "\n$", "").alias("text"))
    return named.select("path", F.length("text").cast("long").alias("n_chars"))


@query("SELECT p_name || '.pdf' AS pdf_filename, CASE WHEN count(*) > 1 THEN 'DUPLICATE_OVERRIDE' END AS reason FROM part WHERE p_partkey % 9 = 0 GROUP BY 1")
def document_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Overrides from JSON files; a file name that two of them have is refused."""
    at = _folder(spark, "overrides")
    p = table(spark, folder, "part").filter("p_partkey % 9 = 0")
    p.select(F.concat("p_name", F.lit(".pdf")).alias("pdf_filename"), F.concat("p_name", F.lit(".md")).alias("markdown_filename"), F.col("p_brand").alias("title"), F.col("p_type").alias("region")).write.json(at)
    single = spark.read.schema("pdf_filename string, markdown_filename string, document_id string, title string, region string").json(at)
    twice = single.groupBy("pdf_filename").agg(F.count("*").alias("n")).filter("n > 1").select("pdf_filename", F.lit("DUPLICATE_OVERRIDE").alias("reason"))
    return single.join(twice, "pdf_filename", "left_anti").select("pdf_filename", F.lit(None).cast("string").alias("reason")).unionByName(twice)


@query("SELECT l_linenumber AS page, count(*) AS n_words, round(avg(l_quantity), 2) AS confidence FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity >= 5 GROUP BY 1")
def scan_review(spark: SparkSession, folder: str) -> DataFrame:
    """Words of scans, read from tab-separated rows: how many a page has and how sure they are."""
    at = _folder(spark, "words")
    l = table(spark, folder, "lineitem")  # noqa: E741
    sure = F.when(F.col("l_quantity") < 5, -1.0).otherwise(F.col("l_quantity"))
    l.select(F.col("l_linenumber").alias("page"), sure.cast("string").alias("conf"), F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(F.concat(F.lit('w"'), F.col("l_partkey").cast("string"))).alias("text")).write.option("sep", "\t").option("header", True).option("quote", "").csv(at)
    return stores.scan_review(stores.read_scan_words(spark, at))


@query("SELECT o_orderkey::VARCHAR AS case_id, 1 AS repeat, o_orderstatus AS response, CASE WHEN o_orderstatus = 'P' THEN 'PROVIDER_TIMEOUT' END AS error_code FROM orders")
def recorded_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a benchmark run as JSON lines, read back."""
    at = _folder(spark, "responses")
    o = table(spark, folder, "orders")
    o.select(F.col("o_orderkey").cast("string").alias("case_id"), F.lit(1).alias("repeat"), F.col("o_orderstatus").alias("response"), F.when(F.col("o_orderstatus") == "P", "PROVIDER_TIMEOUT").alias("error_code")).write.json(at)
    return stores.read_responses(spark, at)


@query("SELECT 'model' AS field, 'old' AS found, 'new' AS wanted UNION ALL SELECT 'size', '64', '768'")
def index_schema(spark: SparkSession, folder: str) -> DataFrame:
    """An index of vectors written with what it must fit, and where another use does not."""
    at = _folder(spark, "index")
    points = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("document_id"), "embedding")
    stores.write_index(points, at, 64, "old")
    return stores.schema_errors(spark, at, 768, "new")


def _first_bytes(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@query("WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS (SELECT DISTINCT text FROM d WHERE sha256(text) NOT IN (SELECT sha256(text) FROM d WHERE doc_id % 2 = 0)) SELECT count(*) AS n, sum(length(text))::BIGINT AS n_chars, sum(length(text) - length(replace(text, ' ', '')))::BIGINT AS n_spaces FROM m")
def embedded_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Only texts that the cache lacks go to the embedder, each content once, in batches."""
    items = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    empty = spark.createDataFrame([], "cache_key string")
    cache = I.embedding_misses(items.filter("chunk_id % 2 = 0"), empty, "model", 2).select("cache_key").distinct()
    made = stores.embed(I.embedding_misses(items, cache, "model", 2), _first_bytes)
    return made.agg(F.count("*").alias("n"), F.sum(F.get("vector", F.lit(0))).cast("long").alias("n_chars"), F.sum(F.get("vector", F.lit(1))).cast("long").alias("n_spaces"))


@query(STORED + "SELECT document_id, CASE WHEN r_name LIKE 'ASIA %' THEN 'CHECKSUM_MISMATCH' WHEN r_name LIKE 'EUROPE %' THEN 'NOT_INDEXED' END AS reason FROM d")
def rebuild_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Tables are rebuilt from an index only where it has the source's own version."""
    c = corpus(spark, folder)
    sources = c.pages.select("document_id", "region", "source_checksum").distinct()
    changed = sources.withColumn("source_checksum", F.when(F.col("region").startswith("ASIA "), F.sha2("source_checksum", 256)).otherwise(F.col("source_checksum")))
    return stores.rebuild(c.chunks.filter("region not like 'EUROPE %'"), changed)


@query(
    REPORTS
    + """
    SELECT 'orders-' || replace(lower(r_name), ' ', '-') AS document_id, CASE WHEN r_name LIKE 'ASIA %' THEN 'failed' WHEN r_name LIKE 'AFRICA %' THEN 'skipped' ELSE 'indexed' END AS status, CASE WHEN r_name LIKE 'ASIA %' THEN 'UNVERIFIED_OCR' END AS reason, 4::BIGINT AS n_pages FROM reports
    """
)
def ingestion_report(spark: SparkSession, folder: str) -> DataFrame:
    """Reports taken in: one with a page of unverified OCR fails alone, one that is as it was is skipped."""
    pages = reports.state_reports(spark, folder)
    first = service.ingest(pages.filter("region like 'AFRICA %'"))
    state = first.report.select("document_id", "source_checksum", "fingerprint", "version", "n_chunks")
    method = F.when(F.col("region").startswith("ASIA ") & (F.col("page_number") == 2), "unverified_ocr").otherwise(F.col("extraction_method"))
    return service.ingest(pages.withColumn("extraction_method", method), state).report.select("document_id", "status", "reason", "n_pages")


@query(REPORTS + ", s AS (SELECT count(*) AS n, count(*) FILTER (WHERE r_name LIKE 'ASIA %') AS bad FROM reports) SELECT n AS n_documents, n - bad AS n_indexed, bad AS n_failed, 4 * n AS n_pages, bad > 0 AS review_required FROM s")
def ingestion_summary(spark: SparkSession, folder: str) -> DataFrame:
    pages = reports.state_reports(spark, folder)
    method = F.when(F.col("region").startswith("ASIA ") & (F.col("page_number") == 2), "unverified_ocr").otherwise(F.col("extraction_method"))
    return service.ingest(pages.withColumn("extraction_method", method)).summary.select("n_documents", "n_indexed", "n_failed", "n_pages", "review_required")


@query(
    """
    WITH l AS (SELECT l_orderkey AS d, l_linenumber AS p, max(l_returnflag) AS f, min(l_returnflag) AS g FROM lineitem GROUP BY ALL),
    x AS (SELECT o_orderkey AS document_id, r.p, CASE WHEN g = 'R' THEN 'approved_manual_transcription' WHEN f = 'A' THEN 'excluded_unverified_visual' ELSE 'failed_page_mapping' END AS status FROM orders, (SELECT unnest(range(1, 8)) AS p) r LEFT JOIN l ON l.d = o_orderkey AND l.p = r.p)
    SELECT document_id, count(*) FILTER (WHERE status = 'failed_page_mapping') AS n_failed, 'Visual content on page(s) ' || string_agg(p::VARCHAR, ', ' ORDER BY p) FILTER (WHERE status = 'excluded_unverified_visual') || ' has not been verified and is not searched.' AS limitation FROM x GROUP BY 1
    """
)
def failed_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose mapping failed as a whole: every page has a status all the same, and readers are told of unchecked visuals."""
    docs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("document_id"), F.md5(F.col("o_orderkey").cast("string")).alias("source_checksum"), F.lit(7).alias("page_count"))
    l = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number")).agg(F.max("l_returnflag").alias("f"), F.min("l_returnflag").alias("g")).withColumn("source_checksum", F.md5(F.col("document_id").cast("string")))  # noqa: E741
    key = ["document_id", "page_number", "source_checksum"]
    pages = P.failed_pages(docs, l.filter("f = 'A'").select(*key, F.lit("excluded_unverified_visual").alias("coverage_status")), l.filter("g = 'R'").select(*key, F.lit("typed").alias("text")))
    counts = pages.groupBy("document_id").agg(F.count_if(F.col("coverage_status") == "failed_page_mapping").alias("n_failed"))
    return counts.join(P.limitations(pages).select("document_id", "limitation"), "document_id", "left")
