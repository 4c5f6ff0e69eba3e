"""Further queries: staleness, withdrawal, arithmetic, artifacts, retries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import events as E
from factloom.operators import facts as X
from factloom.operators import retrieval as R
from factloom.plans.corpus import corpus
from factloom.plans.q_facts import CELLS, RANKED, REPORTS, _ranks
from factloom.plans.registry import query, table
from factloom.plans.staging import shared_folder
from factloom.sources import artifacts


@query(CELLS + "SELECT 'orders-' || slug AS document_id, statement, CASE WHEN statement = 2 THEN count(*) ELSE 0 END AS n_stale, count(*) AS n FROM cells WHERE r_name NOT LIKE 'ASIA %' GROUP BY slug, statement")
def stale_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts against an index where one statement's page moved, and one document was withdrawn."""
    c = corpus(spark, folder)
    moved = c.chunks.withColumn("page_number", F.when(F.col("page_number") == 3, 33).otherwise(F.col("page_number")))
    withdrawn = c.pages.filter("region like 'ASIA %'").select("document_id").distinct()
    out = X.still_cited(c.facts, moved, withdrawn)
    return out.groupBy("document_id", F.col("statement").cast("int").alias("statement")).agg(F.count_if("stale").alias("n_stale"), F.count("*").alias("n"))


@query(REPORTS + "SELECT 'orders-' || replace(lower(r_name), ' ', '-') AS document_id, 4::BIGINT AS n_pages FROM reports WHERE r_name NOT LIKE 'ASIA %'")
def withdrawn_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What a search without asked documents may see."""
    c = corpus(spark, folder)
    return R.allowed(c.chunks, excluded=c.pages.filter("region like 'ASIA %'").select("document_id").distinct()).groupBy("document_id").agg(F.countDistinct("page_number").alias("n_pages"))


@query(
    """
    WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN 'sum' WHEN 1 THEN 'difference' WHEN 2 THEN 'percentage_difference' ELSE 'power' END AS operation, l_quantity AS a, CASE WHEN l_discount < 0.05 THEN 0.0 ELSE l_extendedprice END AS b FROM lineitem)
    SELECT operation, coalesce(CASE WHEN operation = 'power' THEN 'UNKNOWN_OPERATION' WHEN operation = 'percentage_difference' AND b = 0 THEN 'ZERO_BASELINE' END, '') AS reason, count(*) AS n,
        round(sum(CASE operation WHEN 'sum' THEN a + b WHEN 'difference' THEN a - b WHEN 'percentage_difference' THEN CASE WHEN b <> 0 THEN round((a - b) / b * 100, 6) END END), 2) AS total FROM c GROUP BY 1, 2
    """
)
def calculation_results(spark: SparkSession, folder: str) -> DataFrame:
    """Arithmetic over lines, with what is refused."""
    k = F.col("l_linenumber") % 4
    pairs = table(spark, folder, "lineitem").select(F.when(k == 0, "sum").when(k == 1, "difference").when(k == 2, "percentage_difference").otherwise("power").alias("operation"), F.col("l_quantity").alias("left"), F.when(F.col("l_discount") < 0.05, 0.0).otherwise(F.col("l_extendedprice")).alias("right"))
    out = X.calculations(pairs)
    return out.groupBy("operation", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum("result"), 2).alias("total"))


@query(RANKED + "SELECT count(*) AS n_rows, 0::BIGINT AS n_differing, count(*) AS n_sources FROM k")
def artifact_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Rankings written as CSV with a manifest, read back and held against what was meant."""
    ranks = _ranks(spark, folder)
    rows = ranks.select(F.concat_ws("/", "spec_id", "entity").alias("row_id"), "spec_id", "entity", "value", "unit", "rank")
    sources = ranks.select(F.concat_ws("/", "spec_id", "entity").alias("row_id"), "chunk_id", "page_number", "line", "raw_value")
    path = f"{shared_folder(spark)}/artifacts/{uuid.uuid4().hex}"
    artifacts.write_dataset(rows, sources, path)
    read = artifacts.read_rows(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))
    differing = artifacts.differing(rows, read, "row_id").agg(F.count("*").alias("n_differing"))
    manifest = artifacts.read_manifest(spark, path, "row_id string, chunk_id string, line string")
    return read.agg(F.count("*").alias("n_rows")).crossJoin(differing).crossJoin(manifest.filter("chunk_id is not null").agg(F.count("*").alias("n_sources")))


@query(RANKED + "SELECT spec_id, count(*) + 2 AS n_lines, bool_or(contains(entity, 'NATION')) AS named FROM k GROUP BY 1")
def markdown_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Each ranking as a Markdown table."""
    told = artifacts.markdown(_ranks(spark, folder), "spec_id", "rank", ["rank", "entity", "raw_value", "unit"])
    return told.select("spec_id", F.size(F.split("table", "\n")).cast("long").alias("n_lines"), F.contains("table", F.lit("NATION")).alias("named"))


@query("SELECT event_id, CAST(least(300, 15 * 2 ^ (CAST(json_extract(props, '$.k') AS BIGINT) % 8)) AS BIGINT) AS delay FROM events")
def retry_schedule(spark: SparkSession, folder: str) -> DataFrame:
    attempt = F.get_json_object("props", "$.k").cast("int") % 8
    return table(spark, folder, "events").select("event_id", E.retry_delay(attempt).cast("long").alias("delay"))


@query("SELECT CASE event_type WHEN 'error' THEN 'PROVIDER_RATE_LIMITED' WHEN 'view' THEN 'PROVIDER_TIMEOUT' WHEN 'click' THEN 'PROVIDER_AUTH' WHEN 'signup' THEN 'PROVIDER_UNAVAILABLE' ELSE 'PROVIDER_ERROR' END AS code, count(*) AS n FROM events GROUP BY 1")
def provider_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Failures by class of their message."""
    kind = F.col("event_type")
    message = F.when(kind == "error", "Quota exceeded").when(kind == "view", "deadline passed").when(kind == "click", "bad API key").when(kind == "signup", "model overloaded").otherwise("odd")
    return table(spark, folder, "events").groupBy(E.provider_error(message).alias("code")).agg(F.count("*").alias("n"))
