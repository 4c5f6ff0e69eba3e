"""Joins and files that must hold on tables of six gigabytes: what is shuffled, sent to all or made a file each."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from factloom.functions.frames import changed, met_as_dealt, spread
from factloom.operators import calculations, chunking, citations, facts, quoted_tables, tables
from factloom.plans.queries import QUERIES
from factloom.plans.staging import shared_folder, staged
from factloom.sources import reports, stores
from tests.conftest import SMALL


def _plan(df) -> str:  # noqa: ANN001
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


PROPOSALS = "row_id string, chunk_id string, label string, value int, year int, population string, residence string, series string, unit string, asked_metric string, asked_year int, asked_population string, asked_residence string, asked_regions array<string>, names_region boolean, needs_group boolean"


def test_copies_of_proposals_are_not_shuffled(spark):
    """Rows are dealt by page before they are copied; copies meet other chunks of their page there."""
    text = "| Code | District | Orders |\n| --- | --- | --- |\n|  |  | 1997 total |\n| 1 | 2 | 3 |\n| 07 | Place | {0} |\n| 08 | Other | {0} |"
    pages = spread(spark.createDataFrame([(f"p{k}", text.format(k), "Place") for k in range(9)], "page string, text string, region string"), "page")
    evidence = pages.select("page", F.inline(F.array(*[F.struct(F.concat("page", F.lit(mark)).alias("chunk_id"), F.concat_ws("\n\n", *["text"] * n).alias("text"), F.lit("S").alias("section")) for mark, n in (("", 1), ("|twice", 2))])), "region")
    rows = spark.createDataFrame([(f"p{k}", f"p{k}", f"p{k}", "Place", k, 1997, None, "total", None, None, "orders", 1997, None, "total", [], False, False) for k in range(9)], f"page string, {PROPOSALS}")
    changes = {"none": {}, "value": {"value": F.col("value") + 100}, "twice": {"chunk_id": F.concat("chunk_id", F.lit("|twice"))}, "gone": {"chunk_id": F.lit("x")}, "unit": {"unit": F.lit("hectares")}, "late": {"year": F.lit(2011), "asked_year": F.lit(2011)}}
    proposals = changed(spread(rows, "page"), "row_id", changes)
    with met_as_dealt(spark):
        out = quoted_tables.matched_cells(proposals, evidence, "page")
        plan, got = _plan(out), {r.row_id: (r.reason, r.emptied, tuple(r.n_axes), r.raw) for r in out.collect()}
    assert "Broadcast" not in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange ") == plan.count("REPARTITION_BY_NUM")
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    plain = quoted_tables.matched_cells(proposals.drop("page"), evidence.drop("page"))
    assert got == {r.row_id: (r.reason, r.emptied, tuple(r.n_axes), r.raw) for r in plain.collect()} and len(got) == 54
    other = "UNSUPPORTED_OR_WRONG_TABLE_CELL"
    assert got["none:p3"] == (None, None, (2, 1, 1, 1, 1, 1, 1, 1), "3")
    assert [got[f"{k}:p3"][:2] for k in ("value", "twice", "gone", "unit", "late")] == [(other, "value"), ("AMBIGUOUS_TABLE_CELL", None), ("UNKNOWN_EVIDENCE_ID", None), (other, "unit"), (other, "year")]


TABLE = "Statement 4 : Orders by district\n\n| Code | District | Orders | |\n| --- | --- | --- | --- |\n|  |  | 1997 | 1998 |\n| 1 | 2 | 3 | 4 |\n| 17 | Place | 5 | 6 |\n| 18 | Other | 7 | 8 |"


def _written(spark) -> tuple:  # noqa: ANN001
    """Pages, chunks and facts as stored tables, whose few bytes would have them sent to all."""
    pages = spark.createDataFrame([(f"d{k}", "Place", "T", 1, TABLE, "provided_markdown", "indexed_markdown", f"{k:064x}") for k in range(3)], reports.PAGES)
    pages = staged(pages, "pages")
    chunks = staged(chunking.chunk_pages(pages), "chunks")
    printed = staged(tables.statement_tables(pages), "tables")
    columns, rows = staged(tables.table_columns(printed), "columns"), staged(tables.table_rows(printed, chunks), "rows")
    made = tables.facts_of(columns, rows)
    assert "Broadcast" not in _plan(made)
    return pages, chunks, staged(made, "facts")


def test_what_grows_is_not_sent_to_all_for_facts(spark):
    """Columns and chunks in few bytes of storage are joined where they lie; of orders only regions, nations and years go out."""
    _, chunks, f = _written(spark)
    out = facts.still_cited(f, chunks.withColumn("page_number", F.when(F.col("document_id") == "d1", 9).otherwise(F.col("page_number"))))
    assert "Broadcast" not in _plan(out)
    assert {(r.document_id, r.stale, r["n"]) for r in out.groupBy("document_id", "stale").agg(F.count("*").alias("n")).collect()} == {("d0", False, 4), ("d1", True, 4), ("d2", False, 4)}
    plan = _plan(reports.measures(spark, SMALL))
    assert "SortMergeJoin [o_custkey" in plan


def test_pages_are_files_without_a_folder_each(spark, tmp_path):
    """A file for each page, in folders of tasks; texts come back as they were."""
    before = set(Path(stores.local_path(spark, shared_folder(spark)), "staged").glob("markdown-*"))
    n = QUERIES["markdown_files"](spark, SMALL).count()
    (at,) = set(Path(stores.local_path(spark, shared_folder(spark)), "staged").glob("markdown-*")) - before
    assert len([f for f in at.rglob("*.md") if f.is_file()]) == n == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    assert len([f for f in at.rglob("*") if f.is_dir()]) <= 8
    texts = {"a.md": "x\n\n", "b.md": "", "c.md": "é\r\n𝄞" * 40, "d.md": "\n"}
    rows = spark.createDataFrame(list(texts.items()), "name string, text string").repartition(3)
    shelves = stores.write_files(rows, f"{tmp_path}/files")
    assert {r.path: r.text for r in stores.read_files(spark, f"{tmp_path}/files", shelves).collect()} == texts
    assert stores.read_files(spark, f"{tmp_path}/files", []).count() == 0


def test_cells_are_not_sent_to_all_for_verdicts(spark):
    pages, _, f = _written(spark)
    claims = staged(citations.claims_of_facts(f, pages), "claims")
    out = calculations.year_verdicts(claims.withColumn("region", F.col("entity")), f)
    assert "Broadcast" not in _plan(out)
    assert {r.verdict: r["n"] for r in out.groupBy("verdict").agg(F.count("*").alias("n")).collect()} == {"confirmed": 12}


def test_cells_and_chunks_are_not_sent_to_all_for_citations(spark):
    pages, chunks, f = _written(spark)
    claims = staged(citations.claims_of_facts(f, pages), "claims")
    out = citations.validate(changed(claims, "claim_id", {"none": {}, "value": {"value": F.col("value") + 100}}), chunks, f)
    assert "Broadcast" not in _plan(out)
    got = {(r.mutation, r.code): r["n"] for r in out.groupBy(F.substring_index("claim_id", ":", 1).alias("mutation"), "code").agg(F.count("*").alias("n")).collect()}
    assert got == {("none", None): 12, ("value", "CLAIM_QUOTE_NOT_FOUND"): 12}


def test_quotes_are_not_sent_to_all_for_claims(spark):
    pages, _, f = _written(spark)
    quote_id = F.concat_ws("/", "document_id", F.lit("1"))
    none = F.lit(None).cast("string")
    claims = staged(f.select(F.concat_ws("/", "document_id", "entity", F.col("year").cast("string")).alias("claim_id"), quote_id.alias("quote_id"), F.lit("It was so.").alias("claim_text"), F.col("value").cast("double").alias("value"), "year", none.alias("population"), none.alias("residence"), none.alias("claim_region")), "claims")
    out = quoted_tables.read_claims(changed(claims, "claim_id", {"none": {}, "year": {"year": F.lit(2005)}}), pages.select(quote_id.alias("quote_id"), F.col("text").alias("quote")))
    assert "Broadcast" not in _plan(out)
    assert {(r.mutation, r.agrees): r["n"] for r in out.groupBy(F.substring_index("claim_id", ":", 1).alias("mutation"), "agrees").agg(F.count("*").alias("n")).collect()} == {("none", True): 12, ("year", False): 12}
