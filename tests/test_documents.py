"""Chunking, tables and pages on small hand-written documents."""

from __future__ import annotations

import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import chunking, pages, tables
from factloom.sources.reports import PAGES

SUM = "0" * 64


def report(spark, *texts, region="Odisha"):
    rows = [("d", region, "Report", k, t, "provided_markdown", "indexed_markdown", SUM) for k, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, PAGES)


TABLE = """| Code | District | Literacy Rate |  |  | Sex Ratio (number of females per 1000 males) |
| --- | --- | --- | --- | --- | --- |
|  |  | 2001 | 2011 |  | 2011 |
|  |  | Total | Total | Rural |  |
| 1 | 2 | 3 | 4 | 5 | 6 |
| 00 | Odisha | 63.1 | 72.9 | 70.2 | 979 |
| 01 | Khordha | 79.6 | 86.9 | 80.0 | 929 |
| 02 | Puri | 78.0 | 84.7 | 83.0 | 4,06,47,322 |"""


def facts_of(spark, *texts):
    p = report(spark, *texts)
    return tables.facts(tables.statement_tables(p), chunking.chunk_pages(p))


def test_columns_get_metric_year_residence_and_unit(spark):
    f = facts_of(spark, f"Statement 4 : Literacy by district (Persons)\n\n{TABLE}")
    got = {(r.column_index, r.metric, r.year, r.residence, r.unit) for r in f.collect()}
    assert got == {(2, "Literacy Rate", 2001, "total", "percent"), (3, "Literacy Rate", 2011, "total", "percent"), (4, "Literacy Rate", 2011, "rural", "percent"), (5, "Sex Ratio", 2011, None, "females per 1000 males")}
    rows = {(r.entity, r.column_index): r for r in f.collect()}
    assert rows["Odisha", 2].aggregate and not rows["Puri", 2].aggregate
    assert int(rows["Puri", 5].value) == 40647322
    assert rows["Puri", 5].population_group == "persons" and rows["Puri", 5].chunk_id


def test_table_goes_on_over_pages_and_repeated_lines_are_unbound(spark):
    head = f"Statement 4 : Literacy\n\n{TABLE}"
    assert {r.table_id for r in facts_of(spark, head, TABLE).select("table_id").distinct().collect()} == {"t001-p1"}
    again = facts_of(spark, head + "\n\n# Other\n\n" + TABLE)
    assert again.filter("chunk_id is not null").count() == 0


def test_malformed_rows_and_tables_without_numbers(spark):
    p = report(spark, TABLE + "\n| 03 | Cuttack | 1 |", "| District | A |\n| --- | --- |\n| x | 1 |")
    t = tables.statement_tables(p)
    assert t.count() == 1
    assert tables.table_rows(t, chunking.chunk_pages(p)).filter("malformed").count() == 1


def test_chunks_keep_their_page_path_and_ids(spark):
    p = report(spark, "# One\n\n### Deep\n\nText here.", "More of it.\n\n## Two\n\n" + TABLE)
    got = chunking.chunk_pages(p).orderBy("chunk_index").collect()
    assert [(c.page_number, c.section_path) for c in got] == [(1, ["One", "Deep"]), (2, ["One", "Deep"]), (2, ["One", "Two"])]
    first = got[0]
    assert first.text == "One > Deep\n\nText here."
    assert first.chunk_id == str(uuid.uuid5(uuid.UUID(T.CHUNK_NAMESPACE), f"d:1:0:{first.text}"))
    assert all(c.citation_snippet in c.text for c in got)


def test_long_tables_repeat_their_header(spark):
    rows = "\n".join(f"| {k:02d} | Place {k} | 1 | 2 | 3 | 4 |" for k in range(120))
    parts = chunking.chunk_pages(report(spark, TABLE.rsplit("\n", 3)[0] + "\n" + rows)).collect()
    assert len(parts) > 2
    assert all(c.text.startswith("| Code | District") and len(c.text) <= chunking.MAX_CHARS for c in parts)
    assert sum(c.text.count("Place") for c in parts) == 120


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .\n", max_size=400), min_size=1, max_size=3))
def test_prose_is_never_lost(spark, texts):
    got = chunking.chunk_pages(report(spark, *texts), size=120, overlap=20, limit=40).collect()
    assert all(c.citation_snippet in c.text for c in got)
    assert len({c.chunk_id for c in got}) == len(got)
    for k, text in enumerate(texts, 1):
        words = set(text.split())
        said = " ".join(c.text for c in got if c.page_number == k)
        assert all(any(w[i : i + 20] in said for i in range(0, len(w), 20)) for w in words)


def test_unsafe_pages_are_told(spark):
    rows = [("d", "r", "t", 1, "x", "unverified_ocr", "indexed_markdown", SUM), ("d", "r", "t", 2, "x", "provided_markdown", "excluded_blank", SUM), ("d", "r", "t", 3, "", "none", "excluded_blank", SUM)]
    got = {r.page_number: r.reason for r in chunking.unsafe_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "UNVERIFIED_OCR", 2: "TEXT_ON_EXCLUDED_PAGE"}


def test_page_markers(spark):
    text = "intro\n<!-- page: 2 -->\nb\n[Page 1]\na\n<!-- page: 2 -->\nc"
    got = {r.page_number: (r.text, r.n_markers) for r in pages.marked_pages(spark.createDataFrame([("d", text), ("none", "no markers")], "document_id string, text string")).collect()}
    assert got == {0: ("intro", 0), 1: ("a", 1), 2: ("b\nc", 2)}


def test_converter_note(spark):
    rows = [("a", "Pages converted: 2/3 Skipped: [2]", 3, ["x", "y"]), ("b", "Pages converted: 3/3", 4, ["x"]), ("c", "Pages converted: 1/2 Skipped: [9]", 2, ["x"]), ("d", "Pages converted: 2/2", 2, ["x"])]
    got = pages.converter_pages(spark.createDataFrame(rows, "document_id string, text string, page_count int, blocks array<string>")).collect()
    assert {(r.document_id, r.reason, r.page_number, r.text) for r in got} == {("a", None, 1, "x"), ("a", None, 3, "y"), ("b", "PAGE_COUNT", None, None), ("c", "SKIPPED_PAGE", None, None), ("d", "BLOCK_COUNT", None, None)}


def test_discovery(spark):
    pdfs = spark.createDataFrame([("a/One Two.pdf",), ("b/one-two.pdf",), ("x.pdf",), ("y.pdf",)], "path string")
    texts = spark.createDataFrame([("X.md",), ("z.md",), ("w.md",)], "path string")
    told = spark.createDataFrame([("y.pdf", "w.md"), ("gone.pdf", "q.md")], "pdf_filename string, markdown_filename string")
    got = {(r.pdf, r.markdown, r.reason) for r in pages.discovered(pdfs, texts, told).collect()}
    assert got == {("a/One Two.pdf", None, "AMBIGUOUS_STEM"), ("b/one-two.pdf", None, "AMBIGUOUS_STEM"), ("x.pdf", "X.md", None), ("y.pdf", "w.md", None), (None, "z.md", "ORPHAN_MARKDOWN"), ("gone.pdf", "q.md", "OVERRIDE_MISSING_PDF")}


def test_scalars(spark):
    row = spark.range(1).select(
        T.metric_words(F.lit("Effective literacy rates of persons (per cent per year) 2001-11 in 2011")).alias("words"),
        T.compatible_rounding(F.lit("86.9"), F.lit("86.94")).alias("near"), T.compatible_rounding(F.lit("86.9"), F.lit("87.01")).alias("far"),
        T.single_year(F.lit("2001-11")).alias("none"), T.single_year(F.lit("in 2011")).alias("one"), T.periods(F.lit("2001-11")).alias("periods"),
        T.default_title(F.lit("word " * 20)).alias("title"), T.numbers(F.lit("4,06,47,322 and -3.5")).alias("numbers"), T.uuid5(T.URL_NAMESPACE, F.lit("x")).alias("id"),
    ).first()
    assert (row.words, row.near, row.far, row.none, row.one, row.periods) == (["literacy", "rate"], True, False, None, 2011, ["2001-2011"])
    assert row.title == "word " * 11 + "word…" and row.numbers == [40647322.0, -3.5] and row.id == str(uuid.uuid5(uuid.NAMESPACE_URL, "x"))
