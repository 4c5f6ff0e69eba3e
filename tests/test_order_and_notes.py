"""What the audit reads, notes below tables, and files compared in order, on small inputs."""

from __future__ import annotations

import pytest

from factloom.operators import audit
from factloom.operators import tables as T
from factloom.operators.chunking import chunk_pages
from factloom.sources import artifacts

QUOTES = "claim_id int, quote_id int, value double, region string, snippet string, context string"


def places(spark, rows):
    return {(r["claim_id"], r["kind"], r["header"]) for r in audit.locations(spark.createDataFrame([(k, 1, *r) for k, r in enumerate(rows)], QUOTES)).collect()}


def test_numbers_in_prose_have_borders(spark):
    rows = [(12.0, "Asia", "In Asia FY12 was calm", ""), (5.0, "Asia", "In Asia the 5th row", ""), (5.0, "Asia", "In Asia 5 rows", ""), (-5.0, "Asia", "In Asia it was -5.", ""), (1234.0, "Asia", "In Asia: 1,234;", "")]
    assert places(spark, rows) == {(2, "prose", ""), (3, "prose", ""), (4, "prose", "")}


def test_figures_are_compared_as_decimals(spark):
    table = "| Place | v |\n| --- | --- |\n| Asia | 2.35 |\n| Asia | 2.351 |"
    assert places(spark, [(2.3, "Asia", table, ""), (2.4, "Asia", table, ""), (2.349, "Asia", table, "")]) == {(0, "table", "v"), (1, "table", "v")}
    assert len(places(spark, [(1e10, "Asia", "| Asia | 10,000,000,000 |", "")])) == 1


def test_a_rule_has_three_dashes_and_is_no_header(spark):
    table = "| Place | v |\n| - | - |\n| --- | :---: |\n| Asia | 7 |"
    assert places(spark, [(7.0, "Asia", table, "")]) == {(0, "table", "v -")}
    # Without a rule all rows are data; a row of single dashes is one too.
    assert places(spark, [(7.0, "Asia", "| - | - |\n| Asia | 7 |", "")]) == {(0, "table", "")}


def test_the_reader_knows_its_own_groups(spark):
    from pyspark.sql import functions as F

    rows = [("women", None), ("Females", "GROUP"), ("females per 1000 males", None), ("children", None), ("child", "GROUP"), ("ages 0 - 6", "GROUP")]
    df = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(rows)], "k int, h string")
    got = {r["k"]: r["c"] for r in df.select("k", audit.conflicts(F.col("h"), F.lit(""), F.lit(None).cast("int"), F.lit("total"), F.lit(None).cast("string")).alias("c")).collect()}
    assert got == {k: ["GROUP"] if g else [] for k, (_, g) in enumerate(rows)}


HEAD = "| Code | District | Count |\n| --- | --- | --- |\n| | | 2011 |\n| 1 | 2 | 3 |"


def test_notes_belong_to_the_table_before_them(spark):
    texts = [
        "Note: before any table\n\n### Statement 1\n\nCounts by district\n\n" + HEAD + "\n| 01 | Asia | 5* |\n| 02 | Europe | 6 |",
        "* starred only\n\n*Estimated.*\n\n**Bold words**\n\nplain words",
        "N. B. a) later\n\n### Statement 2\n\n*A title in italics*\n\nNotes: no table yet\n\n" + HEAD + "\n| 01 | Asia | 7a) |",
        "Note : a) for one cell\n\nNote: " + "long " * 80 + "\n\nFigure 3\n\nNote: of the figure",
    ]
    schema = "document_id string, region string, title string, page_number int, text string, extraction_method string, coverage_status string, source_checksum string"
    pages = spark.createDataFrame([("d", "R", "T", k, t, "provided_markdown", "indexed_markdown", "c") for k, t in enumerate(texts, 1)], schema)
    tables = T.statement_tables(pages)
    notes = T.footnotes(pages, tables)
    got = sorted((r["table_id"], r["note_no"], r["mark"], r["note"]) for r in notes.collect())
    assert got == [("t001-p1", 1, None, "Estimated."), ("t001-p1", 2, "a)", "N. B. a) later"), ("t002-p3", 1, "a)", "Note : a) for one cell")]
    cells = sorted((r["table_id"], r["row_no"], r["column_index"], r["note_no"]) for r in T.cell_notes(tables, notes).collect())
    assert cells == [("t001-p1", 0, 2, 1), ("t001-p1", 1, 2, 1), ("t002-p3", 0, 2, 1)]
    assert chunk_pages(pages).count() > 0


@pytest.fixture
def written(spark, tmp_path):
    def write(rows, names, name, parts=1):
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {', '.join(n + ' string' for n in names)}")
        path = f"file://{tmp_path}/{name}"
        df.repartitionByRange(parts, "k").sortWithinPartitions("k").drop("k").write.option("header", True).option("escape", '"').csv(f"{path}/data")
        return path

    return write


ROWS = [(f"r{k}", f"a \"quoted\"\nvalue, {k}", str(k / 4)) for k in range(40)]


def told(spark, rows, path):
    meant = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row_no long, name string, words string, share string")
    return sorted((r["code"], r["row_no"], r["column"], r["written"], r["read"]) for r in artifacts.order_differences(meant, spark, path).collect())


def test_rows_of_several_files_keep_their_order(spark, written):
    path = written(ROWS, ("name", "words", "share"), "same", 5)
    assert told(spark, ROWS, path) == []
    rows = artifacts.numbered_rows(spark, path).collect()
    assert {r["row_no"]: r["name"] for r in rows} == {k: f"r{k}" for k in range(40)}


def test_swapped_rows_and_columns_are_told(spark, written):
    swapped = [*ROWS[:10], ROWS[11], ROWS[10], *ROWS[12:]]
    assert told(spark, ROWS, written(swapped, ("name", "words", "share"), "rows", 4)) == [("ROW_MOVED", 10, None, "10", "11"), ("ROW_MOVED", 11, None, "11", "10")]
    turned = [(a, c, b) for a, b, c in ROWS]
    assert told(spark, ROWS, written(turned, ("name", "share", "words"), "columns", 3)) == [("COLUMN_ORDER", None, None, "name,words,share", "name,share,words")]
    assert told(spark, ROWS, written(turned, ("name", "words", "other"), "names"))[0][0] == "COLUMNS_DIFFER"


def test_cells_and_counts_are_told(spark, written):
    changed = [*ROWS[:5], ("r5", ROWS[5][1], "9"), *ROWS[6:-1]]
    assert told(spark, ROWS, written(changed, ("name", "words", "share"), "cells", 4)) == [("CELL_DIFFERS", 5, "share", "1.25", "9"), ("ROW_COUNT", None, None, "40", "39")]
    # Forms of one number are one.
    same = [(a, b, f"{float(c):.3f}") for a, b, c in ROWS]
    assert told(spark, ROWS, written(same, ("name", "words", "share"), "numbers", 2)) == []
