"""Steps whose cost must follow the input, and results that must not change with its size."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.functions.frames import changed
from factloom.operators import pages, quoted_tables, spans
from factloom.sources import stores


def _plan(df) -> str:  # noqa: ANN001
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_paired_by_one_key(spark):
    files = lambda name: spark.range(50).select(F.concat(F.lit("File "), F.col("id").cast("string"), F.lit(name)).alias("path"))
    told = spark.createDataFrame([("File 3.pdf", "File 4.md")], "pdf_filename string, markdown_filename string")
    out = pages.discovered(files(".pdf"), files(".md"), told)
    assert "NestedLoop" not in _plan(out) and "Cartesian" not in _plan(out)
    got = {(r.pdf, r.markdown): r.reason for r in out.collect()}
    assert (got["File 3.pdf", "File 4.md"], got["File 4.pdf", "File 4.md"]) == ("MARKDOWN_PAIRED_TWICE", "MARKDOWN_PAIRED_TWICE")
    assert got["File 5.pdf", "File 5.md"] is None and got[None, "File 3.md"] == "ORPHAN_MARKDOWN" and len(got) == 51


def test_traces_do_not_take_a_folder_a_session(spark, tmp_path):
    at = str(tmp_path / "traces")
    rows = spark.range(300).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("session_id"), F.col("id").cast("string").alias("run_id"), F.lit("t").alias("trace"))
    stores.write_traces(rows, at)
    stores.write_traces(rows.filter("run_id = '7'"), at)
    assert len(list(Path(at).glob("*=*"))) <= stores.SHELVES
    got = {r.run_id: r.trace for r in stores.read_traces(spark, at, spark.createDataFrame([("5",), ("7",), ("x",)], "run_id string")).collect()}
    assert got == {"5": "t", "7": None, "x": None}


def test_blocks_and_pages_are_shuffled_once(spark):
    blocks = spark.createDataFrame([("d", 0, "a b c d"), ("d", 1, "..."), ("e", 0, "x")], "document_id string, block_no long, text string")
    on = spark.createDataFrame([("d", 0, "a b c d"), ("d", 1, "a z"), ("e", 4, "")], "document_id string, page_number long, text string")
    out = pages.alignment(blocks, on)
    assert _plan(out).count("Exchange hashpartitioning") == 1
    assert {(r.document_id, r.block_no): (r.page_number, r.score) for r in out.collect()} == {("d", 0): (0, 1.0), ("d", 1): (None, 0.0), ("e", 0): (4, 0.0)}


def test_cells_are_not_sent_to_all_and_bring_no_context(spark):
    evidence = spark.createDataFrame([("c", "| Code | District | Orders |\n| --- | --- | --- |\n|  |  | 1997 total |\n| 1 | 2 | 3 |\n| 07 | Place | 5 |", "Statements", "Place")], "chunk_id string, text string, section string, region string")
    kinds = "row_id string, chunk_id string, label string, value int, year int, population string, residence string, series string, unit string, asked_metric string, asked_year int, asked_population string, asked_residence string, asked_regions array<string>, names_region boolean, needs_group boolean"
    row = lambda key, value, asked: (key, "c", "Place", value, 1997, None, "total", None, None, asked, 1997, None, "total", [], False, False)
    out = quoted_tables.matched_cells(spark.createDataFrame([row("right", 5, "orders"), row("value", 6, "orders"), row("metric", 5, "literacy")], kinds), evidence)
    assert "Broadcast" not in _plan(out).split("Initial Plan")[-1]
    assert {r.row_id: (r.emptied, r.raw) for r in out.collect()} == {"right": (None, "5"), "value": ("value", None), "metric": ("metric", None)}


def test_copies_with_a_change_are_one_pass(spark):
    base = spark.range(3).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"), F.lit("a").alias("w"))
    out = changed(base, "k", {"none": {}, "more": {"v": F.col("v") + 1}, "gone": {"w": F.lit(None).cast("string")}})
    assert out.columns == ["k", "v", "w"] and _plan(out).count("Range (") == 1
    assert {tuple(r) for r in out.filter("k like '%:1'").collect()} == {("none:1", 1, "a"), ("more:1", 2, "a"), ("gone:1", 1, None)}


def test_stored_documents_do_not_take_a_folder_each(spark, tmp_path):
    at = str(tmp_path / "store")
    rows = spark.range(400).select(F.concat(F.lit("d"), (F.col("id") % 200).cast("string")).alias("document_id"), F.col("id").alias("v"))
    stores.write_store(rows, at)
    stores.write_store(rows.filter("document_id = 'd1'"), at, version=2)
    stores.write_store(rows.filter("v = 2"), at)
    assert len(list(Path(at).glob("*"))) == 3
    asked = spark.createDataFrame([("d0",), ("d1",), ("d2",), ("nobody",)], "document_id string")
    got, told = stores.read_store(spark, at, asked)
    assert sorted((r.document_id, r.v) for r in got.collect()) == [("d0", 0), ("d0", 200), ("d2", 2)]
    assert {r.document_id: r.reason for r in told.collect()} == {"d1": "TABLE_STORE_VERSION", "nobody": "TABLE_STORE_MISSING"}


def _events(seed: int) -> tuple[list, dict]:
    """Events of runs, one without an id, that close calls in any order, not at all or unopened; what levels tell of each call."""
    rng, rows, expected = random.Random(seed), [], {}
    for run in (None, "a", "b", "c"):
        n, opened, before, shut = 0, {}, [], {}
        for seq in range(rng.choice((1, 40, 90))):
            if rng.random() < 0.55:
                call, n = f"{run}-{seq}", n + 1
                expected[call] = (run, n, opened.get(n - 1) if n > 1 else None)
                opened[n] = call
                before.append(call)
                rows.append((run, seq, call, "x", "open", seq))
            else:
                call, n = rng.choice(before[-4:] or ["none"]), n - 1
                shut.setdefault(call, seq)
                rows.append((run, seq, call, "x", "close", seq))
        expected |= {c: (*expected[c], shut.get(c)) for c in before}
    rng.shuffle(rows)
    return rows, expected


@pytest.mark.parametrize("size", [1, 7, 1 << 18])
def test_events_are_dealt_once_and_cut_anywhere(spark, monkeypatch, size):
    """Calls of runs in one or many parts, in any order of closes; of all events there is one exchange, of edges a few rows."""
    monkeypatch.setattr(spans, "SPAN", size)
    plans, real = [], spans.staged
    monkeypatch.setattr(spans, "staged", lambda df, label: (plans.append(_plan(df)), real(df, label))[1])
    rows, expected = _events(size)
    out = spans.nested(spark.createDataFrame(rows, "run_id string, seq long, call_id string, name string, what string, ts long"))
    got = out.collect()
    assert {r.call_id: (r.run_id, r.depth, r.parent_id, r.closed_at) for r in got} == expected and len(got) == len(expected)
    assert all((r.trace_id is None) == (r.run_id is None) and r.name == "x" for r in got)
    assert [p.count("Exchange ") for p in plans] == [1, 0]
