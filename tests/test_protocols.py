"""Withdrawals that break off, checks of outputs, nested calls, gates and names, on small inputs."""

from __future__ import annotations

import random
import struct
import sys
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from factloom import service
from factloom.functions import names
from factloom.operators import gates, pages, postings, quotes, spans, withdrawal
from factloom.sources import outputs, stores

# --- withdrawal -------------------------------------------------------------

TEXTS = {k: f"alpha beta w{k} " + "gamma " * (k % 3) for k in range(30)}


def library(spark, path) -> withdrawal.Library:
    rows = [(f"d{k % 6}", k, t) for k, t in TEXTS.items()]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id int, text string")
    docs = chunks.select("document_id").distinct()
    out = withdrawal.Library(spark, f"file://{path}", postings.TermIndex(spark, f"file://{path}/index"))
    return withdrawal.created(out, manifests=docs, tables=docs.crossJoin(spark.range(2)), chunks=chunks, pages=chunks.select("document_id", "text"))


def held(lib) -> dict:
    tables = {n: sorted(map(tuple, lib.read(n).collect())) for n in ("manifests", "tables", "chunks", "pages")}
    return tables | {"points": sorted(r["chunk_id"] for r in postings.live(lib.index).collect()), "out": sorted(r[0] for r in lib.withdrawn().collect())}


def hits(spark, lib) -> set:
    queries = spark.createDataFrame([(1, "alpha gamma")], "query_id int, query string")
    return {r["chunk_id"] for r in withdrawal.search(lib, queries, 30).collect()}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    lib = library(spark, tmp_path_factory.mktemp("whole"))
    withdrawal.withdraw(lib, spark.createDataFrame([("d1",), ("d4",)], "document_id string"))
    return held(lib)


@pytest.mark.parametrize("step", withdrawal.STEPS)
@pytest.mark.parametrize("noted", [False, True])
def test_a_withdrawal_that_breaks_off_ends_the_same(spark, tmp_path, monkeypatch, whole, step, noted):
    """Cut short in the middle of a step, or after it but before it was noted, a rerun gives the same end."""
    lib = library(spark, tmp_path)
    ids = spark.createDataFrame([("d1",), ("d4",)], "document_id string")
    real = dict(withdrawal._ACTIONS)

    def dies(lib, documents):
        if noted:
            real[step](lib, documents)
        raise RuntimeError("killed")

    monkeypatch.setitem(withdrawal._ACTIONS, step, dies)
    with pytest.raises(RuntimeError):
        withdrawal.withdraw(lib, ids)
    gone = {k for k in TEXTS if k % 6 in (1, 4)}
    assert not hits(spark, lib) & gone and hits(spark, lib)
    # The pages stay until the points are gone.
    if step in ("derived", "points"):
        assert lib.read("pages").count() == 30
    monkeypatch.setitem(withdrawal._ACTIONS, step, real[step])
    withdrawal.finish(lib)
    assert held(lib) == whole
    withdrawal.finish(lib)
    assert held(lib) == whole
    assert hits(spark, lib) == set(TEXTS) - gone


def test_compaction_keeps_what_is_found(spark, tmp_path):
    lib = library(spark, tmp_path)
    withdrawal.withdraw(lib, spark.createDataFrame([("d2",)], "document_id string"))
    fresh = withdrawal.compacted(lib, f"file://{tmp_path}/compact")
    assert hits(spark, fresh) == hits(spark, lib) and fresh.index.read("removed") is None


# --- outputs ----------------------------------------------------------------


def png(wide: int, high: int) -> bytes:
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0" * 10)) + part(b"IEND", b"")


def test_each_rule_of_outputs_is_told(spark, tmp_path):
    table = 'place,"the, value"\n"a\n""b""",1\nc,2\n'
    sound = {"rows.csv": table.encode(), "manifest.json": b'{"sources": [{"a": 1}]}', "chart.png": png(20, 30), "table.md": "| é |".encode()}
    changes = {
        "sound": {}, "missing": {"table.md": None}, "extra": {"more.md": b"x"}, "hidden": {".hidden.md": b"x"}, "ending": {"run.sh": b"x"}, "count": {f"n{k}.md": b"x" for k in range(6)}, "bytes": {"table.md": b"x" * (outputs.MOST_BYTES - 10)},
        "signature": {"chart.png": b"GIF89a" + b"x" * 40}, "small": {"chart.png": png(9, 30)}, "huge": {"chart.png": png(6000, 6000)}, "short": {"chart.png": png(20, 30)[:20]}, "latin": {"table.md": b"\xe9\xff"},
        "schema": {"rows.csv": b"value,place\n1,2\n"}, "rows": {"rows.csv": b'place,"the, value"\n' + b"a,1\n" * 10_001}, "enough": {"rows.csv": b'place,"the, value"\r\n' + b'"a\n\n",1\r\n' * 10_000}, "manifest": {"manifest.json": b'{"sources": 3}'}, "broken": {"manifest.json": b'{"sources": ['},
    }
    wanted = []
    for name, change in changes.items():
        (tmp_path / name).mkdir()
        for file, content in (sound | change).items():
            if content is not None:
                (tmp_path / name / file).write_bytes(content)
        extra = {"hidden": [".hidden.md"], "ending": ["run.sh"]}.get(name, [])
        wanted += [(name, f, ["place", "the, value"] if f == "rows.csv" else None) for f in [*sound, *extra]]
    got = {r["artifact_id"]: (r["code"], r["names"]) for r in outputs.checked(spark, f"file://{tmp_path}", spark.createDataFrame(wanted, "artifact_id string, name string, columns array<string>")).collect()}
    assert got == {
        "sound": (None, []), "missing": ("MISSING", ["table.md"]), "extra": ("UNEXPECTED", ["more.md"]), "hidden": ("MISSING", [".hidden.md"]), "ending": ("EXTENSION", ["run.sh"]), "count": ("FILE_COUNT", []), "bytes": ("TOTAL_BYTES", []),
        "signature": ("PNG_SIGNATURE", ["chart.png"]), "small": ("PNG_DIMENSIONS", ["chart.png"]), "huge": ("PNG_UNSAFE", ["chart.png"]), "short": ("PNG_UNSAFE", ["chart.png"]), "latin": ("NOT_UTF8", ["table.md"]),
        "schema": ("CSV_SCHEMA", ["rows.csv"]), "rows": ("CSV_ROWS", ["rows.csv"]), "enough": (None, []), "manifest": ("MANIFEST_SCHEMA", ["manifest.json"]), "broken": ("MANIFEST_SCHEMA", ["manifest.json"]),
    }


# --- spans ------------------------------------------------------------------


@pytest.mark.parametrize("span", [4096, 3])
def test_nested_calls_equal_a_stack(spark, monkeypatch, span):
    monkeypatch.setattr(spans, "SPAN", span)
    rng = random.Random(span)
    events, expected = [], {}
    for run in range(6):
        stack, calls = [], 0
        for seq in range(60):
            if stack and rng.random() < 0.5:
                events.append((f"run{run}", seq, stack.pop(), "x", "close", seq))
            else:
                call = f"{run}-{calls}"
                expected[call] = (len(stack) + 1, stack[-1] if stack else None)
                calls += 1
                stack.append(call)
                events.append((f"run{run}", seq, call, "x", "open", seq))
        for call in stack:
            expected[call] += ("open",)
    df = spark.createDataFrame(events, "run_id string, seq long, call_id string, name string, what string, ts long")
    got = {r["call_id"]: (r["depth"], r["parent_id"]) + (("open",) if r["closed_at"] is None else ()) for r in spans.nested(df).collect()}
    assert got == expected
    assert spans.nested(df).select("trace_id").distinct().count() == 6


# --- gates ------------------------------------------------------------------


@pytest.mark.parametrize(("metrics", "rows", "failed"), [
    ((0.9, 0.95, 0.7), [(False, True), (False, None)], []), ((0.9, 0.95, 0.7), [(True, True)], ["unsafe_evidence"]), ((0.9, 0.95, 0.7), [(False, False), (None, True)], ["citation_accuracy"]),
    ((0.6, 0.95, 0.7), [], ["recall_at_5"]), ((0.9, 0.8, 0.7), [], ["recall_at_10"]), ((0.9, 0.95, 0.5), [], ["mrr"]), ((0.1, 0.1, 0.1), [(True, False)], ["unsafe_evidence", "citation_accuracy", "recall_at_5", "recall_at_10", "mrr"]),
])
def test_every_gate_can_fail(spark, metrics, rows, failed):
    found = spark.createDataFrame(rows, "unsafe boolean, right boolean")
    flow, seen = gates.watched(found, F.col("unsafe"), F.col("right"), f"e{abs(hash((metrics, str(rows))))}")
    assert flow.count() == len(rows)  # one pass over the results, which counts them as well
    row = gates.verdict(spark.createDataFrame([metrics], "recall_at_5 double, recall_at_10 double, mrr double"), seen.get).first()
    assert (row["failed"], row["passed"]) == (failed, not failed)


def test_smoke_assertions(spark):
    answers = spark.createDataFrame([("a", "It rose from 72.9 to 75.356.", False), ("b", "It was 72.9.", False), ("c", "No.", True), ("d", "Yes.", False), ("f", "It was 1.", False)], "answer_id string, answer string, refusal boolean")
    expected = spark.createDataFrame([("a", False, [72.9, 75.36], ["x", "y"]), ("b", False, [72.9, 2.46], ["x", "y"]), ("c", True, [], []), ("d", True, [], []), ("e", False, [], []), ("f", False, [1.0], ["x"])], "answer_id string, refuse boolean, values array<double>, documents array<string>")
    cited = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "1", "x"), ("d", "1", "x"), ("f", "1", "x")], "answer_id string, citation_id string, document_id string")
    traced = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("d", "1"), ("f", "9")], "answer_id string, citation_id string")
    got = {r["answer_id"]: r["failures"] for r in gates.smoke(answers, expected, cited, traced).collect()}
    assert got == {"a": [], "b": ["VALUE_OMITTED", "DOCUMENT_NOT_CITED"], "c": [], "d": ["NOT_REFUSED", "CITED_IN_REFUSAL"], "e": ["NOT_ANSWERED"], "f": ["CITATIONS_NOT_OF_TRACE"]}


def test_what_an_embedder_gives_is_checked(spark):
    items = spark.createDataFrame([(1, "a"), (2, " "), (3, "c"), (4, "d"), (5, "e"), (6, None)], "chunk_id int, text string")
    dense = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (4, []), (5, [1.0]), (5, [2.0])], "chunk_id int, vector array<double>")
    assert {r[0]: r[1] for r in gates.vector_errors(items, dense).collect()} == {2: "BLANK_INPUT", 3: "COUNT_MISMATCH", 4: "EMPTY_VECTOR", 5: "COUNT_MISMATCH", 6: "BLANK_INPUT"}
    sparse = spark.createDataFrame([(1, [1], [1.0]), (3, [1, 2], [1.0]), (4, [], []), (5, None, None)], "chunk_id int, indices array<int>, weights array<double>")
    assert {r[0]: r[1] for r in gates.vector_errors(items, sparse).collect()} == {2: "BLANK_INPUT", 3: "LENGTH_MISMATCH", 4: "EMPTY_VECTOR", 5: "EMPTY_VECTOR", 6: "BLANK_INPUT"}


def test_targets_and_expectations(spark):
    items = spark.createDataFrame([("Asia", "d1"), ("europe", "D2"), ("Africa", "d3")], "region string, document_id string")
    targets = spark.createDataFrame([(0, "d2"), (1, "ASIA"), (2, "Europe")], "position int, target string")
    assert {(r["document_id"], r["target"]) for r in gates.targets_of(items, targets).collect()} == {("d1", "ASIA"), ("D2", "d2"), ("d3", None)}
    cases = spark.createDataFrame([("c", True, ["f"], [1.5], "chart")], "case_id string, expect_refusal boolean, expected_facts array<string>, expected_derived array<double>, expected_artifact string")
    row = gates.expectations(cases).first()
    assert (row["item_id"], row["expected"].asDict()) == ("trust-c", {"refuse": True, "facts": ["f"], "computed": [1.5], "artifact": "chart"})


# --- names and the rest -----------------------------------------------------


def test_compatibility_form_of_all_assigned_points(spark):
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    texts = ["e" + chr(c) + "́a" for c in points if c >= 0x80][::7] + [chr(c) for c in points]
    df = spark.createDataFrame([(t,) for t in texts if "\0" not in t], "t string").repartition(4)
    assert all(r["k"] == unicodedata.normalize("NFKC", r["t"]) for r in df.select("t", names.nfkc("t").alias("k")).collect())
    rows = spark.createDataFrame([("Ｆｕｌｌ　Ｗｉｄｔｈ ①",), ("ﬁle_Straße (2)",), ("--",), (None,)], "t string").select(names.file_key(F.col("t")).alias("k"))
    assert [r["k"] for r in rows.collect()] == ["full-width-1", "file-strasse-2", "", None]
    files = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    told = pages.discovered(files("ﬁle １.pdf"), files("File 1.md"), spark.createDataFrame([], "pdf_filename string, markdown_filename string"))
    assert [(r["pdf"], r["markdown"], r["reason"]) for r in told.collect()] == [("ﬁle １.pdf", "File 1.md", None)]


def test_citations_as_readers_see_them(spark):
    row = spark.range(1).select(quotes.rendered(F.lit("T"), F.lit(3), F.array(F.lit("A"), F.lit("B")), F.lit("s")).alias("a"), quotes.rendered(F.lit("T"), F.lit(3), F.array().cast("array<string>"), F.lit("s")).alias("b")).first()
    assert tuple(row) == ("[T, p. 3; A > B — “s”]", "[T, p. 3 — “s”]")


def test_an_index_is_filled_only_if_empty(spark):
    df = spark.createDataFrame([(0, 5), (3, 0), (3, 1)], "n int, e int").select(stores.may_initialise(F.col("n"), F.col("e")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["initialise", "keep", "refuse"]


def test_live_vectors_leave_out_what_is_withdrawn(spark):
    index = spark.createDataFrame([("a", "d1"), ("b", "d2"), ("c", "d3")], "chunk_id string, document_id string")
    gone = spark.createDataFrame([("d2",)], "document_id string")
    ids = lambda docs: sorted(r["chunk_id"] for r in stores.live_vectors(index, docs, gone).collect())
    assert ids(None) == ["a", "c"] and ids(["d1", "d2"]) == ["a"]
    assert service.STATUS
