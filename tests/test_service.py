"""Ingestion, search and answers as one call each, and the parts they are made of, on small inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import __main__ as cli
from factloom import service
from factloom.operators import audit, calculations, client, collect, datasets, events, memory, quotes, retrieval, scoring
from factloom.sources import stores
from tests.conftest import SMALL


def test_commands(spark):
    assert cli.run(spark, ["ingest", SMALL]).filter("status = 'indexed'").count() == 5
    top = cli.run(spark, ["search", SMALL, "--text", "scheduled castes order count", "--top-k", "3", "--region", "ASIA 0"]).collect()
    assert [r["rank"] for r in top] == [0, 1, 2] and {r.document_id for r in top} == {"orders-asia-0"} and any("Scheduled Castes" in r.section for r in top)
    said = cli.run(spark, ["answer", SMALL, "--region", "asia 0", "--years", "1996", "2000"]).first()
    assert said.status == "answered" and said.n_claims == 3 and " than in 1996 by " in said.answer
    assert cli.run(spark, ["answer", SMALL, "--region", "asia 0", "--years", "1997", "--rank"]).first().answer.startswith("NATION17 has the highest order count in 1997")
    assert cli.run(spark, ["tables", SMALL]).count() == 15 and cli.run(spark, ["audit", SMALL]).first().snippet_not_in_text == 0
    with pytest.raises(SystemExit):
        cli.run(spark, ["query", SMALL, "--name", "nothing"])


def test_withdrawn_and_stale_documents_are_refused(spark):
    c = service.corpus_of(spark, SMALL)
    none = F.lit(None).cast("string")
    specs = c.pages.select("document_id", "region").distinct().select("document_id", F.lit("ranking").alias("kind"), F.col("document_id").alias("spec_id"), "region", F.lit("order count").alias("metric"), F.lit(1997).alias("year"), F.array().cast("array<int>").alias("years"), none.alias("residence"), none.alias("population"), none.alias("entity_kind"))
    gone = specs.filter("region like 'ASIA%'").select("document_id")
    got = {r.spec_id: r.reason for r in service.answer(c, specs, gone).collect()}
    assert got == {k: "DOCUMENT_WITHDRAWN" if "asia" in k else None for k in got}


def test_search_checks_what_it_is_asked(spark):
    chunks = spark.createDataFrame([("a", "red fox", "d1", "r", 1), ("b", "blue fox", "d2", "r", 1), ("c", "", "d2", "r", 1)], "chunk_id string, text string, document_id string, region string, page_number int")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "chunk_id string, vector array<double>")
    asked = spark.createDataFrame([(1, "fox", [0.0, 1.0]), (2, "  ", None), (3, "nothing here", None)], "query_id int, query string, vector array<double>")
    rows, status, legs = retrieval.search(asked, chunks, vectors, 2)
    assert {r.query_id: (r.status, r.n_found) for r in status.collect()} == {1: ("candidate_evidence", 2), 2: ("blank_query", 0), 3: ("insufficient_evidence", 0)}
    found = {r.chunk_id: r.reason for r in rows.filter("query_id = 1").collect()}
    assert found["b"] is None and legs["dense"].filter("rank = 0").first().chunk_id == "b"
    assert retrieval.search(asked, chunks, vectors, 2, documents=["d1"])[0].select("chunk_id").distinct().collect() == [("a",)]
    with pytest.raises(ValueError):
        retrieval.search(asked, chunks, vectors, 0)


def test_best_keeps_ties_by_item():
    rng = np.random.default_rng(0)
    best, rows = scoring.Best(3, 4), []
    for at in range(0, 300, 50):
        items, scores = np.arange(at, at + 50), rng.integers(0, 9, (50, 4)).astype(float)
        best.add(items, scores, np.ones(scores.shape, bool))
        best.cut()
        rows += [(q, -scores[k, q], items[k]) for k in range(50) for q in range(4)]
    query, item, score = best.cut()
    for q in range(4):
        assert [(-s, i) for s, i in zip(score[query == q], item[query == q], strict=True)] == [r[1:] for r in sorted(r for r in rows if r[0] == q)[:3]]


def test_legs_without_queries_or_items(spark):
    none = spark.createDataFrame([], "query_id int, query string, vector array<double>")
    items = spark.createDataFrame([("a", "x", [1.0])], "chunk_id string, text string, vector array<double>")
    one = spark.createDataFrame([(1, "x", [1.0])], "query_id int, query string, vector array<double>")
    assert retrieval.dense_leg(none, items, 3).count() == retrieval.bm25_leg(none, items, 3).count() == 0
    assert retrieval.dense_leg(one, items.limit(0), 3).count() == retrieval.bm25_leg(one, items.limit(0), 3).count() == 0
    assert retrieval.bm25_leg(one, items, 3).count() == 1


QUOTED = "claim_id int, evidence_id int, claim_text string, value double, year int, metric string, population string, residence string, unit string, claim_region string, text string, region string, context string, quote string"


def test_quotes_are_refused_in_order(spark):
    text = "The literacy rate of males in rural Odisha was 70.2 percent in 2011. Density grew."
    base = dict(claim_id=0, evidence_id=0, claim_text="Literacy was 70.2 percent", value=70.2, year=2011, metric="literacy_rate", population="male", residence="rural", unit="percent", claim_region="Odisha", text=text, region="Odisha", context="Report", quote=text[:68])
    base["population"] = "males"
    changes = [({}, None), ({"quote": " "}, "EMPTY_QUOTE"), ({"quote": "made up"}, "NON_CONTIGUOUS_QUOTE"), ({"value": 71.0}, "VALUE_ABSENT"), ({"year": 2001}, "YEAR_ABSENT"), ({"metric": "population density"}, "METRIC_ABSENT"), ({"population": "females"}, "POPULATION_SCOPE_ABSENT"), ({"residence": "urban"}, "RESIDENCE_SCOPE_ABSENT"), ({"claim_region": "Goa"}, "REGION_METADATA_MISMATCH"), ({"population": None, "residence": None, "claim_text": "urban literacy"}, "CATEGORY_ABSENT"), ({"quote": "Density grew.", "value": None, "claim_text": "Density grew", "metric": "density", "population": None, "residence": None}, "UNIT_ABSENT")]
    rows = [{**base, **c, "claim_id": k} for k, (c, _) in enumerate(changes)]
    got = {r.claim_id: r.reason for r in quotes.judged_quotes(spark.createDataFrame(rows, QUOTED)).collect()}
    assert got == {k: want for k, (_, want) in enumerate(changes)}


def test_table_spans_come_first(spark):
    text = "Path\n\n| District | Literacy |\n| --- | --- |\n| Puri | 84.7 |\n| Cuttack | 85.5 |\nThe literacy of Cuttack was 85.5 in 2011."
    row = (1, 1, "Literacy was 85.5", 85.5, None, "literacy", None, None, None, None, text, "r", "")
    pairs = spark.createDataFrame([row, (2, 1, "Literacy was 99.9", 99.9, *row[4:])], QUOTED.rsplit(",", 1)[0])
    got = {r.claim_id: r for r in quotes.selected_spans(pairs).collect()}
    assert got[1].match_type == "table" and text[got[1].start : got[1].end].startswith("| District") and text[got[1].start : got[1].end].rstrip().endswith("| Cuttack | 85.5 |")
    assert got[2].match_type == "none" and got[2].reason == "VALUE_ABSENT"


def test_claims_are_filled_from_text_and_evidence(spark):
    rows = [(1, "Literacy was 74.3 % for persons.", "rural literacy in 2011?", None, None, None, None, None, None, None, ["a"])]
    claims = spark.createDataFrame(rows, "claim_id int, text string, query string, metric string, region string, year int, population string, residence string, value double, unit string, evidence_ids array<string>")
    got = calculations.enriched(claims, spark.createDataFrame([("a", "Odisha")], "evidence_id string, region string")).first()
    assert (got.metric, got.region, got.year, got.population, got.residence, got.value, got.unit) == ("literacy_rate", "Odisha", 2011, "persons", "rural", 74.3, "percent")


def test_titles_of_sections(spark):
    rows = [("d", ["A"], "A\n\nSex ratio by residence"), ("d", ["A"], "A\n\nx | y"), ("d", ["B"], "Too short"), ("d", ["C"], "This is a sentence of prose."), ("d", ["D"], "One title of two\n\n"), ("d", ["D"], "Another title here")]
    chunks = spark.createDataFrame(rows, "document_id string, section_path array<string>, text string")
    t = collect.titles(chunks)
    assert [(r.section_path, r.title) for r in t.collect()] == [(["A"], "Sex ratio by residence")]
    assert [r.section_path for r in collect.with_titles(chunks, t).filter("text like '%|%'").collect()] == [["A", "Sex ratio by residence"]]


def test_audit_reads_headers_and_prose(spark):
    table = "| Code | Name | Literacy |  |\n| --- | --- | --- | --- |\n|  |  | 2001 | 2011 |\n| 01 | Puri | 78.0 | 84.7 |"
    claims = spark.createDataFrame([(1, "In 2011 literacy was 84.7.", "literacy", "Puri", 2011, None, None, 84.7), (2, "In 2011 literacy was 78.0.", "literacy", "Puri", 2011, None, None, 78.0), (3, "x", "literacy", "Goa", None, None, None, 84.7), (4, "x", "literacy", "Puri", None, None, None, None)], "claim_id int, text string, metric string, region string, year int, residence string, population string, value double")
    cited = spark.createDataFrame([(k, 1, table, "Path") for k in (1, 2, 3)] + [(3, 2, "Goa had 84.74 then.", "Path")], "claim_id int, quote_id int, snippet string, context string")
    got = {r.claim_id: (r.n_locations, r.reason) for r in audit.support(claims, cited).collect()}
    assert got == {1: (1, None), 2: (1, "CONTRADICTED_YEAR"), 3: (1, None), 4: (0, None)}


def test_units_signatures_and_charts(spark):
    row = spark.range(1).select(
        datasets.unit_supported(F.lit("per cent"), F.lit("Literacy (percentage)"), F.lit("")).alias("a"), datasets.unit_supported(F.lit("%"), F.lit("Growth rate"), F.lit("")).alias("b"), datasets.unit_supported(F.lit("km"), F.lit("Growth"), F.lit("x")).alias("c"),
        datasets.signature(F.lit("x\n| **A** |  B b |\n| --- | --- |")).alias("d"), datasets.chart_kind(F.lit("Bar_Chart")).alias("e"), memory.displayed(F.lit(-2.50)).alias("f"),
    ).first()
    assert tuple(row) == (True, True, False, "a|b b", "bar", "2.5")


def test_follow_ups_and_fragments(spark):
    row = spark.range(1).select(client.fragments(F.lit("a|Long part|--|Long part\n<b>Other</b> *x*")).alias("f")).first()
    assert row.f == ["Long part", "Other x"]


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_values_at_places(spark, n):
    rng = np.random.default_rng(n)
    values = [float(v) for v in rng.integers(-5, 50, n)]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 3.5)], "g string, v double")
    got = {r.g: (r.n, r.median) for r in events.median(df, ["g"], "v").collect()}
    assert got == {"g": (n, float(np.median(values))), "h": (1, 3.5)}
    p = {r.g: r.p for r in events.nearest_rank(df, ["g"], "v").collect()}
    assert p["g"] == sorted(values)[max(0, round(n * 0.95) - 1)]


def test_embedder_is_tried_again(spark, tmp_path):
    mark = tmp_path / "failed"

    def flaky(some):
        if not mark.exists():
            mark.write_text("once")
            raise RuntimeError("busy")
        return [[float(len(t))] for t in some]

    made = stores.embed(spark.createDataFrame([("k1", "abc"), ("k2", "de"), ("k1", "abc")], "cache_key string, text string").coalesce(1), flaky)
    assert {(r.cache_key, r.vector[0]) for r in made.collect()} == {("k1", 3.0), ("k2", 2.0)}


def test_markdown_and_overrides_from_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "A b.md").write_text("# One\n\ntext\n", encoding="utf-8")
    (tmp_path / "m" / "skip.txt").write_text("no", encoding="utf-8")
    (tmp_path / "o.json").write_text('[{"pdf_filename": "a.pdf", "title": "T"}, {"pdf_filename": "b.pdf"}]', encoding="utf-8")
    (tmp_path / "p.json").write_text('{"pdf_filename": "b.pdf"}', encoding="utf-8")
    assert [(r.path.replace("%20", " "), r.text) for r in stores.read_markdown(spark, str(tmp_path / "m")).collect()] == [("A b.md", "# One\n\ntext\n")]
    good, twice = stores.read_overrides(spark, str(tmp_path))
    assert [r.pdf_filename for r in good.collect()] == ["a.pdf"] and [r.pdf_filename for r in twice.collect()] == ["b.pdf"]
