"""Indexes written in slices: what they move follows the input, and what a task holds is bounded."""

from __future__ import annotations

import numpy as np
import pandas as pd

from factloom.functions import stem
from factloom.operators import postings, quotes, scoring
from factloom.operators import retrieval as R
from tests.conftest import SMALL


def test_a_word_has_the_same_stem_by_itself(spark):
    held = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("explode(regexp_extract_all(lower(text), '[a-z0-9]+', 0)) AS term").distinct().toPandas()["term"].tolist()
    made = [b + s for b in ("y", "yy", "say", "syzyg", "fail", "hop", "controll", "agre", "toy", "adopt", "b", "fil", "ye") for s in ("ies", "sses", "eed", "ed", "ing", "yed", "ion", "tion", "ization", "ement", "ical", "iveness", "ll", "e", "y", "at", "")]
    words = sorted({*held, *made})
    assert {r.term: r.stem for r in stem.stems(spark.createDataFrame(pd.DataFrame({"term": words}))).collect()} == {w: stem.stem_of(w) for w in words}


def test_an_index_is_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Neither texts nor postings go over the network, however common a term is; blocks hold a slice's postings at most."""
    monkeypatch.setattr(postings, "BLOCK", 50)
    plans, real = [], postings.TermIndex.write
    monkeypatch.setattr(postings.TermIndex, "write", lambda self, df, segment, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(self, df, segment, name))[1])
    index = postings.TermIndex(spark, f"file://{tmp_path}/a")
    postings.add(index, spark.range(400).selectExpr("id AS chunk_id", "concat('all w', id % 7, ' ', repeat('x ', cast(id % 5 AS int))) AS text"))
    assert len(plans) == 2 and not any("Exchange" in p for p in plans)
    blocks = index.read("blocks")
    assert blocks.filter("term = 'all'").selectExpr("sum(n)", "max(n)").first()[:] == (400, 50)
    assert index.read("chunks").selectExpr("count(*)", "count(distinct chunk_id)").first()[:] == (400, 400)
    rows = postings.search(index, spark.createDataFrame([(1, "all w3"), (2, "x w0")], "query_id int, query string"), 3).collect()
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in rows)[:3] == [(1, 0, 10), (1, 1, 45), (1, 2, 80)]
    assert np.isclose(max(r.score for r in rows if r.query_id == 1), np.log(1 + 0.5 / 400.5) * postings.weight(1, 2) + np.log(1 + (400 - 57 + 0.5) / 57.5) * postings.weight(1, 2), atol=1e-5)


def test_a_task_holds_few_finds():
    best, scores = scoring.Best(5, 100), np.linspace(0, 1, 2_000 * 100).reshape(2_000, 100)
    for k in range(20):
        best.add(np.arange(2_000) + 2_000 * k, scores + k, np.ones(scores.shape, bool))
        assert best.held <= 2 * 5 * 100 + (1 << 18)
    query, item, _ = best.cut()
    assert item[query == 7].tolist() == [39_999, 39_998, 39_997, 39_996, 39_995]


def test_scores_do_not_depend_on_the_parts_they_are_made_in(spark, monkeypatch):
    items = spark.range(60).selectExpr("id AS chunk_id", "concat_ws(' ', transform(sequence(1, 3 + id % 9), k -> concat('w', k * id % 11))) AS text", "array(id % 7, 1.0, id % 3) AS vector")
    queries = spark.range(9).selectExpr("id AS query_id", "concat('w', id, ' w1 w2') AS query", "array(id % 5, 1.0, 2.0) AS vector")
    legs = lambda: [sorted(tuple(r) for r in leg(queries, items, 4).collect()) for leg in (R.bm25_leg, R.dense_leg)]
    whole = legs()
    assert [len(x) for x in whole] == [36, 36]
    monkeypatch.setattr(scoring, "CELLS", 16)
    assert legs() == whole


def test_pairs_are_dealt_out_once_for_their_prose(spark):
    kinds = "claim_id string, evidence_id string, claim_text string, value double, year int, metric string, population string, residence string, unit string, claim_region string, text string, region string, context string"
    row = lambda key, text: (key, "e", "The population was stated.", 7.0, 1999, "population", None, None, None, None, text, "", "")
    out = quotes.selected_spans(spark.createDataFrame([row("a", "In 1998 the population was 7. In 1999 the population was 7."), row("b", "")], kinds))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.claim_id: (r.match_type, r.start, r.end, r.reason) for r in out.collect()} == {"a": ("prose", 30, 59, None), "b": ("none", None, None, "NO_CANDIDATE_SPAN")}
