"""Packing, gates, scoring and streams on small inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import analyzer, evidence, events, facts, retrieval, trust


def brute_pack(items, max_chars, max_chunks):
    """Rounds of one item for each document; a round that adds nothing ends it."""
    by_doc = {}
    for i in sorted(items, key=lambda x: x["place"]):
        by_doc.setdefault(i["document_id"], []).append(i)
    kept, chars = set(), 0
    while any(by_doc.values()):
        added = False
        for queue in by_doc.values():
            if queue:
                i = queue.pop(0)
                if chars + len(i["text"]) <= max_chars and len(kept) < max_chunks:
                    kept.add(i["item_id"])
                    chars += len(i["text"])
                    added = True
        if not added:
            break
    return kept


def test_packing_is_round_robin(spark):
    rows = [(1, k, f"d{k % 3}", "R", "x" * (10 + 37 * k % 90), float(k % 7)) for k in range(40)]
    items = spark.createDataFrame(rows, "query_id long, item_id long, document_id string, region string, text string, score double").withColumn("target", F.lit(None).cast("string"))
    for chars, n in ((200, 50), (90, 50), (2000, 5), (5, 5)):
        got = {r.item_id for r in evidence.packed(items, chars, n).filter("kept").collect()}
        assert got == brute_pack([r.asDict() for r in evidence.prioritised(items).collect()], chars, n)


def test_targets_are_reserved(spark):
    rows = [(1, 1, "a", "R", "x" * 50, 9.0, None), (1, 2, "b", "R", "x" * 50, 1.0, "t")]
    items = spark.createDataFrame(rows, "query_id long, item_id long, document_id string, region string, text string, score double, target string")
    got = lambda reserve: {r.item_id for r in evidence.packed(items, 60, 5, reserve).filter("kept").collect()}
    assert got(False) == {1} and got(True) == {2}


def test_fusion_constant_and_order(spark):
    leg = lambda ids: spark.createDataFrame([(1, i, k) for k, i in enumerate(ids)], "query_id long, chunk_id string, rank int")
    got = {r.chunk_id: r.score for r in retrieval.fuse([leg(["a", "b", "c"]), leg(["c", "a"])], 3).collect()}
    assert got == {"a": round(1 / 2 + 1 / 3, 6), "c": round(1 / 4 + 1 / 2, 6), "b": round(1 / 3, 6)}


def test_zero_baseline_is_refused(spark):
    rows = [("a", "difference", 3.0, 1.0), ("b", "percentage_difference", 3.0, 0.0), ("c", "power", 1.0, 1.0), ("d", "sum", 1.0, 2.0)]
    got = {r.calc_id: (r.result, r.reason) for r in facts.calculations(spark.createDataFrame(rows, "calc_id string, operation string, left double, right double")).collect()}
    assert got == {"a": (2.0, None), "b": (None, "ZERO_BASELINE"), "c": (None, "UNKNOWN_OPERATION"), "d": (3.0, None)}


def test_verdict_precedence(spark):
    cases = spark.createDataFrame([(k, 1, k == "r", False, k != "e") for k in "abcder"], "case_id string, repeat int, expect_refusal boolean, refused boolean, responded boolean")
    claim = lambda case, value, cited=True: (case, 1, "c", "Odisha", "literacy rate", 2011, "total", None, value, cited, None, [])
    rows = [claim("a", 72.9), claim("b", 71.0), claim("c", 72.9, False), claim("r", 1.0)]
    claims = spark.createDataFrame(rows, "case_id string, repeat int, claim_id string, region string, metric string, year int, residence string, population string, value double, cited boolean, operation string, operands array<double>")
    facts_ = spark.createDataFrame([(k, "f", "Odisha", "literacy rate", 2011, "total", None, "72.9") for k in "abcd"], "case_id string, fact_id string, region string, metric string, year int, residence string, population string, value string")
    got = {r.case_id: r.verdict for r in trust.verdicts(cases, claims, facts_).collect()}
    assert got == {"a": "passed", "b": "wrong_answer", "c": "unsupported", "d": "false_refusal", "e": "error", "r": "wrong_answer"}


def test_job_states_end_with_success(spark):
    rows = [("a", 1, 1, "queued"), ("a", 2, 2, "processing"), ("a", 3, 3, "failed"), ("a", 4, 4, "queued"), ("b", 1, 5, "succeeded"), ("b", 2, 6, "failed")]
    jobs = spark.createDataFrame(rows, "job_id string, t int, event_id int, status string").withColumn("ts", F.timestamp_seconds("t"))
    assert {r.job_id: r.status for r in events.latest_state(jobs).collect()} == {"a": "queued", "b": "succeeded"}


def test_scopes_of_the_question_come_first(spark):
    rows = [("Rural women's literacy?", "male", "urban"), ("Literacy?", "all", "Urban"), ("rural or urban?", None, None)]
    df = spark.createDataFrame(rows, "q string, p string, r string")
    got = [tuple(r) for r in df.select(analyzer.population_scope(F.col("q"), F.col("p")), analyzer.residence_scope(F.col("q"), F.col("r")), analyzer.residence_scopes(F.col("q"))).collect()]
    assert got == [("female", "rural", None), (None, "urban", None), (None, None, ["rural", "urban"])]
