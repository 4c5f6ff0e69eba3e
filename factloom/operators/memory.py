"""What a session remembers: validated claims of earlier turns, their evidence, and answers made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Questions about sources, words that point back, and turns that are remembered.
SOURCES = r"(?i)\b(?:which|what|show|where).{0,40}\b(?:source|citation|report|page)s?\b|\bwhere did (?:that|this|the) (?:number|value) come from\b"
POINTING = r"(?i)\b(?:those|that|these|previous|comparison)\b"
ASK = "Which previous answer or comparison would you like source pages for?"
KINDS = ("lookup", "summary", "comparison", "inconsistency_analysis")
TURNS = 8


def asks_for_sources(query: Column) -> Column:
    return F.coalesce(query.rlike(SOURCES), F.lit(False))


def source_turns(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """``question_id, run_id, clarify``: the turn that a question about sources means, or what to ask back.

    ``questions``: ``question_id, session_id, query``; ``turns``: ``session_id,
    run_id, turn, task_type, n_claims``.  Words that point back mean the last
    comparison; else there must be one turn with claims, or one comparison.
    """
    live = turns.filter("n_claims > 0")
    compared = F.when(F.col("task_type") == "comparison", F.struct("turn", "run_id"))
    by = live.groupBy("session_id").agg(F.count("*").alias("n"), F.count(compared).alias("n_compared"), F.max(compared).alias("last"), F.max(F.struct("turn", "run_id")).alias("only"))
    met = questions.join(by, "session_id", "left")
    run = F.when(F.col("query").rlike(POINTING) & (F.col("n_compared") > 0), F.col("last.run_id")).when(F.col("n") == 1, F.col("only.run_id")).when(F.col("n_compared") == 1, F.col("last.run_id"))
    return met.select("question_id", run.alias("run_id"), F.when(run.isNull(), F.lit(ASK)).alias("clarify"))


def displayed(value: Column) -> Column:
    """A value as answers show it: no sign, no zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.10f", F.abs(value)), "0+$", ""), r"\.$", "")


def support_question(claims: DataFrame) -> DataFrame:
    """``run_id, query``: the claims of a turn in words, as a search for their pages."""
    one = F.concat_ws(" ", "region", "metric", F.col("year").cast("string"), displayed(F.col("value")))
    told = claims.filter(~F.col("derived")).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", one.alias("t")))).alias("ts"))
    return told.select("run_id", F.concat(F.lit("Return the physical PDF source pages supporting: "), F.array_join(F.transform("ts", lambda t: t["t"]), "; ")).alias("query"))


def references(claims: DataFrame) -> DataFrame:
    """``session_id, evidence_id, document_id, page_number, source_checksum`` of all claims, the first mention of each; incomplete ones are left out.

    ``claims``: ``session_id, turn, claim_id, evidence_ids, document_ids, page_numbers, source_checksums``.
    """
    whole = F.least(*[F.size(c) for c in ("evidence_ids", "document_ids", "page_numbers", "source_checksums")])
    cut = lambda c: F.slice(c, F.lit(1), whole).alias(c)
    each = claims.filter(whole > 0).select("session_id", "turn", "claim_id", *[cut(c) for c in ("evidence_ids", "document_ids", "page_numbers", "source_checksums")])
    rows = each.select("session_id", "turn", "claim_id", F.posexplode(F.arrays_zip("evidence_ids", "document_ids", "page_numbers", "source_checksums")).alias("nth", "r"))
    first = rows.groupBy("session_id", F.col("r.evidence_ids").alias("evidence_id")).agg(F.min_by("r", F.struct("turn", "claim_id", "nth")).alias("r"))
    return first.select("session_id", "evidence_id", F.col("r.document_ids").alias("document_id"), F.col("r.page_numbers").alias("page_number"), F.col("r.source_checksums").alias("source_checksum"))


def support_drafts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``run_id, claim_id, line``: what an answer about sources says of each claim; derived ones rest on the evidence of their inputs.

    ``claims``: ``run_id, claim_id, region, value, unit, derived, input_claim_ids,
    evidence_ids``; ``evidence``: ``evidence_id, region, document_title, page_number``.
    """
    e = evidence.select(F.col("evidence_id").alias("first_id"), F.col("region").alias("e_region"), "document_title", "page_number")
    source = claims.filter(~F.col("derived") & (F.size("evidence_ids") > 0)).withColumn("first_id", F.get("evidence_ids", F.lit(0))).join(e, "first_id")
    suffix = F.when(F.col("unit") == "percent", "%").otherwise(F.when(F.coalesce("unit", F.lit("")) != "", F.concat(F.lit(" "), F.col("unit"))).otherwise(""))
    line = F.concat(F.lit("- "), F.coalesce("region", "e_region"), F.lit(" "), F.coalesce(displayed(F.col("value")), F.lit("value")), suffix, F.lit(" — "), F.col("document_title"), F.lit(", physical PDF page "), F.col("page_number").cast("string"), F.lit("."))
    made = F.concat(F.lit("- Difference "), displayed(F.col("value")), F.lit(" percentage points — derived from the two cited source values."))
    inputs = claims.filter("derived").select("run_id", "claim_id", "value", F.explode("input_claim_ids").alias("input_id"))
    known = claims.filter(~F.col("derived")).select("run_id", F.col("claim_id").alias("input_id"), F.col("evidence_ids").alias("cited"))
    met = inputs.join(known, ["run_id", "input_id"], "left").groupBy("run_id", "claim_id", "value").agg(F.array_distinct(F.flatten(F.collect_list("cited"))).alias("evidence_ids"))
    return source.select("run_id", "claim_id", line.alias("line"), "evidence_ids").unionByName(met.select("run_id", "claim_id", made.alias("line"), "evidence_ids"))


def recovered(traces: DataFrame) -> DataFrame:
    """``session_id, run_id, task_type, n_claims``: claim turns of old traces, the last ``TURNS`` of a session.

    ``traces``: ``session_id, run_id, answer_status, run_status, events``, where
    an event has ``event, ts, task_type, n_claims``; runs must have been
    answered and completed, classified, drafted and cited.
    """
    kind = lambda name: F.filter("events", lambda e: e["event"] == name)
    sound = traces.filter("answer_status = 'answered' and run_status = 'completed'").withColumns({"class": F.get(kind("task_classification"), F.lit(0)), "draft": F.try_element_at(kind("structured_draft"), F.lit(-1)), "cited": F.try_element_at(kind("validated_citations"), F.lit(-1))})
    good = sound.filter(F.col("class").isNotNull() & F.col("draft").isNotNull() & F.col("cited").isNotNull() & F.col("class.task_type").isin(*KINDS) & (F.col("draft.n_claims") > 0))
    began = F.array_min(F.transform("events", lambda e: e["ts"]))
    last = Window.partitionBy("session_id").orderBy(F.desc("began"), F.desc("run_id"))
    out = good.withColumn("began", began).withColumn("back", F.row_number().over(last)).filter(F.col("back") <= TURNS)
    return out.select("session_id", "run_id", F.col("class.task_type").alias("task_type"), F.col("draft.n_claims").alias("n_claims"))


def checkpoints(states: DataFrame) -> DataFrame:
    """``session_id, checkpoint_id``: the latest successful checkpoint of each session."""
    order = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("checkpoint_id"))
    return states.filter("ok").withColumn("back", F.row_number().over(order)).filter("back = 1").select("session_id", "checkpoint_id")


def catalog_notes(documents: DataFrame, years: DataFrame, most: int = 50) -> DataFrame:
    """``document_id, note``: the first ``most`` documents with the years that their tables tell."""
    met = documents.join(years, "document_id", "left").orderBy("document_id").limit(most)
    told = F.when(F.size(F.coalesce("years", F.array().cast("array<int>"))) > 0, F.concat(F.lit(" (table years: "), F.array_join(F.transform("years", lambda y: y.cast("string")), ", "), F.lit(")"))).otherwise("")
    return met.select("document_id", F.concat("document_id", F.lit(": "), "title", F.lit(", "), "region", told).alias("note"))
