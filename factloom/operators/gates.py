"""Gates of an evaluation: metrics that are counted while results are written, and what must hold of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from factloom.functions.text import numbers

#: Floors of retrieval, just below the last good run.
RECALL5, RECALL10, MRR = 0.7, 0.9, 0.6
#: How near a number must be to the one that is expected.
NEAR = 0.005


def watched(found: DataFrame, unsafe: Column, right_page: Column, name: str = "evaluation") -> tuple[DataFrame, Observation]:
    """The results as they are, and an observation that counts unsafe ones and those that cite the right page (null: not judged) as they flow by."""
    seen = Observation(name)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return found.observe(seen, F.count(F.lit(1)).alias("n_found"), F.count_if(flag(unsafe)).alias("n_unsafe"), F.count_if(flag(right_page)).alias("n_right"), F.count_if(right_page.isNotNull()).alias("n_judged")), seen


def verdict(metrics: DataFrame, seen: dict[str, int], recall5: float = RECALL5, recall10: float = RECALL10, mrr: float = MRR) -> DataFrame:
    """``metrics`` (``recall_at_5, recall_at_10, mrr``) and what was observed, with ``failed``: the gates that do not hold, in order, and ``passed``."""
    cited = F.lit(seen["n_right"] / seen["n_judged"] if seen["n_judged"] else 1.0)
    tests = {"unsafe_evidence": F.lit(seen["n_unsafe"] > 0), "citation_accuracy": cited < 1, "recall_at_5": F.col("recall_at_5") < recall5, "recall_at_10": F.col("recall_at_10") < recall10, "mrr": F.col("mrr") < mrr}
    failed = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return metrics.select("*", F.lit(seen["n_unsafe"]).cast("long").alias("n_unsafe"), cited.alias("citation_accuracy"), failed.alias("failed"), (F.size(failed) == 0).alias("passed"))


def shows(text: Column, value: Column) -> Column:
    """Whether a text states a number, as near as ``NEAR``."""
    return F.exists(numbers(F.coalesce(text, F.lit(""))), lambda n: F.abs(n - value) <= NEAR)


def smoke(answers: DataFrame, expected: DataFrame, citations: DataFrame, validated: DataFrame) -> DataFrame:
    """``answer_id, failures`` of answers that are held against what is expected of them.

    ``answers``: ``answer_id, answer, refusal``; ``expected``: ``answer_id,
    refuse, values, documents``; ``citations`` and ``validated`` (from the
    trace): ``answer_id, citation_id, document_id``.  An answer shows all
    values, cites all documents and exactly the citations of its trace; one
    that should be refused is, and has no citations.
    """
    none = F.array().cast("array<string>")
    sets = lambda df, c, name: df.groupBy("answer_id").agg(F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(name))
    met = expected.join(answers, "answer_id", "left").join(sets(citations, "citation_id", "cited"), "answer_id", "left").join(sets(citations, "document_id", "seen"), "answer_id", "left").join(sets(validated, "citation_id", "traced"), "answer_id", "left")
    have = lambda c: F.coalesce(F.col(c), none)
    refused = F.coalesce("refusal", F.lit(False))
    tests = {
        "NOT_ANSWERED": F.col("answer").isNull() | (~F.col("refuse") & refused),
        "NOT_REFUSED": F.col("refuse") & ~refused,
        "CITED_IN_REFUSAL": F.col("refuse") & (F.size(have("cited")) > 0),
        "VALUE_OMITTED": ~F.col("refuse") & ~F.forall("values", lambda v: shows(F.col("answer"), v)),
        "DOCUMENT_NOT_CITED": ~F.col("refuse") & (F.size(F.array_except("documents", have("seen"))) > 0),
        "CITATIONS_NOT_OF_TRACE": have("cited") != have("traced"),
    }
    return met.select("answer_id", F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()])).alias("failures"))


def expectations(cases: DataFrame) -> DataFrame:
    """``item_id, expected``: what is published of trust cases: whether to refuse, facts, computed numbers and the artifact."""
    return cases.select(F.concat(F.lit("trust-"), F.col("case_id")).alias("item_id"), F.struct(F.col("expect_refusal").alias("refuse"), F.col("expected_facts").alias("facts"), F.col("expected_derived").alias("computed"), F.col("expected_artifact").alias("artifact")).alias("expected"))


def vector_errors(items: DataFrame, made: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, code``: texts that an embedder must not get, and answers of it that no index may take.

    ``items``: ``key, text``; ``made``: ``key, vector`` or ``key, indices,
    weights`` of a sparse one.
    """
    n = made.groupBy(key).agg(F.count("*").alias("n"), F.first(F.struct(*[c for c in made.columns if c != key])).alias("m"))
    met = items.select(key, "text").join(n, key, "left")
    sparse = "indices" in made.columns
    length = F.size("m.indices") if sparse else F.size("m.vector")
    code = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "BLANK_INPUT").when(F.coalesce("n", F.lit(0)) != 1, "COUNT_MISMATCH").when(F.coalesce(length, F.lit(-1)) < 1, "EMPTY_VECTOR")
    code = code.when(F.size("m.indices") != F.size("m.weights"), "LENGTH_MISMATCH") if sparse else code
    return met.select(key, code.alias("code")).filter("code is not null")


def targets_of(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Items (``region, document_id``) with the first target (``position, target``) that is their region or document, whatever the case."""
    fold = lambda c: F.lower(F.trim(F.col(c)))
    named = targets.select(fold("target").alias("name"), F.struct("position", "target").alias("t")).groupBy("name").agg(F.min("t").alias("t"))
    by = lambda c, name: named.select(F.col("name").alias(f"of_{name}"), F.col("t").alias(name))
    met = items.join(by("region", "by_region"), fold("region") == F.col("of_by_region"), "left").join(by("document_id", "by_document"), fold("document_id") == F.col("of_by_document"), "left")
    return met.withColumn("target", F.least("by_region", "by_document")["target"]).drop("of_by_region", "by_region", "of_by_document", "by_document")
