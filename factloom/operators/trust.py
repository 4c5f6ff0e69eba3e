"""Trust scoring: answers held against expected facts, verdicts, scorecards and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import decimals
from factloom.operators.events import median, nearest_rank

CLOSE = 0.005


def half_unit(stated: Column) -> Column:
    """Half a unit of the last digit that a number states."""
    return 0.5 * F.pow(F.lit(10.0), -decimals(stated))


def recomputed(operation: Column, operands: Column) -> Column:
    a, b = F.get(operands, F.lit(0)), F.get(operands, F.lit(1))
    return F.when(operation == "sum", F.aggregate(operands, F.lit(0.0), lambda x, y: x + y)).when(operation == "difference", a - b).when((operation == "percentage_difference") & (b != 0), (a - b) / b * 100)


def same_slot() -> Column:
    """Whether a claim is about the cell of an expected fact; a claim without a group may be about persons."""
    return (F.lower("c.region") == F.lower("f.region")) & F.contains(F.lower("c.metric"), F.lower("f.metric")) & F.col("c.year").eqNullSafe(F.col("f.year")) & (F.coalesce("c.residence", F.lit("total")) == F.coalesce("f.residence", F.lit("total"))) & (F.coalesce("c.population", F.lit("persons")) == F.coalesce("f.population", F.lit("persons")))


def verdicts(cases: DataFrame, claims: DataFrame, expected: DataFrame) -> DataFrame:
    """``case_id, repeat, verdict``, by precedence.

    ``cases``: ``case_id, repeat, expect_refusal, refused, responded``;
    ``claims``: ``case_id, repeat, claim_id, region, metric, year, residence, population, value, cited, operation, operands``;
    ``expected``: ``case_id, fact_id, region, metric, year, residence, population, value`` (value as stated, text).
    """
    key = ["case_id", "repeat"]
    c, f = claims.alias("c"), expected.alias("f")
    met = c.join(f, (F.col("c.case_id") == F.col("f.case_id")) & same_slot(), "left")
    near = F.abs(F.col("c.value") - F.col("f.value").cast("double")) <= F.greatest(half_unit(F.col("f.value")), F.lit(CLOSE))
    wrong = F.col("f.value").isNotNull() & ~near
    arithmetic = F.col("c.operation").isNotNull() & ~F.coalesce(F.abs(recomputed(F.col("c.operation"), F.col("c.operands")) - F.col("c.value")) <= CLOSE, F.lit(False))
    # A value that belongs to another expected cell is misattributed even if its own slot isn't expected.
    sums = met.groupBy(F.col("c.case_id").alias("case_id"), F.col("c.repeat").alias("repeat")).agg(
        F.countDistinct("c.claim_id").alias("n_claims"), F.count_if(wrong).alias("n_wrong"), F.count_if(arithmetic).alias("n_arithmetic"), F.countDistinct(F.when(F.col("f.value").isNotNull() & near, F.col("f.fact_id"))).alias("n_right"),
        F.count_if(F.col("f.value").isNull() & F.col("c.operation").isNull()).alias("n_unsupported"), F.count_if(~F.col("c.cited")).alias("n_uncited"),
    )
    asked = expected.groupBy("case_id").agg(F.count("*").alias("n_expected"))
    out = cases.join(sums, key, "left").join(asked, "case_id", "left").fillna(0, ["n_claims", "n_wrong", "n_arithmetic", "n_right", "n_unsupported", "n_uncited", "n_expected"])
    verdict = (
        F.when(~F.col("responded"), "error")
        .when(F.col("expect_refusal"), F.when(F.col("n_claims") == 0, "passed").otherwise("wrong_answer"))
        .when(F.col("refused") | (F.col("n_claims") == 0), "false_refusal")
        .when((F.col("n_wrong") > 0) | (F.col("n_arithmetic") > 0), "wrong_answer")
        .when((F.col("n_unsupported") > 0) | (F.col("n_uncited") > 0), "unsupported")
        .when(F.col("n_right") < F.col("n_expected"), "incomplete")
        .otherwise("passed")
    )
    return out.select("case_id", "repeat", "expect_refusal", verdict.alias("verdict"), "n_claims")


def scorecard(results: DataFrame) -> DataFrame:
    """One row: counts of verdicts, median latency without errors, and how many cases change between repeats."""
    counts = [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("passed", "wrong_answer", "false_refusal", "unsupported", "incomplete", "error")]
    middle = median(results.filter("verdict <> 'error'").withColumn("g", F.lit(1)), ["g"], "latency").select(F.round("median", 1).alias("median_latency"))
    one = results.agg(F.count("*").alias("n"), *counts).join(F.broadcast(middle), how="left")
    unstable = results.groupBy("case_id").agg(F.countDistinct(F.col("verdict") == "passed").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_unstable"))
    return one.crossJoin(F.broadcast(unstable))


def run_metrics(results: DataFrame) -> DataFrame:
    """One row of rates to four places; an empty denominator is 1, or 0 for false refusals; the 95th percentile is a value of the data."""
    rate = lambda part, whole, empty=1.0: F.when(F.count_if(whole) == 0, F.lit(empty)).otherwise(F.round(F.count_if(part & whole) / F.count_if(whole), 4))
    v, refusal = F.col("verdict"), F.col("expect_refusal")
    refused = v.isin("false_refusal") | (refusal & (v == "passed"))
    one = results.agg(
        rate(v == "passed", F.lit(True)).alias("pass_rate"), rate(v == "passed", ~refusal).alias("answer_rate"), rate(v == "wrong_answer", F.lit(True), 1.0).alias("wrong_rate"), rate(v == "false_refusal", ~refusal, 0.0).alias("false_refusal_rate"),
        rate(refusal, refused).alias("refusal_precision"), rate(v == "passed", refusal).alias("refusal_recall"),
    )
    p95 = nearest_rank(results.filter("verdict <> 'error'").withColumn("g", F.lit(1)), ["g"], "latency").select(F.col("p").alias("p95_latency"))
    return one.crossJoin(F.broadcast(p95))


def unstable_cases(results: DataFrame) -> DataFrame:
    passed = F.col("verdict") == "passed"
    return results.groupBy("case_id").agg(F.count("*").alias("n_repeats"), F.count_if(passed).alias("n_passed")).filter("n_passed > 0 and n_passed < n_repeats")


def is_ranking(rows: DataFrame) -> DataFrame:
    """``chart_id, ranking``: whether a chart has one series of five values or more that only fall or only rise."""
    w = Window.partitionBy("chart_id").orderBy("row_no")
    step = rows.withColumn("step", F.signum(F.col("value") - F.lag("value").over(w)))
    return step.groupBy("chart_id").agg(((F.countDistinct("series") == 1) & (F.count("*") >= 5) & (F.coalesce(F.min("step") >= 0, F.lit(False)) | F.coalesce(F.max("step") <= 0, F.lit(False)))).alias("ranking"))
