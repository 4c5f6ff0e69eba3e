"""Calculations that answers rest on: which operation a question means, whether its operands stand in the evidence, and the claims that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.frames import computed
from factloom.functions.text import metric_words, named_years, qualifiers
from factloom.operators.analyzer import population_scope, residence_scope
from factloom.operators.facts import difference
from factloom.operators.quotes import DEFAULT_YEAR, stated

# Wording that asks for a relative difference, and words that tell a rate.
RELATIVE = r"(?i)\b(?:percent(?:age)?\s+(?:higher|lower|difference)|relative\s+(?:percent(?:age)?\s+)?difference)\b"
RATES = r"(?i)rate|percent|%"


def operation(query: Column, rates: Column) -> Column:
    """``operation, unit``: relative wording about rates asks for a percentage; else values are subtracted."""
    relative = rates & query.rlike(RELATIVE)
    return F.struct(F.when(relative, "percentage_difference").otherwise("difference").alias("operation"), F.when(relative, "percent").when(rates, "percentage_points").otherwise("count").alias("unit"))


def validated(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """``calc_id, operation, unit, result, reason`` of requests ``calc_id, query, evidence_ids, operands``.

    All evidence must be known (``evidence_id, text``) and both operands must
    stand in it.  Values are rates if every text says so.  A baseline of zero
    is refused.
    """
    asked = requests.select("calc_id", "query", "operands", F.size(F.array_distinct("evidence_ids")).alias("n_asked"), F.explode_outer(F.array_distinct("evidence_ids")).alias("evidence_id"))
    known = asked.join(evidence.select("evidence_id", "text"), "evidence_id", "left")
    known = computed(known, numbers=stated(F.col("text")))
    held = F.transform("operands", lambda x: F.exists("numbers", lambda y: x == y))
    sums = known.withColumn("held", held).groupBy("calc_id", "query", "operands", "n_asked").agg(
        F.count("text").alias("n_known"), F.bool_and(F.coalesce(F.col("text").rlike(RATES), F.lit(False))).alias("rates"), F.bool_or(F.coalesce(F.get("held", F.lit(0)), F.lit(False))).alias("left_held"), F.bool_or(F.coalesce(F.get("held", F.lit(1)), F.lit(False))).alias("right_held")
    )
    how = operation(F.col("query"), F.col("rates"))
    left, right = F.get("operands", F.lit(0)), F.get("operands", F.lit(1))
    out = sums.withColumn("how", how)
    reason = F.when(F.col("n_known") < F.col("n_asked"), "UNKNOWN_EVIDENCE_ID").when(F.size("operands") != 2, "NOT_TWO_OPERANDS").when(~F.col("left_held") | ~F.col("right_held"), "OPERAND_NOT_IN_EVIDENCE").when((F.col("how.operation") == "percentage_difference") & (right == 0), "ZERO_BASELINE")
    result = F.when(F.col("how.operation") == "difference", difference(left, right).cast("double")).otherwise(F.round((left - right) / F.abs(right) * 100, 10))
    return out.withColumn("reason", reason).select("calc_id", "how.operation", "how.unit", F.when(F.col("reason").isNull(), result).alias("result"), "reason")


def enriched(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with what they leave open filled from their text, the question and their evidence, if that says one thing.

    ``claims``: ``claim_id, text, query, metric, region, year, population,
    residence, value, unit, evidence_ids``; ``evidence``: ``evidence_id, region``.
    """
    cited = claims.select("claim_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence, "evidence_id")
    regions = cited.groupBy("claim_id").agg(F.collect_set("region").alias("regions"))
    met = claims.join(regions, "claim_id", "left")
    low, both = F.lower("text"), F.concat_ws(" ", "query", "text")
    plain = F.filter(stated(F.col("text")), lambda n: ~(n.between(1900, 2099) & (n == F.floor(n))))
    years = named_years(F.col("query"))
    group = F.coalesce(F.nullif(F.col("population"), F.lit("")), F.when(F.contains(low, F.lit("persons")), "persons"))
    return met.select(
        "claim_id",
        F.coalesce("metric", F.when(F.contains(low, F.lit("literacy")), "literacy_rate")).alias("metric"),
        F.coalesce("region", F.when(F.size("regions") == 1, F.get("regions", F.lit(0)))).alias("region"),
        F.coalesce("year", F.when(F.size(years) == 1, F.get(years, F.lit(0)))).alias("year"),
        population_scope(both, group).alias("population"),
        residence_scope(both, F.col("residence")).alias("residence"),
        F.coalesce("value", F.get(plain, F.lit(0))).alias("value"),
        F.coalesce("unit", F.when(F.contains("text", F.lit("%")) | F.contains(low, F.lit("percent")), "percent")).alias("unit"),
    )


def derived_claims(claims: DataFrame, calculations: DataFrame, default_year: int = DEFAULT_YEAR) -> DataFrame:
    """``calc_id, text, left_claim, right_claim, evidence_ids, year``: a sentence for each calculation both of whose operands are claims.

    ``claims``: ``answer_id, claim_id, region, metric, year, residence, value,
    evidence_ids``; ``calculations``: ``answer_id, calc_id, operands, result,
    unit, evidence_ids``.  An operand is the first claim of its value that
    shares evidence with the calculation; one claim serves one operand.
    """
    c = claims.select("answer_id", "claim_id", "region", "metric", "year", "residence", "value", F.col("evidence_ids").alias("cited"))
    fits = lambda k: (F.abs(F.get("operands", F.lit(k)) - F.col("value")) < 1e-9) & F.arrays_overlap("evidence_ids", "cited")
    side = F.struct("claim_id", "region", "metric", "year", "residence", "cited")
    met = calculations.join(c, "answer_id").withColumn("first", fits(0)).withColumn("second", fits(1)).filter(F.col("first") | F.col("second"))
    one = met.groupBy("calc_id").agg(F.first("result").alias("result"), F.first("unit").alias("unit"), F.array_sort(F.collect_list(F.when(F.col("first"), side))).alias("lefts"), F.array_sort(F.collect_list(F.when(F.col("second"), side))).alias("rights"))
    one = one.withColumn("left", F.get("lefts", F.lit(0)))
    one = one.withColumn("right", F.get(F.filter("rights", lambda r: r["claim_id"] != F.col("left.claim_id")), F.lit(0))).filter("left is not null and right is not null")
    year = lambda s: F.coalesce(F.col(f"{s}.year"), F.lit(default_year))
    change = F.coalesce((F.lower("left.region") == F.lower("right.region")) & (year("left") != year("right")), F.lit(False))
    more = F.when(F.col("result") >= 0, "higher").otherwise("lower")
    by = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", F.abs("result")), "0+$", ""), r"\.$", "")
    unit = F.when(F.col("unit") == "percentage_points", " percentage points").when(F.col("unit") == "percent", " percent").otherwise("")
    where = F.lower(F.coalesce("left.residence", F.lit("")))
    prefix = F.when(where.isin("rural", "urban") & (where == F.lower(F.coalesce("right.residence", F.lit("")))), F.concat(F.lit("In "), where, F.lit(" areas, "))).otherwise("")
    metric = F.lower(F.regexp_replace(F.coalesce("left.metric", F.lit("value")), "_", " "))
    over_time = F.concat(prefix, F.col("left.region"), F.lit("'s "), metric, F.lit(" was "), more, F.lit(" in "), year("left").cast("string"), F.lit(" than in "), year("right").cast("string"), F.lit(" by "), by, unit, F.lit("."))
    apart = F.concat(prefix, F.coalesce("left.region", F.lit("The first value")), F.lit(" is "), more, F.lit(" than "), F.coalesce("right.region", F.lit("the second value")), F.lit(" by "), by, unit, F.lit("."))
    return one.select("calc_id", F.when(change, over_time).otherwise(apart).alias("text"), F.col("left.claim_id").alias("left_claim"), F.col("right.claim_id").alias("right_claim"), F.array_union("left.cited", "right.cited").alias("evidence_ids"), F.when(~change, F.col("left.year")).alias("year"))


def without_name(text: Column, name: Column) -> Column:
    """A text without a name that it has as whole words: a number of the name (a block, a ward) is no year."""
    literal = F.concat(F.lit(r"(?<!\w)\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", text).otherwise(F.regexp_replace(text, literal, F.lit(" ")))


def year_verdicts(claims: DataFrame, facts: DataFrame, default_year: int = DEFAULT_YEAR) -> DataFrame:
    """``claim_id, verdict``: whether the table's own column is of the claim's year.

    Confirmed or contradicted by the cells of the claim's own row in its cited
    chunk with its value; null if no such cell is there or none tells a year.
    """
    asked = claims.select("claim_id", F.explode("evidence_ids").alias("chunk_id"), F.lower("region").alias("c_region"), F.col("value").cast("double").alias("c_value"), metric_words(F.regexp_replace("metric", "_", " ")).alias("c_words"), F.lower(F.coalesce("residence", F.lit("total"))).alias("c_residence"), "population", F.array_sort(qualifiers(F.concat_ws(" ", "metric", "population"))).alias("c_groups"), F.col("year").alias("c_year"), named_years(without_name(F.col("text"), F.col("region"))).alias("text_years"))
    group = F.lower(F.coalesce("population", F.lit("persons")))
    group = F.when(group == "male", "males").when(group == "female", "females").when(group == "total", "persons").otherwise(group)
    cells = facts.select("chunk_id", F.lower("entity").alias("f_entity"), F.col("value").cast("double").alias("f_value"), metric_words(F.col("metric")).alias("f_words"), F.coalesce("residence", F.lit("total")).alias("f_residence"), F.coalesce("population_group", F.lit("persons")).alias("f_group"), F.array_sort(qualifiers(F.concat_ws(" ", "metric", "title"))).alias("f_groups"), F.col("year").alias("f_year"))
    same = (F.col("c_words") == F.col("f_words")) & (F.col("c_residence") == F.col("f_residence")) & (group == F.col("f_group")) & (F.col("c_groups") == F.col("f_groups"))
    # Cells grow with the tables, and few bytes in storage are many in memory: they are not sent to all.
    met = asked.join(cells.hint("merge"), "chunk_id").filter((F.col("c_region") == F.col("f_entity")) & (F.abs(F.col("c_value") - F.col("f_value")) < 1e-9))
    other = F.col("c_year").isNotNull() & (F.size("text_years") > 0) & (F.col("text_years") != F.array("c_year"))
    wanted = F.coalesce("c_year", F.when(F.size("text_years") == 1, F.get("text_years", F.lit(0))), F.lit(default_year))
    sums = met.withColumn("same", same).groupBy("claim_id").agg(F.count_if("same").alias("n"), F.count_if(F.col("same") & F.col("f_year").isNull()).alias("n_yearless"), F.bool_or(F.col("same") & (F.col("f_year") == wanted)).alias("hit"), F.bool_or(other).alias("other"))
    verdict = F.when(F.col("n") == 0, "contradicted").when(F.col("n_yearless") > 0, None).when(F.col("other"), "contradicted").when(F.coalesce("hit", F.lit(False)), "confirmed").otherwise("contradicted")
    return claims.select("claim_id", "metric").join(sums.hint("merge"), "claim_id", "left").select("claim_id", F.when(F.col("n").isNotNull() & F.col("metric").isNotNull(), verdict).alias("verdict"))


def cell_sentences(cells: DataFrame) -> DataFrame:
    """A sentence and a claim for each selected cell: ``spec_id, turn, text, unit, value``."""
    unit = F.when(F.col("unit").isin("percent", "%"), "percent").otherwise("count")
    where = F.coalesce("residence", F.lit("total"))
    group = F.when(F.coalesce("population_group", F.lit("persons")) != "persons", F.concat(F.lit(" ("), F.col("population_group"), F.lit(")"))).otherwise("")
    text = F.concat(F.col("region"), F.lit("'s "), where, F.lit(" "), F.lower("metric"), group, F.lit(" in "), F.col("year").cast("string"), F.lit(" was "), F.col("raw_value"), F.when(unit == "percent", " percent").otherwise(""), F.lit("."))
    return cells.select("spec_id", "turn", text.alias("text"), unit.alias("unit"), F.col("value").cast("double").alias("value"), F.array("chunk_id").alias("evidence_ids"))


def numbered_drafts(sentences: DataFrame) -> DataFrame:
    """``spec_id, answer``: the sentences of a request, parted by blank lines, in their turn."""
    lines = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return sentences.groupBy("spec_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n\n").alias("answer"), F.count("*").alias("n_claims"))


def in_turn(cells: DataFrame) -> DataFrame:
    """Cells of a request, latest year first, with their turn."""
    return cells.withColumn("turn", F.row_number().over(Window.partitionBy("spec_id").orderBy(F.desc("year"))))
