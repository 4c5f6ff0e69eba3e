"""Evidence under a budget: priority, round robin over documents, reserved targets, the gate before an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.chunking import cells

MAX_CHARS, MAX_CHUNKS = 12_000, 12
FLAGS = ("region_match", "metric_match", "year_match", "population_match", "residence_match", "value_present", "unit_match")


def has_state_row(text: Column, region: Column) -> Column:
    """Whether some row of a table has a cell that is the region itself."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.contains(line, F.lit("|")))
    return F.exists(lines, lambda line: F.exists(cells(line), lambda c: F.lower(c) == F.lower(region)))


def unit_known(text: Column) -> Column:
    return F.lower(text).rlike(r"\bper\s+(?:cent|1,?000)\b|%|\b(?:persons|females|males|rate|ratio|count|number)\b")


def prioritised(items: DataFrame) -> DataFrame:
    """Items with their place: a state's own row first, then numbers that are no map or contents page, then the score."""
    numeric = F.col("text").rlike("[0-9]") & ~F.lower("text").rlike(r"\b(?:map|graph|figure|contents)\b")
    order = [F.col("state_row").cast("int").desc(), numeric.cast("int").desc(), F.desc("score"), F.asc("item_id")]
    ranked = items.withColumn("state_row", has_state_row(F.col("text"), F.col("region")))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def packed(items: DataFrame, max_chars: int = MAX_CHARS, max_chunks: int = MAX_CHUNKS, reserve_targets: bool = False) -> DataFrame:
    """``query_id, item_id, kept, reason``: what fits, taken in rounds of one item for each document; and why the rest is left out.

    An item that does not fit loses its turn; a round that adds nothing ends
    it.  With ``reserve_targets`` the best item of each ``target`` is taken
    before the rounds.
    """
    places = prioritised(items)
    by_doc = Window.partitionBy("query_id", "document_id")
    turn = F.row_number().over(by_doc.orderBy("place"))
    first = F.min("place").over(by_doc)
    reserved = F.lit(False)
    if reserve_targets:
        best = F.row_number().over(Window.partitionBy("query_id", "target").orderBy("place"))
        reserved = F.col("target").isNotNull() & (best == 1)
    rows = places.select("query_id", F.when(reserved, F.lit(0)).otherwise(turn).alias("round"), first.alias("first"), "place", "item_id", F.length("text").alias("chars"))
    one = F.struct("round", "first", "place", "item_id", "chars")
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("items"))
    start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n"), F.lit(0).alias("round"), F.lit(True).alias("added"), F.lit(False).alias("over"), F.array().cast("array<bigint>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["round"] != s["round"]
        over = s["over"] | (fresh & ~s["added"])
        fits = ~over & (s["chars"] + x["chars"] <= max_chars) & (s["n"] < max_chunks)
        return F.struct(
            (s["chars"] + F.when(fits, x["chars"]).otherwise(0)).alias("chars"), (s["n"] + fits.cast("int")).alias("n"), x["round"].alias("round"),
            F.when(fresh, fits).otherwise(s["added"] | fits).alias("added"), over.alias("over"), F.when(fits, F.concat(s["kept"], F.array(x["item_id"].cast("bigint")))).otherwise(s["kept"]).alias("kept"),
        )

    done = lists.select("query_id", "items", F.aggregate("items", start, step, lambda s: s["kept"]).alias("kept"))
    kept = F.array_contains("kept", F.col("i.item_id").cast("bigint"))
    return done.select("query_id", F.explode("items").alias("i"), "kept").select("query_id", F.col("i.item_id").alias("item_id"), kept.alias("kept"), F.when(~kept, "budget_or_chunk_limit").alias("reason"))


def unfit_targets(items: DataFrame, targets: DataFrame, max_chars: int = MAX_CHARS, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """``query_id, reason`` of requests whose required targets can't all be reserved: more of them than chunks, or best items beyond the budget.

    A target without any item is skipped.
    """
    places = prioritised(items).join(targets.select("query_id", "target"), ["query_id", "target"])
    best = places.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "target").orderBy("place"))).filter("nth = 1")
    sums = targets.groupBy("query_id").agg(F.count("*").alias("n")).join(best.groupBy("query_id").agg(F.sum(F.length("text")).alias("chars")), "query_id", "left")
    return sums.select("query_id", F.when(F.col("n") > max_chunks, "TOO_MANY_TARGETS").when(F.col("chars") > max_chars, "TARGET_DOES_NOT_FIT").alias("reason")).filter("reason is not null")


def gate(assessments: DataFrame) -> DataFrame:
    """``query_id, sufficient``: every target has direct evidence, on which all flags agree, and the assessor says enough.

    ``assessments`` has ``query_id, target, relevance, model_sufficient, text`` and the flags.
    """
    agrees = F.lit(True)
    for flag in FLAGS:
        agrees = agrees & (F.col(flag) | (unit_known(F.col("text")) if flag == "unit_match" else F.lit(False)))
    direct = F.col("relevance").isin("direct_answer", "compatible_rounding") & agrees
    by_target = assessments.groupBy("query_id", "target").agg(F.bool_or(direct).alias("direct"), F.bool_and("model_sufficient").alias("enough"))
    return by_target.groupBy("query_id").agg((F.bool_and("direct") & F.bool_and("enough")).alias("sufficient"), F.count_if("direct").alias("n_direct"))


def same_members(expected: Column, actual: Column) -> Column:
    return (F.size(F.array_except(expected, actual)) == 0) & (F.size(F.array_except(actual, expected)) == 0)
