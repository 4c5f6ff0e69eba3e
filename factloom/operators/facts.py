"""Queries over facts: the one column that a request means, rankings, cells of years, arithmetic.

Nothing here raises for a condition of the data: each request gets a row with
``status`` and, if it is refused, a ``reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import RESIDENCES, metric_words, qualifiers

DEFAULT_YEAR = 2011
# Words for the sexes, and the phrase of a ratio's unit.
FEMALE, MALE = ("female", "females", "women", "girls"), ("male", "males", "men", "boys")
RATIO = r"\b\w+\s+per\s+1,?000\s+\w+"


def requests(specs: DataFrame, default_year: int = DEFAULT_YEAR) -> DataFrame:
    """Requests ``spec_id, document_id, metric, year, residence, population, entity_kind`` with what they ask for, in the facts' terms."""
    letters = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    said = letters(F.coalesce("residence", "metric"))
    named = F.array_intersect(F.array(*map(F.lit, RESIDENCES)), said)
    residence = F.when(F.size(named) == 1, F.get(named, F.lit(0))).otherwise("total")
    who = letters(F.regexp_replace(F.lower(F.concat_ws(" ", F.coalesce("population", F.lit("")), "metric")), RATIO, " "))
    has = lambda words: F.arrays_overlap(who, F.array(*map(F.lit, words)))
    group = F.when(has(FEMALE), "females").when(has(MALE), "males").otherwise("persons")
    out = specs.select("*", metric_words(F.col("metric")).alias("wanted"), qualifiers(F.concat_ws(" ", "metric", F.coalesce("population", F.lit("")))).alias("wanted_qualifiers"), F.coalesce("year", F.lit(default_year)).alias("wanted_year"), residence.alias("wanted_residence"), group.alias("wanted_group"))
    return out.withColumn("residence_asked", F.col("wanted_residence") != "total").withColumn("group_asked", F.col("wanted_group") != "persons")


def column_health(columns: DataFrame, rows: DataFrame, facts: DataFrame) -> DataFrame:
    """For each value column: what refuses it, if anything, and a signature of its cells in printed order."""
    bad = ~F.col("aggregate") & (F.col("value").isNull() | F.col("chunk_id").isNull())
    cell = F.when(~F.col("aggregate"), F.struct("page_number", "line", F.lower("entity").alias("entity"), "raw_value"))
    keys = ["document_id", "table_id", "column_index"]
    sums = facts.groupBy(*keys).agg(F.count_if(bad).alias("n_bad"), F.count_if(~F.col("aggregate")).alias("n_entities"), F.xxhash64(F.array_sort(F.transform(F.collect_list(cell), lambda c: F.struct(c["entity"], c["raw_value"])))).alias("signature"))
    malformed = rows.groupBy("document_id", "table_id").agg(F.count_if("malformed").alias("n_malformed"))
    reason = F.when(F.col("n_malformed") > 0, "TABLE_ROWS_MALFORMED").when(F.col("n_bad") > 0, "TABLE_COLUMN_INCOMPLETE").when(F.coalesce("n_entities", F.lit(0)) < 2, "TABLE_TOO_FEW_ENTITIES")
    one = columns.dropDuplicates(keys)
    return one.join(sums, keys, "left").join(malformed, ["document_id", "table_id"], "left").withColumn("column_reason", reason)


def select_columns(specs: DataFrame, health: DataFrame, default_year: int = DEFAULT_YEAR) -> DataFrame:
    """``spec_id, status, reason, table_id, column_index``: one row for each request."""
    asked = requests(specs, default_year)
    c = health.filter("metric is not null").select("document_id", "table_id", "column_index", "entity_kind", F.col("year").alias("c_year"), F.col("residence").alias("c_residence"), "population_group", F.array_sort(F.array_union("qualifiers", qualifiers(F.col("metric")))).alias("c_qualifiers"), metric_words(F.col("metric")).alias("words"), "column_reason", "signature")
    fits = (
        (F.col("c_year") == F.col("wanted_year"))
        & (F.col("c_qualifiers") == F.array_sort("wanted_qualifiers"))
        & (F.size(F.array_except("wanted", "words")) == 0)
        & F.when(F.col("c_residence").isNull(), ~F.col("residence_asked")).otherwise(F.col("c_residence") == F.col("wanted_residence"))
        & F.when(F.col("population_group").isNull(), ~F.col("group_asked")).otherwise(F.col("population_group") == F.col("wanted_group"))
    )
    kind = c.withColumnRenamed("entity_kind", "c_kind")
    met = asked.filter(F.size("wanted") > 0).join(kind, "document_id").filter(fits & (F.col("entity_kind").isNull() | (F.col("c_kind") == F.col("entity_kind"))))
    met = met.withColumn("broader", (F.col("words") != F.col("wanted")).cast("int"))
    met = met.withColumn("best", F.min("broader").over(Window.partitionBy("spec_id"))).filter("broader = best")
    first = F.struct("table_id", "column_index")
    picked = met.groupBy("spec_id").agg(F.countDistinct("words").alias("n_metrics"), F.countDistinct("signature").alias("n_values"), F.min(F.when(F.col("column_reason").isNotNull(), F.struct("table_id", "column_index", "column_reason"))).alias("flaw"), F.min(first).alias("pick"))
    reason = F.when(F.size("wanted") == 0, "TABLE_METRIC_UNRECOGNIZED").when(F.col("pick").isNull(), "TABLE_NO_MATCHING_COLUMN").when(F.col("n_metrics") > 1, "TABLE_AMBIGUOUS_COLUMN").when(F.col("flaw").isNotNull(), F.col("flaw.column_reason")).when(F.col("n_values") > 1, "TABLE_AMBIGUOUS_COLUMN")
    out = asked.join(picked, "spec_id", "left").withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return out.select("spec_id", "document_id", F.when(ok, "ok").otherwise("refused").alias("status"), "reason", F.when(ok, F.col("pick.table_id")).alias("table_id"), F.when(ok, F.col("pick.column_index")).alias("column_index"))


def selected_facts(selection: DataFrame, facts: DataFrame) -> DataFrame:
    """All facts of the selected columns, under their requests."""
    return selection.filter("status = 'ok'").select("spec_id", "document_id", "table_id", "column_index").join(facts, ["document_id", "table_id", "column_index"])


def still_cited(facts: DataFrame, chunks: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """Facts with ``stale``: whether their chunk is gone, has moved, or no longer has the line; withdrawn documents are dropped."""
    now = chunks.select("chunk_id", F.col("document_id").alias("__doc"), F.col("page_number").alias("__page"), F.split("text", "\n", -1).alias("__lines"))
    if withdrawn is not None:
        facts = facts.join(withdrawn.select("document_id"), "document_id", "left_anti")
    # Texts of chunks are many times their bytes in storage: they are not sent to all.
    joined = facts.join(now.hint("merge"), "chunk_id", "left")
    fresh = (F.col("__doc") == F.col("document_id")) & (F.col("__page") == F.col("page_number")) & F.array_contains("__lines", F.col("line"))
    return joined.withColumn("stale", ~F.coalesce(fresh, F.lit(False))).drop("__doc", "__page", "__lines")


def ranked(chosen: DataFrame, lowest_first: bool = False) -> DataFrame:
    """Entities of each request in order, without the region's own row; ties share a rank."""
    order = F.col("value").asc() if lowest_first else F.col("value").desc()
    return chosen.filter("not aggregate").withColumn("rank", F.rank().over(Window.partitionBy("spec_id").orderBy(order)))


def ranking_sentence(ranks: DataFrame) -> DataFrame:
    """The winners of each request, all that tie named, in one sentence."""
    top = ranks.filter("rank = 1").groupBy("spec_id").agg(F.array_sort(F.collect_list("entity")).alias("winners"), F.first("metric").alias("metric"), F.first("year").alias("year"), F.first("raw_value").alias("raw_value"))
    names = F.array_join("winners", " and ")
    verb = F.when(F.size("winners") > 1, " tie for the highest ").otherwise(" has the highest ")
    return top.select("spec_id", "winners", F.concat(names, verb, F.lower("metric"), F.lit(" in "), F.col("year").cast("string"), F.lit(": "), F.col("raw_value"), F.lit(".")).alias("sentence"))


def year_cells(scopes: DataFrame, facts: DataFrame, default_population: str = "persons") -> DataFrame:
    """The region's own cell for each year of a scope ``spec_id, region, metric, years, residence``, latest first.

    Refused if a region has not exactly one document, or a year has no such cell.
    """
    asked = scopes.select("spec_id", "region", metric_words(F.col("metric")).alias("wanted"), F.coalesce("residence", F.lit("total")).alias("wanted_residence"), F.explode("years").alias("wanted_year"))
    documents = facts.groupBy("region").agg(F.countDistinct("document_id").alias("n_documents"))
    own = facts.filter(F.col("aggregate") & (F.lower("entity") == F.lower("region")) & F.col("chunk_id").isNotNull() & (F.size("qualifiers") == 0))
    own = own.select(F.col("region").alias("f_region"), metric_words(F.col("metric")).alias("words"), "year", F.coalesce("residence", F.lit("total")).alias("f_residence"), "population_group", "entity", "metric", "raw_value", "value", "unit", "page_number", "chunk_id", "line")
    plain_group = F.coalesce(F.col("population_group"), F.lit(default_population)) == default_population
    met = asked.join(documents, "region", "left").join(own.filter(plain_group), (F.col("n_documents") == 1) & (F.col("region") == F.col("f_region")) & (F.col("wanted") == F.col("words")) & (F.col("wanted_year") == F.col("year")) & (F.col("wanted_residence") == F.col("f_residence")), "left")
    reason = F.when(F.coalesce("n_documents", F.lit(0)) != 1, "TABLE_AMBIGUOUS_DOCUMENT").when(F.col("value").isNull(), "TABLE_STATE_ROW_MISSING")
    out = met.select("spec_id", "region", F.col("wanted_year").alias("year"), "metric", F.col("wanted_residence").alias("residence"), "entity", "raw_value", "value", "unit", "page_number", "chunk_id", "line", reason.alias("reason"))
    return out.withColumn("turn", F.row_number().over(Window.partitionBy("spec_id").orderBy(F.desc("year"))))


def live_cells(cells: DataFrame, chunks: DataFrame) -> DataFrame:
    """Selected cells whose line still stands in their chunk; others are refused as stale, with their value taken out."""
    lines = chunks.select("chunk_id", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line"), F.lit(True).alias("stands"))
    met = cells.join(lines, ["chunk_id", "line"], "left")
    stale = F.col("reason").isNull() & F.col("stands").isNull()
    out = met.withColumn("reason", F.when(stale, "TABLE_STORE_MISSING_OR_STALE").otherwise(F.col("reason")))
    return out.withColumn("value", F.when(F.col("reason").isNull(), F.col("value"))).select(cells.columns)


def difference(left: Column, right: Column) -> Column:
    """Left minus right, half to even at ten places."""
    return F.bround(left.cast("decimal(38,10)") - right.cast("decimal(38,10)"), 10)


def percentage_difference(left: Column, right: Column) -> Column:
    """Of the right; null, to be refused, if that is zero."""
    return F.when(right != 0, F.round((left.cast("double") - right.cast("double")) / right.cast("double") * 100, 6))


def calculations(pairs: DataFrame) -> DataFrame:
    """Results of ``calc_id, operation, left, right``: sum, difference, percentage_difference."""
    result = F.when(F.col("operation") == "sum", F.col("left") + F.col("right")).when(F.col("operation") == "difference", difference(F.col("left"), F.col("right")).cast("double")).when(F.col("operation") == "percentage_difference", percentage_difference(F.col("left"), F.col("right")))
    reason = F.when(~F.col("operation").isin("sum", "difference", "percentage_difference"), "UNKNOWN_OPERATION").when((F.col("operation") == "percentage_difference") & (F.col("right") == 0), "ZERO_BASELINE")
    return pairs.select("*", F.when(reason.isNull(), result).alias("result"), reason.alias("reason"))


def comparison_sentence(a: Column, b: Column, gap: Column, metric: Column, residence: Column) -> Column:
    scope = F.when(residence.isin("rural", "urban"), F.concat(F.lit("In "), residence, F.lit(" areas, "))).otherwise("")
    return F.concat(scope, a, F.lit(" is "), F.when(gap >= 0, "higher").otherwise("lower"), F.lit(" than "), b, F.lit(" by "), F.abs(gap).cast("double").cast("string"), F.lit(" in "), F.lower(metric), F.lit("."))


def components_vs_total(facts: DataFrame) -> DataFrame:
    """For each column with a region's own row: the sum of its entities, and how far it is from the row."""
    keys = ["document_id", "table_id", "column_index", "metric", "year", "residence"]
    return facts.groupBy(*keys).agg(F.sum(F.when(~F.col("aggregate"), F.col("value"))).alias("parts"), F.max(F.when(F.col("aggregate"), F.col("value"))).alias("total")).withColumn("gap", F.col("parts") - F.col("total"))
