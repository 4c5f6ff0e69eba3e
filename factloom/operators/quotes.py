"""Quotes that carry claims: the checks a quote must pass, the stretch of a chunk that passes them, and how it is shown.

A pair of claim and evidence is a row with ``claim_id, evidence_id, claim_text,
value, year, metric, population, residence, unit, claim_region`` and the
evidence's ``text, region, context`` (title and section path in words).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.frames import computed

MOST_CHARS, DEFAULT_YEAR = 1600, 2011
# Words that name a metric or a category, and the order in which reasons are told.
METRIC_TERMS = ("literacy", "population", "density", "worker", "workers", "ratio", "growth")
CATEGORY_TERMS = ("rural", "urban", "male", "males", "female", "females", "persons")
REASONS = ("TABLE_CELL_SCOPE_MISMATCH", "VALUE_ABSENT", "YEAR_ABSENT", "METRIC_ABSENT", "POPULATION_SCOPE_ABSENT", "RESIDENCE_SCOPE_ABSENT", "CATEGORY_ABSENT", "UNIT_ABSENT", "REGION_METADATA_MISMATCH", "REGION_ABSENT", "QUOTE_TOO_LONG")
NUMBER = r"(?<![0-9,])[0-9][0-9,]*(?:\.[0-9]+)?(?![0-9])"
SENTENCE = r"\s*[^\s][^\n]*?(?:[.!?](?=\s|\z)|(?=\n)|\z)"


def letters(text: Column) -> Column:
    """The distinct words of a text without tags and emphasis."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", ""), r"\*\*|__", "")
    return F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit("[a-z]+"), F.lit(0)))


def stated(text: Column) -> Column:
    """The numbers of a text, commas dropped."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda n: F.regexp_replace(n, ",", "").cast("double"))


def _years(numbers: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(numbers, lambda n: n.between(1900, 2099)), lambda n: n.cast("int")))


def _holds(words: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, words)) == 0


def judged_quotes(pairs: DataFrame, default_year: int = DEFAULT_YEAR) -> DataFrame:
    """Pairs with a ``quote`` and, where known, ``cell_agrees`` and ``year_confirmed``, plus the first ``reason`` why it does not carry the claim, or null.

    A quote without any year speaks of the default year.  ``cell_agrees`` tells
    whether the cell with the value agrees with the claim; ``year_confirmed``
    that the table's own column is of the claim's year.
    """
    told = lambda name, other: F.coalesce(F.col(name), F.lit(other)) if name in pairs.columns else F.lit(other)
    claim, low = F.col("claim_text"), lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    p = computed(pairs, said=stated(F.col("quote")), meant=stated(claim), quoted=letters(F.col("quote")), around=letters(F.concat_ws(" ", "context", "region")), claimed=letters(claim))
    plain = F.filter("meant", lambda n: ~n.between(1900, 2099))
    p = computed(
        p,
        wanted=F.when(F.col("value").isNotNull(), F.array(F.col("value").cast("double"))).otherwise(plain),
        of_years=F.when(F.col("year").isNotNull(), F.array(F.col("year").cast("int"))).otherwise(_years(F.col("meant"))),
        quote_years=_years(F.col("said")),
        known=F.array_union("quoted", "around"),
        terms=F.array_intersect(F.when(low("metric") != "", letters(F.regexp_replace("metric", "_", " "))).otherwise(F.col("claimed")), F.array(*map(F.lit, METRIC_TERMS))),
        group_words=F.transform(letters(F.col("population")), lambda w: F.when(w == "children", "child").otherwise(w)),
        categories=F.array_intersect("claimed", F.array(*map(F.lit, CATEGORY_TERMS))),
    )
    has = lambda *words: _holds(F.col("known"), F.array(*map(F.lit, words)))
    values = F.forall("wanted", lambda x: F.exists("said", lambda y: F.abs(x - y) < 1e-9))
    by_default = (F.size("quote_years") == 0) & (F.col("of_years") == F.array(F.lit(default_year)))
    group = _holds(F.col("known"), F.col("group_words")) | ((low("population") == "persons") & has("literates", "age"))
    place = _holds(F.col("known"), letters(F.col("residence"))) | ((low("residence") == "total") & has("state"))
    percent = F.coalesce(F.col("unit"), F.when(F.arrays_overlap("claimed", F.array(F.lit("percent"), F.lit("percentage"))) | F.contains(claim, F.lit("%")), "percent"))
    shown = F.arrays_overlap("quoted", F.array(*map(F.lit, ("percent", "percentage", "cent", "rate")))) | F.contains("quote", F.lit("%"))
    blank = lambda c: low(c) == ""
    reason = (
        F.when(F.trim(F.coalesce("quote", F.lit(""))) == "", "EMPTY_QUOTE")
        .when(~F.contains("text", "quote"), "NON_CONTIGUOUS_QUOTE")
        .when(~told("cell_agrees", True), "TABLE_CELL_SCOPE_MISMATCH")
        .when(~values, "VALUE_ABSENT")
        .when(~_holds(F.col("quote_years"), F.col("of_years")) & ~by_default & ~told("year_confirmed", False), "YEAR_ABSENT")
        .when(~_holds(F.col("known"), F.col("terms")), "METRIC_ABSENT")
        .when(~blank("population") & ~group, "POPULATION_SCOPE_ABSENT")
        .when(~blank("residence") & ~place, "RESIDENCE_SCOPE_ABSENT")
        .when(blank("population") & blank("residence") & ~_holds(F.col("known"), F.col("categories")), "CATEGORY_ABSENT")
        .when(percent.isin("percent", "percentage_points") & ~shown, "UNIT_ABSENT")
        .when(~blank("claim_region") & (low("claim_region") != low("region")), "REGION_METADATA_MISMATCH")
        .when(~blank("claim_region") & ~_holds(F.col("known"), letters(F.col("claim_region"))), "REGION_ABSENT")
    )
    return p.withColumn("reason", reason).withColumn("shared", F.size(F.array_intersect("claimed", "quoted"))).select(*pairs.columns, "reason", "shared")


def _pieces(pairs: DataFrame, pattern: str) -> DataFrame:
    """Pairs with each match of a pattern that leaves nothing out between matches: ``quote, start, end``, leading white space aside.

    The match stands for the text from here on, so a text is not repeated for
    each of its parts.
    """
    rest = [c for c in pairs.columns if c != "text"]
    found = computed(pairs, __pieces=F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    # Where a piece ends is told within its row, so pairs are not dealt out for it.
    ends = F.aggregate("__pieces", F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(x))))
    each = computed(found, __ends=ends).select(*rest, F.inline(F.arrays_zip(F.col("__pieces").alias("piece"), F.col("__ends").alias("end"))).alias("piece", "end"))
    quote = F.regexp_replace("piece", r"^\s+", "")
    return each.withColumn("quote", quote).withColumn("start", F.col("end") - F.length("quote")).withColumn("text", F.col("quote")).drop("piece")


def selected_spans(pairs: DataFrame, default_year: int = DEFAULT_YEAR) -> DataFrame:
    """``claim_id, evidence_id, match_type, start, end, reason``: the stretch of each evidence text that carries its claim.

    A table's stretch comes first: from its first line through the first line
    with all numbers of the claim, or from a later line if that is too long.
    Else the sentence that shares most words with the claim, the earliest of
    equals.  If none passes, the reason is the first that any candidate met.
    """
    p = computed(pairs, nums=F.when(F.col("value").isNotNull(), F.array(F.col("value").cast("double"))).otherwise(F.filter(stated(F.col("claim_text")), lambda n: ~n.between(1900, 2099))))
    lines = _pieces(p.filter(F.contains("text", F.lit("|"))), r"[^\n]*\n|[^\n]+\z").filter(F.col("quote").startswith("|"))
    lines = computed(lines, has=stated(F.col("quote")))
    all_in = (F.size("nums") > 0) & F.forall("nums", lambda x: F.exists("has", lambda y: F.abs(x - y) < 1e-9))
    key = ["claim_id", "evidence_id"]
    goal = lines.filter(all_in).groupBy(*key).agg(F.min("end").alias("until"))
    starts = lines.join(goal, key).filter("end <= until").groupBy(*key, "until").agg(F.min("start").alias("first"), F.min(F.when(F.col("until") - F.col("start") <= MOST_CHARS, F.col("start"))).alias("late"), F.max("start").alias("own"))
    begin = F.when(F.col("until") - F.col("first") <= MOST_CHARS, F.col("first")).otherwise(F.coalesce("late", "own"))
    table = starts.select(*key, begin.alias("start"), F.col("until").alias("end")).join(p, key)
    table = judged_quotes(table.withColumn("quote", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))), default_year)
    prose = _pieces(p.drop("year_confirmed"), SENTENCE).filter(~F.col("quote").startswith("|"))
    prose = judged_quotes(prose, default_year).withColumn("reason", F.when(F.length("quote") > MOST_CHARS, "QUOTE_TOO_LONG").otherwise(F.col("reason")))
    cols = [*key, "start", "end", "reason", "shared"]
    # Each pair has a row of no match, so that pairs without a candidate are told by the same grouping.
    bare = pairs.select(*key, *[F.lit(None).cast(prose.schema[c].dataType).alias(c) for c in cols[2:]], F.lit(None).cast("string").alias("match_type"))
    both = table.select(*cols, F.lit("table").alias("match_type")).unionByName(prose.select(*cols, F.lit("prose").alias("match_type"))).unionByName(bare)
    rank = reduce(lambda c, k: c.when(F.col("reason") == REASONS[k], k), range(1, len(REASONS)), F.when(F.col("reason") == REASONS[0], 0)).otherwise(len(REASONS))
    order = F.struct((F.col("match_type") == "prose").cast("int").alias("a"), (-F.col("shared") * (F.col("match_type") == "prose").cast("int")).alias("b"), F.col("start").alias("c"))
    best = both.groupBy(*key).agg(F.min_by(F.struct("match_type", "start", "end"), F.when(F.col("reason").isNull() & F.col("match_type").isNotNull(), order)).alias("span"), F.min_by("reason", F.when(F.col("reason").isNotNull(), rank)).alias("worst"))
    return best.select(*key, F.coalesce("span.match_type", F.lit("none")).alias("match_type"), "span.start", "span.end", F.when(F.col("span").isNull(), F.coalesce("worst", F.lit("NO_CANDIDATE_SPAN"))).alias("reason"))


def rendered(title: Column, page: Column, section: Column, snippet: Column) -> Column:
    """A citation as readers see it."""
    path = F.array_join(section, " > ")
    return F.concat(F.lit("["), title, F.lit(", p. "), page.cast("string"), F.when(path != "", F.concat(F.lit("; "), path)).otherwise(""), F.lit(" — “"), snippet, F.lit("”]"))


def parted(every: Column, supported: Column, unsupported: Column) -> Column:
    """Whether two lists part a third: nothing is in both, and all is in one."""
    return (F.size(F.array_intersect(supported, unsupported)) == 0) & (F.size(F.array_except(every, F.array_union(supported, unsupported))) == 0) & (F.size(F.array_except(F.array_union(supported, unsupported), every)) == 0)
