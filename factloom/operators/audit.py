"""An independent audit of answers: quotes are read anew, by rules that share nothing with the validators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.frames import computed

# Patterns of groups in order of precedence, the phrase that defines a ratio, residences, years.
DEFINITION = r"(?:females?|women)\s+per\s+[0-9,]+\s+(?:males?|men)"
GROUPS = {"scheduled castes": r"\bscheduled castes?\b", "scheduled tribes": r"\bscheduled tribes?\b", "females": r"\bfemales?\b|\bwomen\b", "males": r"\bmales?\b|\bmen\b", "children": r"\bchild(?:ren)?\b|\b0\s*-\s*6\b"}
RESIDENCES = ("total", "rural", "urban")
YEAR = r"\b(?:19|20)[0-9]{2}\b"
# What the reader of quotes goes by, which is narrower: numbers with borders, rules of three dashes, its own groups.
NUMBER = r"(?<![\w.])-?[0-9][0-9,]*(?:\.[0-9]+)?(?!\w)"
RULE = r"^(?::?-{3,}:?)?$"
READ_DEFINITION = r"females?\s+per\s+[0-9,]+\s+males?"
READ_GROUPS = {"females": r"\bfemales?\b", "males": r"\bmales?\b", "scheduled castes": r"\bscheduled castes?\b", "scheduled tribes": r"\bscheduled tribes?\b", "children": r"\bchild\b|\b0\s*-\s*6\b"}


def label(text: Column) -> Column:
    """Letters alone, in lower case, tags aside: how names are compared."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")), "[^a-z]", "")


def whole_number(cell: Column) -> Column:
    """The value of a cell that is a number as a whole, as a decimal."""
    bare = F.regexp_replace(cell, "[, ]", "")
    return F.when(bare.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"), bare.try_cast("decimal(38,12)"))


def exact(value: Column) -> Column:
    """A figure as the decimal that its shortest form says."""
    return value.cast("double").cast("string").cast("decimal(38,12)")


def half_unit(value: Column) -> Column:
    """Half a unit of the last digit of a figure, as a decimal."""
    text = F.regexp_replace(F.regexp_replace(exact(value).cast("string"), "0+$", ""), r"\.$", "")
    return F.concat(F.lit("0."), F.repeat(F.lit("0"), F.length(F.regexp_extract(text, r"\.([0-9]+)$", 1))), F.lit("5")).cast("decimal(38,12)")


def scopes(claims: DataFrame) -> DataFrame:
    """Claims with what they are about: ``s_region, s_metric, s_year, s_residence, s_group``, from fields first and text second."""
    low = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), DEFINITION, " ")
    c = computed(claims, low=low, described=F.concat_ws(" ", F.regexp_replace(F.lower(F.coalesce("population", F.lit(""))), DEFINITION, " "), low))
    years = F.array_distinct(F.regexp_extract_all("low", F.lit(YEAR), F.lit(0)))
    residence = F.lower(F.coalesce("residence", F.lit("")))
    group = reduce(lambda a, g: a.when(F.col("described").rlike(GROUPS[g]), g), list(GROUPS)[1:], F.when(F.col("described").rlike(GROUPS["scheduled castes"]), "scheduled castes"))
    return c.select(
        *claims.columns,
        label(F.col("region")).alias("s_region"),
        F.concat_ws(" ", F.lower(F.coalesce("metric", F.lit(""))), "low").alias("s_metric"),
        F.coalesce("year", F.when(F.size(years) == 1, F.get(years, F.lit(0)).cast("int"))).alias("s_year"),
        F.when(residence.isin(*RESIDENCES), residence).when(F.contains("low", F.lit("rural")), "rural").when(F.contains("low", F.lit("urban")), "urban").otherwise("total").alias("s_residence"),
        group.alias("s_group"),
    )


def _cells(line: Column) -> Column:
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|", -1), clean)


def locations(quotes: DataFrame) -> DataFrame:
    """Every place in a quote where a claim's value is on a row or line about its region: ``claim_id, quote_id, kind, header``.

    ``quotes``: ``claim_id, quote_id, value, region, snippet, context``.  Rows
    above the rule are headers, and so are rows right below it whose first two
    cells are empty; a header cell goes on over blank ones.
    """
    q = quotes.withColumn("wanted", label(F.col("region"))).withColumn("within", half_unit(F.col("value"))).withColumn("figure", exact(F.col("value")))
    lines = q.select("*", F.posexplode(F.split("snippet", r"\n", -1)).alias("no", "line")).withColumn("piped", F.trim("line").startswith("|"))
    key = ["claim_id", "quote_id"]
    order = Window.partitionBy(*key).orderBy("no")
    t = computed(lines.filter("piped"), cells=_cells(F.col("line")))
    rule = F.forall("cells", lambda c: c.rlike(RULE))
    ordinal = (F.size("cells") > 2) & F.forall(F.transform("cells", lambda c, i: c == (i + 1).cast("string")), lambda ok: ok)
    first_rule = F.min(F.when(F.col("rule"), F.col("no"))).over(Window.partitionBy(*key))
    t = t.withColumn("rule", rule).withColumn("ordinal", ordinal).withColumn("rule_no", first_rule)
    blank = (F.size("cells") > 2) & (F.get("cells", F.lit(0)) == "") & (F.get("cells", F.lit(1)) == "")
    body = F.col("rule_no").isNull() | (F.col("no") > F.col("rule_no"))
    t = t.withColumn("data", body & ~F.col("ordinal") & ~(blank & F.col("rule_no").isNotNull()))
    seen = F.coalesce(F.max(F.col("data").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = ~F.col("ordinal") & blank & F.col("rule_no").isNotNull() & (seen == 0)
    t = t.withColumn("head", F.when(body, below).otherwise(F.col("no") < F.col("rule_no"))).withColumn("data", body & ~F.col("ordinal") & ~F.col("head"))
    cell = F.posexplode("cells").alias("column", "cell")
    each = t.select("*", cell)
    left = Window.partitionBy(*key, "no").orderBy("column")
    heads = each.filter("head").withColumn("shown", F.last(F.when(F.col("cell") != "", F.col("cell")), ignorenulls=True).over(left)).filter("shown is not null")
    paths = heads.groupBy(*key, "column").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("no", "shown"))), lambda x: x["shown"])), " ").alias("header"))
    named = (F.col("wanted") == "") | F.exists("cells", lambda c: c.rlike("[A-Za-z]") & (label(c) == F.col("wanted")))
    hits = each.filter("data").filter(named & (F.abs(whole_number(F.col("cell")) - F.col("figure")) <= F.col("within")))
    table = hits.join(paths, [*key, "column"], "left").select(*key, F.lit("table").alias("kind"), F.coalesce("header", F.lit("")).alias("header"), "context")
    said = F.exists(F.regexp_extract_all("line", F.lit(NUMBER), F.lit(0)), lambda n: F.abs(whole_number(n) - F.col("figure")) <= F.col("within"))
    prose = lines.filter(~F.col("piped")).filter(((F.col("wanted") == "") | F.contains(label(F.col("line")), F.col("wanted"))) & said)
    return table.unionByName(prose.select(*key, F.lit("prose").alias("kind"), F.lit("").alias("header"), "context"))


def conflicts(header: Column, context: Column, year: Column, residence: Column, group: Column) -> Column:
    """Where a quote's own headers contradict a claim: any of year, residence, group."""
    low = F.lower(header)
    years = F.array_distinct(F.regexp_extract_all(low, F.lit(YEAR), F.lit(0)))
    named = F.array_compact(F.array(*[F.when(low.rlike(rf"\b{r}\b"), F.lit(r)) for r in RESIDENCES]))
    around = F.regexp_replace(F.concat_ws(" ", low, F.lower(context)), READ_DEFINITION, " ")
    groups = F.array_compact(F.array(*[F.when(around.rlike(p), F.lit(g)) for g, p in READ_GROUPS.items()]))
    wrong_year = year.isNotNull() & (F.size(years) == 1) & (F.get(years, F.lit(0)).cast("int") != year)
    wrong_group = (F.size(groups) > 0) & ~F.coalesce(F.array_contains(groups, group), F.lit(False))
    return F.array_compact(F.array(F.when(wrong_year, "YEAR"), F.when((F.size(named) == 1) & (F.get(named, F.lit(0)) != residence), "RESIDENCE"), F.when(wrong_group, "GROUP")))


def support(claims: DataFrame, quotes: DataFrame) -> DataFrame:
    """``claim_id, n_locations, reason``: a claim is supported if some place of a cited quote holds its value without a conflict.

    ``claims``: ``claim_id, text, metric, region, year, residence, population,
    value``; ``quotes``: ``claim_id, quote_id, snippet, context``.  Claims
    without a value need none.
    """
    s = scopes(claims)
    found = locations(quotes.join(claims.select("claim_id", "value", "region").filter("value is not null"), "claim_id"))
    met = found.join(s.select("claim_id", "s_year", "s_residence", "s_group"), "claim_id")
    against = met.withColumn("against", conflicts(F.col("header"), F.col("context"), F.col("s_year"), F.col("s_residence"), F.col("s_group")))
    sums = against.groupBy("claim_id").agg(F.count("*").alias("n"), F.bool_or(F.size("against") == 0).alias("ok"), F.min(F.array_join("against", ",")).alias("first"))
    reason = F.when(F.col("value").isNull(), None).when(F.col("n").isNull(), "VALUE_NOT_ON_A_ROW_OF_ITS_REGION").when(~F.col("ok"), F.concat(F.lit("CONTRADICTED_"), F.col("first")))
    return claims.select("claim_id", "value").join(sums, "claim_id", "left").select("claim_id", F.coalesce("n", F.lit(0)).alias("n_locations"), reason.alias("reason"))


def legacy_verdict(results: DataFrame) -> Column:
    """The verdict of a result recorded before there were verdicts, from its ``error_code, outcome, passed, category, n_ungrounded, n_arithmetic``."""
    refusal = F.col("category") == "refusal"
    return (
        F.when(F.col("error_code").isNotNull() | (F.col("outcome") == "error"), "error")
        .when(F.col("passed"), "passed")
        .when((F.col("outcome") == "refused") & ~refusal, "false_refusal")
        .when(F.col("n_ungrounded") > 0, "unsupported")
        .when(refusal | (F.col("n_arithmetic") > 0), "wrong_answer")
        .otherwise("incomplete")
    )


def last_attempts(attempts: DataFrame, retryable: tuple[str, ...] = ("PROVIDER_RATE_LIMITED", "PROVIDER_TIMEOUT", "PROVIDER_UNAVAILABLE")) -> DataFrame:
    """The attempt that counts for each ``case_id, repeat``: the first, or the second if the first failed in a way that passes."""
    again = Window.partitionBy("case_id", "repeat").orderBy("attempt")
    ended = (F.col("attempt") >= 2) | F.col("error_code").isNull() | ~F.col("error_code").isin(*retryable)
    return attempts.withColumn("ended", ended).filter("ended").withColumn("nth", F.row_number().over(again)).filter("nth = 1").drop("ended", "nth")


def rescored(responses: DataFrame, recorded: DataFrame) -> DataFrame:
    """Responses to score anew with the latency and attempts that were recorded for them, by case and repeat."""
    r = responses.withColumn("repeat", F.coalesce("repeat", F.lit(1)))
    return r.join(recorded.select("case_id", "repeat", "latency", "attempts"), ["case_id", "repeat"], "left").fillna({"latency": 0.0, "attempts": 1})


def item_scores(results: DataFrame) -> DataFrame:
    """Scores of each result as rows ``repeat, case_id, name, value``, in one partition for each repeat if written by it."""
    scores = {"passed": (F.col("verdict") == "passed").cast("double"), "claims": F.col("n_claims").cast("double"), "latency_seconds": F.col("latency").cast("double")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in scores.items()]))
    return results.select("repeat", "case_id", each.alias("s")).select("repeat", "case_id", "s.name", "s.value")


def ungrounded(answers: DataFrame, claims: DataFrame, citations: DataFrame, trusted: DataFrame) -> DataFrame:
    """``answer_id, code``: answers that break an assertion: they lack claims, cite what was not validated as it stands, or cite nothing known.

    ``answers``: ``answer_id, refusal``; ``claims``: ``answer_id, claim_id,
    citation_ids``; ``citations`` and ``trusted``: ``answer_id, citation_id,
    document_id, page_number, chunk_id, snippet``.
    """
    fields = ("document_id", "page_number", "chunk_id", "snippet")
    live = answers.filter(~F.col("refusal")).select("answer_id")
    empty = live.join(claims.select("answer_id").distinct(), "answer_id", "left_anti").unionByName(live.join(citations.select("answer_id").distinct(), "answer_id", "left_anti")).distinct().select("answer_id", F.lit("LACKS_CLAIMS_OR_CITATIONS").alias("code"))
    t = trusted.select("answer_id", "citation_id", *[F.col(f).alias(f"t_{f}") for f in fields])
    same = reduce(lambda a, f: a & F.col(f).eqNullSafe(F.col(f"t_{f}")), fields, F.lit(True))
    met = citations.join(live, "answer_id").join(t, ["answer_id", "citation_id"], "left")
    foreign = met.filter(~same).select("answer_id", F.lit("CITATION_NOT_VALIDATED").alias("code"))
    pages = met.filter(F.coalesce(F.col("page_number") < 1, F.lit(True))).select("answer_id", F.lit("PAGE_NOT_ONE_BASED").alias("code"))
    cited = claims.join(live, "answer_id").select("answer_id", F.explode_outer("citation_ids").alias("citation_id"))
    lost = cited.join(citations.select("answer_id", "citation_id"), ["answer_id", "citation_id"], "left_anti").select("answer_id", F.lit("CLAIM_CITES_UNKNOWN").alias("code"))
    return reduce(DataFrame.unionByName, [empty, foreign, pages, lost]).distinct()
