"""What clients compute of an answer: calculation cards, previews of quotes, follow-up questions, fragments to mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.frames import computed
from factloom.functions.text import squeezed

SEPARATOR = r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$"
MOST_FRAGMENTS, LEAST_CHARS, MOST_FOLLOW_UPS = 40, 4, 4


def calculation_cards(claims: DataFrame) -> DataFrame:
    """``answer_id, claim_id, n_inputs`` of derived claims whose operands are the values of their input claims, in order, all cited.

    ``claims``: ``answer_id, claim_id, derived, value, operands, result, input_claim_ids, citation_ids``.
    """
    d = claims.filter(F.col("derived") & F.col("result").isNotNull() & (F.size("operands") > 0) & (F.size("operands") == F.size("input_claim_ids")))
    pairs = d.select("answer_id", "claim_id", F.explode(F.arrays_zip("operands", "input_claim_ids")).alias("p")).select("answer_id", "claim_id", "p.*")
    known = claims.filter(~F.col("derived")).select("answer_id", F.col("claim_id").alias("input_claim_ids"), F.col("value").alias("i_value"), F.size("citation_ids").alias("n_cited"))
    met = pairs.join(known, ["answer_id", "input_claim_ids"], "left")
    good = F.coalesce((F.col("i_value") == F.col("operands")) & (F.col("n_cited") > 0), F.lit(False))
    return met.groupBy("answer_id", "claim_id").agg(F.bool_and(good).alias("good"), F.count("*").alias("n_inputs")).filter("good").drop("good")


def _bare(text: Column, breaks: str) -> Column:
    return squeezed(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", breaks), "</?[A-Za-z][^>]*>", ""), r"\*\*", ""))


def snippet_rows(snippet: Column) -> Column:
    """The rows of cells of a quoted table, rules and empty rows left out; none unless two lines have pipes."""
    lines = F.filter(F.transform(F.split(snippet, "\n", -1), lambda x: F.trim(x)), lambda x: x.startswith("|"))
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.regexp_replace(line, r"^\|", ""), r"\|$", ""), r"\|", -1), lambda c: _bare(c, " "))
    rows = F.filter(F.transform(F.filter(lines, lambda x: ~x.rlike(SEPARATOR)), cells), lambda r: F.exists(r, lambda c: c != ""))
    return F.when(F.size(lines) >= 2, rows).otherwise(F.array().cast("array<array<string>>"))


def previews(quotes: DataFrame) -> DataFrame:
    """``quote_id, preview``: a quote in one line; of a table the last row with a digit."""
    q = computed(quotes, rows=snippet_rows(F.col("snippet")))
    digits = F.filter("rows", lambda r: F.exists(r, lambda c: c.rlike("[0-9]")))
    row = F.coalesce(F.try_element_at(digits, F.lit(-1)), F.try_element_at("rows", F.lit(-1)))
    told = F.array_join(F.filter(row, lambda c: c != ""), " · ")
    return q.select("quote_id", F.when(F.size("rows") > 0, told).otherwise(_bare(F.col("snippet"), "")).alias("preview"))


def fragments(snippet: Column) -> Column:
    """What to mark on a page for a quote: its distinct parts between lines and pipes, none short."""
    clean = lambda p: F.regexp_replace(squeezed(F.regexp_replace(F.regexp_replace(p, "</?[A-Za-z][^>]*>", " "), r"[*#_`>]+", " ")), r"^[ :-]+|[ :-]+$", "")
    parts = F.transform(F.split(snippet, r"[\n|]+", -1), clean)
    good = F.filter(parts, lambda t: (F.length(t) >= LEAST_CHARS) & t.rlike("[A-Za-z0-9]"))
    return F.slice(F.array_distinct(good), 1, MOST_FRAGMENTS)


def follow_ups(answers: DataFrame) -> DataFrame:
    """``answer_id, prompts``: questions that an answer leads to, four at most, each once.

    ``answers``: ``answer_id, refusal, metric, regions`` (answered, in order),
    ``library`` (regions there are), ``scoped`` (some claim is of rural or urban
    places), ``has_artifact, n_citations``.
    """
    fold = lambda c: F.lower(c)
    a = answers.withColumn("others", F.filter(F.array_distinct("library"), lambda r: ~F.array_contains(F.transform("regions", fold), F.lower(r))))
    metric = squeezed(F.lower(F.regexp_replace("metric", "_", " ")))
    first, other = F.get("regions", F.lit(0)), F.get("others", F.lit(0))
    one = F.size("regions") == 1
    charted = F.when(F.size("regions") >= 2, F.col("regions")).when(first.isNotNull() & other.isNotNull(), F.array(first, other))
    rules = [
        F.when(one & other.isNotNull(), F.concat(F.lit("How does that compare with "), other, F.lit("?"))),
        F.when(~F.col("has_artifact") & charted.isNotNull(), F.concat(F.lit("Create a bar chart comparing the "), metric, F.lit(" of "), F.array_join(charted, " and "), F.lit("."))),
        F.when(first.isNotNull() & ~F.col("scoped"), F.concat(F.lit("Make a table of the "), metric, F.lit(" of "), first, F.lit(" by rural and urban areas."))),
        F.when(one, F.concat(F.lit("Which district of "), first, F.lit(" had the highest "), metric, F.lit("?"))),
        F.when(~F.col("has_artifact") & (F.col("n_citations") > 0), F.lit("Which source pages support those values?")),
    ]
    told = F.slice(F.array_distinct(F.array_compact(F.array(*rules))), 1, MOST_FOLLOW_UPS)
    region = F.get("library", F.lit(0))
    refused = F.when(region.isNotNull(), F.array(F.concat(F.lit("What was the literacy rate of "), region, F.lit(" in 2011?")), F.concat(F.lit("Summarize the key population findings for "), region, F.lit("."))))
    none = F.array().cast("array<string>")
    return a.select("answer_id", F.when(F.col("refusal"), F.coalesce(refused, none)).when(F.col("metric").isNull(), none).otherwise(told).alias("prompts"))


def sheet_errors(files: DataFrame) -> DataFrame:
    """``file_id, code`` of CSV texts with rows of unequal width or without data."""
    rows = F.filter(F.split("text", "\r?\n", -1), lambda x: x != "")
    width = lambda x: F.size(F.split(F.regexp_replace(x, '"(?:[^"]|"")*"', ""), ",", -1))
    f = computed(files, widths=F.transform(rows, width))
    code = F.when(F.size("widths") < 2, "NO_DATA_ROWS").when(F.size(F.array_distinct("widths")) > 1, "UNEQUAL_WIDTHS")
    return f.select("file_id", code.alias("code")).filter("code is not null")


