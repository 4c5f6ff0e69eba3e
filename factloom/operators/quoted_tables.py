"""Tables read from a quote or a chunk alone: which cell carries a claim, and which one a proposed row means.

Texts are read once, whatever number of claims cite them: each cell with a
number becomes a row with its row's labels and the headers above it, and claims
meet cells by quote and number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.frames import computed
from factloom.functions.text import plain, qualifiers, squeezed
from factloom.operators.chunking import cells
from factloom.operators.datasets import fold, names_rate, unit_supported, unit_words
from factloom.operators.quotes import letters, stated

# Words for groups and residences in a table, the order of residence columns, numbers in a cell.
SEXES = ("persons", "male", "female", "males", "females")
RESIDENCES = ("total", "rural", "urban")
CATEGORIES = ("persons", "person", "male", "female")
NUMBER = r"(?<![\w.])[-+]?[0-9][0-9,]*(?:\.[0-9]+)?(?!\w)"
#: The axes of a match in the order in which they are told.
AXES = ("label", "value", "metric", "year", "residence", "population", "series", "unit")


def _years(numbers: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(numbers, lambda n: n.between(1900, 2099)), lambda n: n.cast("int")))


def _said(words: Column, known: tuple[str, ...]) -> Column:
    return F.array_intersect(words, F.array(*map(F.lit, known)))


def _within(wanted: Column, words: Column) -> Column:
    return F.size(F.array_except(wanted, words)) == 0


# --- what a quote's own table says ------------------------------------------


def _read(quotes: DataFrame) -> DataFrame:
    """Quotes with ``rows``: the piped lines as ``cells, numbers, kind``; rules and rows of column numbers are ``none``."""
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\*\*|__", ""))
    split = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|", -1), bare)
    q = computed(quotes, lines=F.transform(F.filter(F.split("quote", "\n", -1), lambda x: F.trim(x).startswith("|")), split))
    q = computed(q, rows=F.transform("lines", lambda cs: F.struct(cs.alias("cells"), F.transform(cs, stated).alias("numbers"))))

    def kind(r: Column) -> Column:
        filled = F.filter(r["cells"], lambda c: c != "")
        ordinal = filled == F.transform(F.sequence(F.lit(1), F.size(r["cells"])), lambda k: k.cast("string"))
        numbers = F.flatten(r["numbers"])
        rule = F.forall(r["cells"], lambda c: c.rlike(r"^[:\-\s]*$"))
        return F.when(rule | ordinal, "none").when(F.forall(numbers, lambda n: n.between(1900, 2099) & (n == F.floor(n))), "head").otherwise("data")

    return q.withColumn("rows", F.transform("rows", lambda r: F.struct(r["cells"].alias("cells"), r["numbers"].alias("numbers"), kind(r).alias("kind"))))


def quoted_cells(quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``quote_id, quote_words, n_rows`` of quotes (``quote_id, quote``), and their cells with numbers: ``quote_id, numbers, label_words, context_words, years``.

    A blank header cell goes on with what is left of it in its row.  The years
    of a cell are those of the headers above it and those that stand left of it
    in its own row, for years may run down a table; in a label only where no
    header tells one.
    """
    q = _read(quotes.select("quote_id", "quote"))
    told = q.select("quote_id", letters(F.col("quote")).alias("quote_words"), F.size("rows").alias("n_rows"))
    heads = F.filter(F.transform("rows", lambda r, i: F.struct(i.alias("row"), r["cells"].alias("cells"), r["kind"].alias("kind"))), lambda h: h["kind"] == "head")
    each = computed(q.select("quote_id", "rows"), heads=heads).select("quote_id", "heads", F.posexplode("rows").alias("row", "r")).filter("r.kind = 'data'")
    labels = F.array_join(F.filter(F.transform("r.cells", lambda c, j: F.when(F.size(F.get(F.col("r.numbers"), j)) == 0, c)), lambda c: c.isNotNull()), " ")
    each = each.select("quote_id", F.filter("heads", lambda h: h["row"] < F.col("row")).alias("heads"), labels.alias("labels"), "r.cells", F.col("r.numbers").alias("by_cell"), F.posexplode("r.numbers").alias("column", "numbers")).filter(F.size("numbers") > 0)
    above = F.transform("heads", lambda h: F.coalesce(F.try_element_at(F.filter(F.slice(h["cells"], F.lit(1), F.col("column") + 1), lambda c: c != ""), F.lit(-1)), F.lit("")))
    each = computed(each, above=above)
    # The label of a row may hold a number (a block, a ward) that is no year: where headers tell years, only cells without a letter add to them.
    before = F.slice("by_cell", F.lit(1), F.col("column"))
    bare = F.transform(before, lambda ns, j: F.when(~F.get("cells", j).rlike(r"\p{L}"), ns).otherwise(F.array().cast("array<double>")))
    each = computed(each, header_years=_years(stated(F.array_join("above", " "))))
    left = F.flatten(F.when(F.size("header_years") > 0, bare).otherwise(before))
    context = letters(F.concat_ws(" ", "labels", F.array_join("above", " ")))
    out = each.select(
        "quote_id", "numbers", letters(F.col("labels")).alias("label_words"), F.array_union(context, F.transform(context, lambda w: F.regexp_replace(w, "s+$", ""))).alias("context_words"),
        F.array_union("header_years", _years(left)).alias("years"),
    )
    return told, out


def read_claims(claims: DataFrame, quotes: DataFrame) -> DataFrame:
    """``claim_id, quote_id, agrees``: whether a cell of the quote's own table carries the claim on every axis that the table tells.

    ``claims``: ``claim_id, quote_id, claim_text, value, year, population,
    residence, claim_region``.  A quote without a table, and a claim without a
    number, agree.  Group and residence bind where the quote names any, the
    region where the quote has it and it isn't in the cell's row.
    """
    told, held = quoted_cells(quotes)
    words = lambda c: letters(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(F.col("claim_text")))
    c = computed(claims, meant=stated(F.col("claim_text")))
    c = c.select(
        "claim_id", "quote_id",
        F.when(F.col("value").isNotNull(), F.array(F.col("value").cast("double"))).otherwise(F.filter("meant", lambda n: ~(n.between(1900, 2099) & (n == F.floor(n))))).alias("values"),
        F.transform(_said(words("population"), SEXES), lambda w: F.regexp_replace(w, "s+$", "")).alias("sexes"), _said(words("residence"), RESIDENCES).alias("places"),
        F.when(F.col("year").isNotNull(), F.array(F.col("year").cast("int"))).otherwise(_years(F.col("meant"))).alias("of_years"), letters(F.col("claim_region")).alias("region_words"),
    )
    # Words of quotes are many times their bytes in storage, and claims carry many copies: neither is sent to all.
    c = c.join(told.hint("merge"), "quote_id", "left")
    key = lambda n: F.round(n, 6)
    asked = c.filter("n_rows > 0").filter(F.size("values") > 0).withColumn("key", key(F.get("values", F.lit(0))))
    cells_ = held.select("quote_id", F.explode(F.array_distinct(F.transform("numbers", key))).alias("key"), "numbers", "label_words", "context_words", "years")
    met = asked.join(cells_.hint("merge"), ["quote_id", "key"])
    here = lambda known: F.arrays_overlap("quote_words", F.array(*map(F.lit, known)))
    fits = (
        F.forall("values", lambda v: F.exists("numbers", lambda n: F.abs(n - v) < 1e-9))
        & (~here(SEXES) | _within(F.col("sexes"), F.col("context_words")))
        & (~here(RESIDENCES) | _within(F.col("places"), F.col("context_words")))
        & ((F.size("years") == 0) | _within(F.col("of_years"), F.col("years")))
        & (~_within(F.col("region_words"), F.col("quote_words")) | _within(F.col("region_words"), F.col("label_words")))
    )
    good = met.filter(fits).select("claim_id", "quote_id", F.lit(True).alias("carried")).distinct()
    needs = F.coalesce(F.col("n_rows"), F.lit(0)) > 0
    return c.join(good.hint("merge"), ["claim_id", "quote_id"], "left").select("claim_id", "quote_id", (~(needs & (F.size("values") > 0)) | F.coalesce("carried", F.lit(False))).alias("agrees"))


# --- the one cell that a proposed row means ---------------------------------


def _folded_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold(plain(F.coalesce(text, F.lit("")))), F.lit("[a-z0-9]+"), F.lit(0)))


def _filled(r: Column) -> Column:
    """The cells of a row, blanks filled from the left."""
    return F.aggregate(r, F.array().cast("array<string>"), lambda out, c: F.concat(out, F.array(F.when(c != "", c).otherwise(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(""))))))


def _over(filled: Column, j: Column) -> Column:
    """What a filled row says over a column, also beyond its last cell."""
    return F.get(filled, F.least(j, F.size(filled) - 1))


def _lines(evidence: DataFrame, on: list[str]) -> DataFrame:
    """The piped lines of chunks (``on``, ``text, section``): ``on``, ``cs, heads, labels, before, numbers, end``.

    A row is known by its cells with a letter, its ``labels``, and left out
    without any; ``heads`` are the rows above it with blanks filled, ``before``
    is the section and the text through the line.
    """
    e = computed(evidence.select(*on, "text", F.coalesce("section", F.lit("")).alias("section")), lines=F.split("text", "\n", -1))
    piped = lambda line: F.size(F.split(line, r"\|", -1)) > 2
    e = computed(e, rows=F.transform("lines", lambda x: F.when(piped(x), F.transform(cells(x), plain))))
    ends = F.aggregate("lines", F.array().cast("array<int>"), lambda out, x: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(-1)) + F.length(x) + 1)))
    e = computed(e, ends=ends)

    def no_header(r: Column) -> Column:
        filled = F.filter(r, lambda c: c != "")
        rule = F.forall(r, lambda c: c.rlike("^[-:]*$"))
        return rule | ((F.size(filled) >= 2) & (filled == F.transform(F.sequence(F.lit(1), F.size(filled)), lambda k: k.cast("string"))))

    e = computed(e, skips=F.transform("rows", lambda r: F.coalesce(no_header(r), F.lit(True))), filled=F.transform("rows", lambda r: F.when(r.isNotNull(), _filled(r))))
    each = e.select(*on, "text", "section", "rows", "filled", "skips", "ends", F.posexplode("rows").alias("no", "cs")).filter("cs is not null")
    each = computed(each, labels=F.array_distinct(F.transform(F.filter("cs", lambda c: c.rlike(r"\p{L}")), fold))).filter(F.size("labels") > 0)
    # The lines of the same table above a line: those since the last line that is none.
    last = F.array_max(F.filter(F.transform(F.slice("rows", F.lit(1), F.col("no")), lambda r, i: F.when(r.isNull(), i)), lambda i: i.isNotNull()))
    each = computed(each, first=F.coalesce(last + 1, F.lit(0)))
    heads = F.filter(F.transform(F.slice("filled", F.col("first") + 1, F.col("no") - F.col("first")), lambda r, i: F.when(~F.get("skips", i + F.col("first")), r)), lambda r: r.isNotNull())
    each = computed(each, heads=heads, before=F.concat_ws(" ", "section", F.left("text", F.get("ends", F.col("no")))))
    each = computed(each, numbers=F.transform("cs", lambda c: F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))))
    return each.select(*on, "cs", "heads", "labels", "before", "numbers", F.get("ends", F.col("no")).alias("end"))


def _cells(each: DataFrame, on: list[str]) -> DataFrame:
    """Cells with numbers of lines (``on``, ``end, labels, cs, heads, numbers``): ``on``, ``labels, end, raw, number, once, header, header_words, group_place``.

    ``raw`` is each number of a cell, and ``once`` whether its cell has that
    number once.  The header is what stands above in the same table, whatever
    it is, with blanks filled from the left; ``group_place`` is the place of a
    column among three that share a heading in the first line.
    """
    # The first line with its blanks filled is the same for all cells of a line.
    width = F.size("cs")
    each = computed(each, top=F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.when(F.size("heads") > 0, _over(F.get("heads", F.lit(0)), j))))
    each = each.select(*on, "labels", "end", "cs", "heads", "top", F.posexplode("numbers").alias("column", "raws")).filter(F.size("raws") > 0)
    each = computed(each, header=F.array_join(F.filter(F.transform("heads", lambda r: _over(r, F.col("column"))), lambda h: h != ""), " "))
    same = lambda j: F.get("top", j) == F.get("top", F.col("column"))
    left = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.col("column")), lambda j: ~F.coalesce(same(j), F.lit(False)))) + 1, F.lit(0))
    right = F.coalesce(F.array_min(F.filter(F.sequence(F.col("column"), width - 1), lambda j: ~F.coalesce(same(j), F.lit(False)))) - 1, width - 1)
    named = F.coalesce(F.get("top", F.col("column")) != "", F.lit(False))
    each = computed(each, left=left, right=right)
    place = F.when(named & (F.col("right") - F.col("left") == 2), F.col("column") - F.col("left"))
    value = lambda n: F.regexp_replace(n, ",", "").try_cast("decimal(38,10)")
    raw = F.explode(F.array_distinct("raws"))
    each = computed(each, folded=fold(F.col("header")), header_words=_folded_words(F.col("header")))
    out = each.select(*on, "labels", "end", "raws", raw.alias("raw"), F.col("folded").alias("header"), "header_words", place.alias("group_place"))
    equal = F.size(F.filter("raws", lambda r: value(r) == value(F.col("raw"))))
    return out.select("*", value(F.col("raw")).alias("number"), (equal == 1).alias("once")).drop("raws")


#: What a proposal means beside its row and number: few ways, whatever number of proposals.
SCOPE = ("asked_metric", "asked_population", "population", "asked_residence", "residence", "series", "unit")


def _asks(asks: DataFrame) -> DataFrame:
    """Distinct scopes (a struct ``ask``) with what their words say."""
    f = lambda name: F.col(f"ask.{name}")
    groups = lambda c: F.array_sort(_said(_folded_words(c), CATEGORIES))
    order = F.create_map(*[F.lit(x) for k, r in enumerate(RESIDENCES) for x in (r, k)])
    a = computed(asks, of=groups(f("population")), asked_of=groups(f("asked_population")), in_residence=fold(f("asked_residence")))
    return a.select(
        *asks.columns, "in_residence", order[F.col("in_residence")].alias("place"), fold(f("series")).alias("in_series"), fold(f("asked_population")).alias("in_population"), F.trim(F.regexp_replace(unit_words(fold(f("unit"))), "%", "percent")).alias("in_unit"),
        qualifiers(F.concat_ws(" ", f("asked_metric"), F.coalesce(f("asked_population"), F.lit("")))).alias("meant"), _folded_words(f("asked_metric")).alias("metric_words"), _said(_folded_words(f("asked_population")), CATEGORIES).alias("wanted"),
        ((F.size("asked_of") > 0) & (F.size("of") > 0) & (F.col("asked_of") != F.col("of"))).alias("other_group"), (f("residence").isNotNull() & (fold(f("residence")) != F.col("in_residence"))).alias("other_residence"),
    )


def matched_cells(proposals: DataFrame, evidence: DataFrame, dealt: str | None = None) -> DataFrame:
    """``row_id, reason, emptied, n_axes, raw, end``: each proposed row bound to the one cell that it means, or why not.

    ``proposals``: ``row_id, chunk_id, label, value, year, population,
    residence, series, unit`` and what was asked, ``asked_metric, asked_year,
    asked_population, asked_residence, asked_regions``, with ``names_region``
    (rows are regions) and ``needs_group`` (a group must be told);
    ``evidence``: ``chunk_id, text, section, region``.  What is asked must be told, and a
    proposal may not tell another year, group or residence.  Cells are then
    counted axis by axis: ``n_axes`` has how many are left after each, and
    ``emptied`` names the axis that left none.

    Where many proposals are made of one row, deal that row before: ``dealt``
    is then a column that proposals and evidence have, were both dealt by with
    ``spread``, and that is the same for a chunk and all that cite it.  Under
    ``met_as_dealt`` no proposal is shuffled or sorted, and a task holds the
    chunks that it is dealt.
    """
    on = [dealt, "chunk_id"] if dealt else ["chunk_id"]
    # Rows of few bytes in storage become many cells with their context: neither side is small enough to send to all.
    meet = lambda left, right, keys: left.join(right.hint("shuffle_hash" if dealt else "merge"), keys, "left")
    p = proposals.withColumn("ask", F.struct(*SCOPE))
    p = p.drop(*SCOPE)
    beside = evidence.select(*on, F.col("region").isNotNull().alias("known"), fold(F.col("region")).alias("in_region"), qualifiers(F.coalesce("section", F.lit(""))).alias("beside"))
    asked = meet(meet(p, _asks(p.select(on[0], "ask").distinct()), [on[0], "ask"]), beside, on)
    asked = computed(asked, in_label=fold(F.col("label")))
    text = lambda c: F.col(c).cast("string")
    told = (
        F.when(~F.coalesce("known", F.lit(False)), "UNKNOWN_EVIDENCE_ID")
        .when(F.col("names_region") & (F.col("in_label") != F.col("in_region")), "WRONG_REGION_ROW")
        .when((F.size("asked_regions") > 0) & ~F.exists("asked_regions", lambda r: fold(r) == F.col("in_label")), "WRONG_REQUIRED_REGION")
        .when(F.size(F.array_except("beside", "meant")) > 0, "SUBGROUP_TABLE")
        .when(F.col("asked_year").isNull(), "MISSING_AUTHORITATIVE_YEAR")
        .when(F.col("year").isNotNull() & (text("year") != text("asked_year")), "WRONG_YEAR")
        .when(F.col("needs_group") & F.col("ask.asked_population").isNull(), "MISSING_AUTHORITATIVE_POPULATION_SCOPE")
        .when(F.col("needs_group") & F.col("other_group"), "WRONG_POPULATION_SCOPE")
        .when(F.col("ask.asked_residence").isNull(), "MISSING_AUTHORITATIVE_RESIDENCE_SCOPE")
        .when(F.col("other_residence"), "WRONG_RESIDENCE_SCOPE")
    )
    asked = computed(asked, told=told).withColumns({"at_label": F.when(F.col("told").isNull(), F.col("in_label")), "number": F.col("value").cast("decimal(38,10)")})
    lines = _lines(evidence, on)
    # A line's context, as long as its chunk, is held once; cells tell by its end where they stand.
    filled = F.aggregate("numbers", F.lit(0), lambda n, raws: n + F.size(F.array_distinct(raws)))
    around = lines.select(*on, "labels", filled.alias("n"), "end", "before")
    around = computed(around, context=fold(F.col("before")), context_words=_folded_words(F.col("before"))).drop("before")
    around = computed(around, unit_context=unit_words(F.col("context")))
    around = around.withColumn("at_label", F.explode("labels")).groupBy(*on, "at_label").agg(F.sum("n").alias("n_label"), F.collect_list(F.struct("end", "context", "context_words", "unit_context")).alias("around"))
    cells_ = _cells(lines, on)
    cell = F.struct("end", "raw", "once", "header", "header_words", "group_place")
    hits = cells_.withColumn("at_label", F.explode("labels")).groupBy(*on, "at_label", "number").agg(F.collect_list(cell).alias("hits"))
    # Contexts come last, so that no exchange carries them.
    met = meet(meet(asked, hits, [*on, "at_label", "number"]), around, [*on, "at_label"])

    def held(h: Column) -> Column:
        """How many axes a cell of the label with the value holds on, one after the other."""
        line = F.get(F.filter("around", lambda x: x["end"] == h["end"]), F.lit(0))
        by_place = F.coalesce(h["group_place"] == F.col("place"), F.lit(False))
        untold = F.array_except("metric_words", h["header_words"])
        shown = _said(h["header_words"], CATEGORIES)
        in_context = F.when(F.size("wanted") > 0, _within(F.col("wanted"), line["context_words"])).otherwise(F.contains(line["context"], F.col("in_population")))
        # A context is put in the words of units once; only where "per cent" begins in the header and ends in it, both are read together.
        parted = ~(h["header"].endswith("per") & line["context"].startswith("cent"))
        told_unit = F.contains(F.concat_ws(" ", unit_words(h["header"]), line["unit_context"]), F.col("in_unit")) | ((F.col("in_unit") == "percent") & names_rate(h["header"]))
        in_unit = F.when(parted, told_unit).otherwise(unit_supported(F.col("ask.unit"), h["header"], line["context"]))
        axes = {
            "metric": (F.size(untold) == 0) | _within(untold, line["context_words"]),
            "year": F.array_contains(h["header_words"], text("asked_year")),
            "residence": F.contains(h["header"], F.col("in_residence")) | by_place,
            "population": ~F.col("needs_group") | (((F.size(shown) == 0) | _within(F.col("wanted"), shown)) & in_context),
            "series": (F.coalesce("ask.series", F.lit("")) == "") | F.contains(h["header"], F.col("in_series")) | ((F.col("in_series") == F.col("in_residence")) & by_place),
            "unit": F.col("ask.unit").isNull() | in_unit,
        }
        # The first two axes are the label and the value.
        return reduce(lambda c, a: c.when(~F.coalesce(axes[a], F.lit(False)), AXES.index(a)), AXES[3:], F.when(~F.coalesce(axes["metric"], F.lit(False)), AXES.index("metric"))).otherwise(len(AXES))

    empty = F.array().cast("array<struct<held:int,once:boolean,raw:string,end:int>>")
    met = computed(met, found=F.coalesce(F.transform("hits", lambda h: F.struct(held(h).alias("held"), h["once"].alias("once"), h["raw"].alias("raw"), h["end"].alias("end"))), empty))
    met = computed(met, full=F.filter("found", lambda h: (h["held"] == len(AXES)) & h["once"]), most=F.coalesce(F.array_max(F.transform("found", lambda h: h["held"])), F.lit(1)))
    n_label = F.coalesce("n_label", F.lit(0)).cast("long")
    left = [n_label, *[F.size(F.filter("found", lambda h, k=k: h["held"] > k)).cast("long") for k in range(1, len(AXES))]]
    emptied = F.when(n_label == 0, AXES[0]).otherwise(F.get(F.array(*map(F.lit, AXES)), F.col("most")))
    reason = F.coalesce("told", F.when(F.size("full") == 0, "UNSUPPORTED_OR_WRONG_TABLE_CELL").when(F.size("full") > 1, "AMBIGUOUS_TABLE_CELL"))
    one = F.when(reason.isNull(), F.get("full", F.lit(0)))
    return met.select("row_id", reason.alias("reason"), F.when(F.col("told").isNull() & (F.size("full") == 0), emptied).alias("emptied"), F.array(*left).alias("n_axes"), one["raw"].alias("raw"), one["end"].alias("end"))
