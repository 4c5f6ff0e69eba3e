"""Markdown statement tables to typed facts, each bound to the chunk that holds its line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.frames import computed, spread
from factloom.functions.text import GROUPS, PERIOD, RESIDENCES, UNIT, YEAR, parse_number, periods, plain, qualifiers, single_year, squeezed, unit
from factloom.operators.chunking import HEADING, blocks, cells, full_lines

# How paragraphs around tables read.
STATEMENT = r"(?i)^statement\s*[-–—]?\s*([0-9]+)\b\s*[:.–—-]?\s*(.*)$"
RESET = r"(?i)^(?:graph|map|figure|chart|annexure)\b"
CONTEXT_CHARS = 300
NOTE = r"(?i)^(?:notes?\s*:|n\.\s?b\.)"
#: A mark at the start of a note, that cells bear at their end.
MARK = r"^(?:(?i:notes?\s*:|n\.\s?b\.)\s*)?([#†‡§¶*]+|\[[0-9a-z]\]|[0-9a-z]\))\s"


def contexts(pages: DataFrame) -> DataFrame:
    """All blocks of documents with the statement, title and heading that hold for them.

    Context is what happened last before a block in its document: statements
    and resets open it, the next short paragraph after a statement without a
    title is its title.
    """
    b = blocks(pages.select("document_id", "region", "page_number", "text", "source_checksum"))
    is_heading, is_table = F.col("kind") == "heading", F.col("kind") == "table"
    text = F.when(~is_table, plain(F.when(is_heading, F.regexp_extract("block", HEADING, 2)).otherwise(F.col("block"))))
    b = b.withColumn("said", text).filter(is_table | (F.col("said") != ""))
    short = F.length("said") <= CONTEXT_CHARS
    own = F.regexp_replace(F.regexp_extract("said", STATEMENT, 2), r"^[ :.–—-]+|[ :.–—-]+$", "")
    b = b.withColumn("states", F.coalesce(~is_table & short & F.col("said").rlike(STATEMENT), F.lit(False)))
    b = b.withColumn("own_title", F.when(F.col("states") & (own != ""), own))
    before = Window.partitionBy("document_id").orderBy("page_number", "block_no")
    waits = F.when(F.col("states"), F.col("own_title").isNull()).when(is_table | short | is_heading | F.col("said").rlike(RESET), F.lit(False))
    b = b.withColumn("waits", F.last(waits, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    b = b.withColumn("is_title", ~F.col("states") & ~is_table & short & F.coalesce("waits", F.lit(False)))
    b = b.withColumn("resets", ~F.col("states") & ~is_table & ~F.col("is_title") & (is_heading | F.col("said").rlike(RESET)))
    b = b.withColumn("context_no", F.sum((F.col("states") | F.col("resets")).cast("int")).over(before))
    inside = Window.partitionBy("document_id", "context_no").orderBy("page_number", "block_no")
    number = F.first(F.when(F.col("states"), F.regexp_extract("said", STATEMENT, 1)), ignorenulls=True).over(inside)
    title = F.first(F.coalesce("own_title", F.when(F.col("is_title"), F.col("said"))), ignorenulls=True).over(inside)
    heading = F.last(F.when(F.col("resets"), F.struct(F.when(is_heading, F.col("said")).alias("text"))), ignorenulls=True).over(before)["text"]
    b = b.withColumn("statement", number).withColumn("statement_title", title).withColumn("heading_title", heading)
    return b.withColumn("table_title", F.when(F.col("statement").isNotNull(), F.col("statement_title")).otherwise(F.col("heading_title")))


def header_paths(levels: Column, width: Column) -> Column:
    """For each column the non-empty header cells above it.

    A blank cell goes on with what its left neighbour says, if all levels above
    are the same for both.
    """
    def fill(done: Column, row: Column) -> Column:
        same = lambda i: F.forall(done, lambda level: F.get(level, i) == F.get(level, i - 1))
        value = lambda i: plain(F.coalesce(F.get(row, i), F.lit("")))
        one = lambda out, i: F.concat(out, F.array(F.when((value(i) == "") & (i > 0) & same(i), F.coalesce(F.get(out, i - 1), F.lit(""))).otherwise(value(i))))
        return F.concat(done, F.array(F.aggregate(F.sequence(F.lit(0), width - 1), F.array().cast("array<string>"), one)))

    filled = F.aggregate(levels, F.array().cast("array<array<string>>"), fill)
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.filter(F.transform(filled, lambda level: F.get(level, i)), lambda x: x != ""))


def statement_tables(pages: DataFrame) -> DataFrame:
    """One row for each printed table with a row of column numbers and a label column, continued ones numbered alike."""
    # Pages are dealt by document once: all windows below stay on their tasks, and headers are computed on all cores.
    t = contexts(spread(pages, "document_id")).filter("kind = 'table'").select("document_id", "region", "source_checksum", "page_number", "block_no", "context_no", "statement", "table_title", full_lines(F.col("block")).alias("lines"))
    t = computed(t, rows=F.transform("lines", cells))
    # Most rows don't begin with 1, and are read no further.
    counts = lambda row: (F.size(row) >= 2) & (plain(F.get(row, F.lit(0))) == "1") & F.forall(F.transform(row, lambda c, i: plain(c) == (i + 1).cast("string")), lambda ok: ok)
    rule = lambda row: F.forall(row, lambda c: c.rlike("^[-:]*$"))
    t = computed(t, number_row=F.array_position(F.transform("rows", counts), F.lit(True)).cast("int") - 1).filter("number_row >= 0")
    t = computed(t, width=F.size(F.get("rows", F.col("number_row"))))
    levels = F.filter(F.slice("rows", F.lit(1), F.col("number_row")), lambda r: ~rule(r))
    t = computed(t, paths=header_paths(levels, F.col("width")))
    t = computed(t, heads=F.transform("paths", lambda p: F.lower(F.array_join(p, " "))))
    t = computed(t, code_column=F.nullif(F.array_position(F.transform("heads", lambda h: h.rlike(r"\bcode\b")), F.lit(True)).cast("int"), F.lit(0)) - 1)
    labelled = F.transform("heads", lambda h, i: h.rlike("district|state|india|union territory") & ~i.eqNullSafe(F.col("code_column")))
    t = computed(t, label_column=F.nullif(F.array_position(labelled, F.lit(True)).cast("int"), F.lit(0)) - 1).filter("label_column is not null")
    label = F.get("heads", F.col("label_column"))
    t = t.withColumn("entity_kind", F.when(label.contains("district"), "district").when(label.rlike(r"\b(?:state|india|union territory)\b"), "state"))
    # A statement's table goes on over pages while its header stays the same.
    order = Window.partitionBy("document_id").orderBy("page_number", "block_no")
    inside = Window.partitionBy("document_id", "context_no").orderBy("page_number", "block_no")
    goes_on = F.col("statement").isNotNull() & F.coalesce(F.lag("paths").over(inside) == F.col("paths"), F.lit(False))
    t = t.withColumn("table_no", F.sum((~goes_on).cast("int")).over(order))
    first = F.min("page_number").over(Window.partitionBy("document_id", "table_no"))
    return t.withColumn("table_id", F.format_string("t%03d-p%d", F.col("table_no"), first)).drop("heads", "table_no", "context_no")


def _group_in(text: Column) -> Column:
    """The one group that a header cell names beside its metric."""
    named = F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(text), UNIT, " "), F.lit(r"\b(persons|males|females)\b"), F.lit(1)))
    return F.when(F.size(named) == 1, F.get(named, F.lit(0)))


def table_columns(tables: DataFrame) -> DataFrame:
    """One row for each column of values: metric, year or period, residence, group, unit."""
    c = tables.select("document_id", "region", "table_id", "page_number", "block_no", "statement", "table_title", "entity_kind", "label_column", "code_column", F.posexplode("paths").alias("column_index", "header_path"))
    c = c.filter(~F.col("column_index").eqNullSafe(F.col("label_column")) & ~F.col("column_index").eqNullSafe(F.col("code_column")))
    low = F.transform("header_path", lambda p: F.lower(p))
    whole = F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])
    is_plain = lambda p: F.lower(p).isin(*RESIDENCES, *GROUPS)
    parts = F.filter("header_path", lambda p: ~is_plain(p))
    groups = F.array_compact(F.transform("header_path", lambda p: F.coalesce(whole[F.lower(p)], F.when(~is_plain(p), _group_in(p)))))
    without = F.transform(parts, lambda p: F.when(_group_in(p).isNotNull(), F.regexp_replace(p, r"(?i)\b(?:persons|males|females)\b", " ")).otherwise(p))
    years = lambda p: F.regexp_extract_all(F.regexp_replace(p, PERIOD, " "), F.lit(YEAR), F.lit(0))
    c = c.withColumn("residence", F.try_element_at(F.filter(low, lambda p: p.isin(*RESIDENCES)), F.lit(-1))).withColumn("group", F.try_element_at(groups, F.lit(-1))).withColumn("parts", without)
    c = c.withColumn("years", F.array_distinct(F.flatten(F.transform("parts", years)))).withColumn("periods", F.array_distinct(F.flatten(F.transform("parts", periods))))
    trim = lambda p: F.regexp_replace(squeezed(F.regexp_replace(F.regexp_replace(p, PERIOD, " "), YEAR, " ")), r"^[ \-–—:/,]+|[ \-–—:/,]+$", "")
    raw = F.array_join(F.filter(F.transform("parts", trim), lambda x: x != ""), " ")
    c = c.withColumn("raw_metric", raw).withColumn("metric", F.nullif(squeezed(F.regexp_replace(F.col("raw_metric"), UNIT, " ")), F.lit("")))
    n_years, n_periods = F.size("years"), F.size("periods")
    year = F.when((n_years == 1) & (n_periods == 0), F.get("years", F.lit(0)).cast("int")).when((n_years == 0) & (n_periods == 0), single_year(F.col("table_title")))
    of_title = F.regexp_extract(F.coalesce("table_title", F.lit("")), r"(?i)\(\s*(persons?|males?|females?)\s*\)\s*$", 1)
    title_group = whole[F.nullif(F.lower(of_title), F.lit(""))]
    return c.select(
        "document_id", "table_id", "page_number", "block_no", "entity_kind", "column_index", "header_path", "metric", year.alias("year"),
        F.when((n_periods == 1) & (n_years == 0), F.get("periods", F.lit(0))).alias("period"), "residence", F.coalesce("group", title_group).alias("population_group"),
        qualifiers(F.coalesce("table_title", F.lit(""))).alias("qualifiers"), F.when(F.col("metric").isNotNull(), unit(F.col("raw_metric"), F.col("table_title"))).alias("unit"),
    )


def table_rows(tables: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each line of data, with the chunk that alone holds the line on its page; malformed ones flagged."""
    body = F.slice(F.arrays_zip(F.col("lines").alias("line"), F.col("rows").alias("cells")), F.col("number_row") + 2, F.size("lines"))
    r = tables.select("document_id", "region", "table_id", "page_number", "block_no", "statement", F.col("table_title").alias("title"), "width", "label_column", "code_column", F.posexplode(body).alias("row_no", "row"))
    r = r.select("*", "row.line", F.transform("row.cells", plain).alias("cells")).drop("row")
    label = F.get("cells", F.col("label_column"))
    r = r.withColumn("malformed", (F.size("cells") != F.col("width")) | F.coalesce(label == "", F.lit(True)))
    r = r.select("*", F.when(~F.col("malformed"), label).alias("entity"), F.nullif(F.get("cells", F.col("code_column")), F.lit("")).alias("entity_code"))
    r = r.withColumn("aggregate", F.lower("entity").isin("india") | (F.lower("entity") == F.lower("region")))
    held = chunks.select("document_id", "page_number", "chunk_id", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line")).filter(F.col("line").rlike(r"\|.*\|"))
    once = held.groupBy("document_id", "page_number", "line").agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return r.join(once, ["document_id", "page_number", "line"], "left")


def facts(tables: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every cell of a value column: one row for each entity and column, ``value`` null where a cell is no number."""
    return facts_of(table_columns(tables), table_rows(tables, chunks))


def facts_of(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Facts from the columns and rows of tables as they are."""
    columns, rows = columns.filter("metric is not null"), rows.filter("not malformed")
    # Columns say the same in all tables and take few bytes in storage, a hundred times that in memory: they are not sent to all.
    both = columns.hint("merge").join(rows.drop("table_id"), ["document_id", "page_number", "block_no"])
    raw = F.get("cells", F.col("column_index"))
    return both.select("document_id", "region", "table_id", "statement", "title", "entity", "entity_code", "aggregate", "entity_kind", "column_index", "metric", "year", "period", "residence", "population_group", "qualifiers", "unit", raw.alias("raw_value"), parse_number(raw).alias("value"), "page_number", "chunk_id", "line")


def census_years(facts_: DataFrame) -> DataFrame:
    return facts_.filter("year is not null").groupBy("document_id").agg(F.array_sort(F.collect_set("year")).alias("years"))


def footnotes(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """``document_id, table_id, note_no, mark, note``: the notes below tables, also where a table ended on an earlier page.

    A note is a short paragraph that begins as one, or is set in italics, after
    a table and before anything that opens another statement or heading.  What
    holds before a note in its document is one window, whatever pages lie
    between.  ``mark`` is the sign that the note begins with, if any.
    """
    b = contexts(pages).select("document_id", "page_number", "block_no", "context_no", "kind", "block", "said", "states", "is_title", "resets")
    known = tables.select("document_id", "page_number", "block_no", "table_id")
    b = b.join(known, ["document_id", "page_number", "block_no"], "left")
    before = Window.partitionBy("document_id", "context_no").orderBy("page_number", "block_no")
    bare = F.trim("block")
    italic = bare.startswith("*") & ~bare.startswith("**") & bare.endswith("*") & (F.length(bare) > 1)
    noted = (F.col("kind") != "table") & ~F.col("states") & ~F.col("is_title") & ~F.col("resets") & (F.length("said") <= CONTEXT_CHARS) & (F.col("said").rlike(NOTE) | italic)
    b = b.withColumn("table_id", F.last("table_id", ignorenulls=True).over(before)).filter(noted).filter("table_id is not null")
    shown = F.regexp_replace(F.trim("block"), r"^\*(?=[^*\s])|(?<=[^*\s])\*$", "")
    nth = F.row_number().over(Window.partitionBy("document_id", "table_id").orderBy("page_number", "block_no"))
    return b.select("document_id", "table_id", nth.alias("note_no"), F.nullif(F.regexp_extract(shown, MARK, 1), F.lit("")).alias("mark"), F.col("said").alias("note"))


def cell_notes(tables: DataFrame, notes: DataFrame) -> DataFrame:
    """``document_id, table_id, page_number, row_no, column_index, note_no``: for each cell the notes of its table; a note with a mark holds for the cells that bear it."""
    body = F.slice("rows", F.col("number_row") + 2, F.size("rows"))
    each = tables.select("document_id", "table_id", "page_number", "label_column", "code_column", F.posexplode(body).alias("row_no", "cells"))
    each = each.select("*", F.posexplode("cells").alias("column_index", "cell")).filter(~F.col("column_index").eqNullSafe(F.col("label_column")) & ~F.col("column_index").eqNullSafe(F.col("code_column")))
    met = each.select("document_id", "table_id", "page_number", "row_no", "column_index", F.trim("cell").alias("cell")).join(notes.select("document_id", "table_id", "note_no", "mark"), ["document_id", "table_id"])
    return met.filter(F.col("mark").isNull() | F.col("cell").endswith(F.col("mark"))).drop("cell", "mark")
