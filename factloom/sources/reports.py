"""Paged state reports, rendered as Markdown from orders; and readers of pages.

A report is about a region's customers of one block of numbers, so reports grow
with the data.  It has statement tables: one a page, with a header of metric,
year and residence, a row of column numbers, the report's own row and a row for
each nation.  Years, residences and nations are crossed in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import indian, slug, western
from factloom.plans.registry import table

YEARS = tuple(range(1995, 2002))
RESIDENCES = ("total", "rural", "urban")
SEGMENT = "BUILDING"
#: Customer numbers of a report.
BLOCK = 250
PAGES = "document_id string, region string, title string, page_number int, text string, extraction_method string, coverage_status string, source_checksum string"


def measures(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by report, nation and year: counts and average prices by residence, whole and of one market segment.

    The report's own row comes with a null nation.  Orders are summed before
    they meet the dimensions: 25 nations and seven years, for each block of
    customers.
    """
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    block = F.floor(F.col("c_custkey") / BLOCK).cast("long")
    placed = orders.join(customer.hint("merge"), orders.o_custkey == customer.c_custkey).select("c_nationkey", block.alias("o_block"), F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "O").alias("is_rural"), (F.col("c_mktsegment") == SEGMENT).alias("in_segment"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    small = placed.groupBy("c_nationkey", "o_block", "year", "is_rural", "in_segment").agg(F.count("*").alias("n"), F.sum("price").alias("price"))
    cells = F.broadcast(region).join(F.broadcast(nation), F.col("n_regionkey") == F.col("r_regionkey")).crossJoin(spark.range(len(YEARS)).select((F.col("id") + YEARS[0]).cast("int").alias("y")))
    cells = customer.select(block.alias("block")).distinct().crossJoin(F.broadcast(cells)).withColumn("r_name", F.concat_ws(" ", "r_name", F.col("block").cast("string")))
    joined = cells.join(small, (cells.n_nationkey == small.c_nationkey) & (cells.y == small.year) & (cells.block == small.o_block), "left")
    pick = {"total": F.lit(True), "rural": F.col("is_rural"), "urban": ~F.col("is_rural")}
    aggs = [F.coalesce(F.sum(F.when(c & extra, F.col("n"))), F.lit(0)).alias(f"{name}_{r}") for r, c in pick.items() for name, extra in (("count", F.lit(True)), ("segment", F.col("in_segment")))]
    aggs += [F.coalesce(F.round(F.sum(F.when(c, F.col("price"))) / F.sum(F.when(c, F.col("n"))), 2), F.lit(0)).cast("decimal(18,2)").alias(f"price_{r}") for r, c in pick.items()]
    keys = ["r_regionkey", "r_name", "n_nationkey", "n_name"]
    return joined.groupingSets([[*keys, "y"], ["r_regionkey", "r_name", "y"]], *keys, "y").agg(*aggs).withColumnRenamed("y", "year")


def _tables(spark: SparkSession, folder: str) -> DataFrame:
    """``r_regionkey, r_name, statement, table``: the Markdown of each statement table."""
    m = measures(spark, folder)
    shown = lambda c: F.when(F.col("r_regionkey") % 2 == 0, indian(F.col(c))).otherwise(western(F.col(c)))
    kinds = {1: ("count", "Order Count"), 2: ("price", "Average Price (dollars per order)"), 3: ("segment", "Order Count")}
    per_year = F.struct("year", *[F.struct(*[shown(f"{k}_{r}").alias(r) for r in RESIDENCES]).alias(k) for k, _ in kinds.values()])
    rows = m.groupBy("r_regionkey", "r_name", "n_nationkey", "n_name").agg(F.array_sort(F.collect_list(per_year)).alias("years"))
    label = F.coalesce("n_name", "r_name")
    code = F.coalesce(F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit("00"))
    line = lambda *cells: F.concat(F.lit("| "), F.array_join(F.concat(*cells), " | "), F.lit(" |"))
    texts = lambda *xs: F.array(*map(F.lit, xs))
    n = 2 + len(YEARS) * len(RESIDENCES)
    head = {
        statement: F.array(
            line(texts("District Code", "District", metric), texts(*[""] * (n - 3))),
            F.lit("|" + " --- |" * n),
            line(texts("", ""), texts(*[x for y in YEARS for x in (str(y), "", "")])),
            line(texts("", ""), texts(*["Total", "Rural", "Urban"] * len(YEARS))),
            line(texts(*[str(k) for k in range(1, n + 1)])),
        )
        for statement, (_, metric) in kinds.items()
    }
    # One pass over the measures writes the lines of all statements.
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("statement"), line(F.array(code, label), F.flatten(F.transform(F.col("years"), _residences(kind)))).alias("line")) for s, (kind, _) in kinds.items()]))
    body = rows.select("r_regionkey", "r_name", F.coalesce("n_nationkey", F.lit(-1)).alias("order"), each.alias("s")).select("r_regionkey", "r_name", "s.statement", F.struct("order", "s.line").alias("row"))
    header = F.create_map(*[x for s, h in head.items() for x in (F.lit(s), h)])[F.col("statement")]
    return body.groupBy("r_regionkey", "r_name", "statement").agg(F.array_join(F.concat(header, F.transform(F.array_sort(F.collect_list("row")), lambda r: r["line"])), "\n").alias("table"))


def _residences(kind: str):  # noqa: ANN202
    def cells(y: Column) -> Column:
        return F.array(*[y[kind][r] for r in RESIDENCES])

    return cells


def state_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of one report for each region, in the schema ``PAGES``."""
    title = F.when(F.col("statement") == 3, "Order Count of Scheduled Castes by district (Persons)").when(F.col("statement") == 1, "Order Count by district (Persons)").otherwise("Average Price by district")
    tables = _tables(spark, folder)
    page = lambda number, text: F.struct(number.cast("int").alias("page_number"), text.alias("text"))
    stated = page(F.col("statement") + 1, F.concat_ws("\n\n", F.concat(F.lit("### Statement "), F.col("statement").cast("string")), title, F.col("table")))
    intro = page(F.lit(1), F.concat_ws("\n\n", F.concat(F.lit("# Orders of "), F.col("r_name")), F.concat(F.lit("This report counts the orders of "), F.col("r_name"), F.lit(" from 1995 to 2001.\n\n## Statements\n\nThe statements give totals, and rural and urban orders apart."))))
    pages = tables.select("r_name", F.explode(F.when(F.col("statement") == 1, F.array(intro, stated)).otherwise(F.array(stated))).alias("p")).select("r_name", "p.*")
    return pages.select(
        F.concat(F.lit("orders-"), slug(F.col("r_name"))).alias("document_id"), F.col("r_name").alias("region"), F.concat(F.lit("Orders of "), F.col("r_name")).alias("title"), "page_number", "text",
        F.lit("provided_markdown").alias("extraction_method"), F.lit("indexed_markdown").alias("coverage_status"), F.sha2(F.concat(F.lit("orders-"), F.col("r_name")), 256).alias("source_checksum"),
    )


def irregular_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a report for each region and block of suppliers, with tables that are flawed in turns, in the schema ``PAGES``.

    Each report has a table on two pages with one header (sound), a row that
    lacks a cell, a blank cell, a single entity, and one metric printed twice
    with other values.  Reports of odd regions come twice under one name.
    """
    nation = table(spark, folder, "nation").join(F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, folder, "supplier").select("s_nationkey", F.floor(F.col("s_suppkey") / BLOCK).cast("long").alias("block"), "s_name", F.round("s_acctbal").cast("long").alias("v"))
    own = s.join(F.broadcast(nation.select("n_nationkey", "r_regionkey", "r_name")), F.col("s_nationkey") == F.col("n_nationkey"))
    # A report names at most BLOCK suppliers.
    one = own.groupBy("r_regionkey", "r_name", "block").agg(F.array_sort(F.collect_list(F.struct("s_name", "v"))).alias("rows"), F.sum("v").alias("total")).withColumn("region", F.concat_ws(" ", "r_name", F.col("block").cast("string")))
    line = lambda code, name, *cells: F.concat(F.lit("| "), F.concat_ws(" | ", F.lit(code) if isinstance(code, str) else code, name, *cells), F.lit(" |"))
    head = lambda metric: F.lit(f"| Code | District | {metric} |\n| --- | --- | --- |\n|  |  | 2001 |\n| 1 | 2 | 3 |")
    shown = lambda v: western(v)
    total = line("00", F.col("region"), shown(F.col("total")))
    rows = lambda cell, some="rows": F.transform(F.col(some), lambda r, i: cell(F.lpad((i + 1).cast("string"), 3, "0"), r, i))
    plain_ = lambda n, r, i: line(n, r["s_name"], shown(r["v"]))
    body = lambda metric, lines: F.concat_ws("\n", head(metric), lines)
    half = F.ceil(F.size("rows") / 2).cast("int")
    one = one.withColumn("front", F.slice("rows", F.lit(1), half)).withColumn("back", F.slice("rows", half + 1, F.size("rows")))
    titled = lambda k, title, text: F.concat(F.lit(f"Statement {k} : {title}\n\n"), text)
    first = F.array_join(F.array(total), "\n")
    texts = [
        titled(1, "Account Balance by district (Persons)", body("Account Balance", F.concat_ws("\n", first, F.array_join(rows(plain_, "front"), "\n")))),
        F.when(F.size("back") > 0, body("Account Balance", F.array_join(rows(plain_, "back"), "\n"))),
        titled(2, "Parcel Count by district (Persons)", body("Parcel Count", F.concat_ws("\n", first, F.array_join(rows(lambda n, r, i: F.when(i == 0, F.concat(F.lit("| "), n, F.lit(" | "), r["s_name"], F.lit(" |"))).otherwise(plain_(n, r, i))), "\n")))),
        titled(3, "Refund Count by district (Persons)", body("Refund Count", F.concat_ws("\n", first, F.array_join(rows(lambda n, r, i: F.when(i == 0, line(n, r["s_name"], F.lit(""))).otherwise(plain_(n, r, i))), "\n")))),
        titled(4, "Tanker Count by district (Persons)", body("Tanker Count", F.concat_ws("\n", first, plain_(F.lit("001"), F.get("rows", F.lit(0)), 0)))),
        titled(5, "Visit Count by district (Persons)", body("Visit Count", F.concat_ws("\n", first, F.array_join(rows(plain_), "\n")))),
        titled(6, "Visit Count by district (Persons)", body("Visit Count", F.concat_ws("\n", first, F.array_join(rows(lambda n, r, i: line(n, r["s_name"], shown(r["v"] + 1))), "\n")))),
    ]
    pages = one.select("r_regionkey", "region", F.explode(F.array(*[F.struct(F.lit(k).alias("page_number"), t.alias("text")) for k, t in enumerate(texts, 1)])).alias("p")).select("r_regionkey", "region", "p.*").filter("text is not null")
    copies = pages.withColumn("edition", F.explode(F.when(F.col("r_regionkey") % 2 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))))
    key = F.concat_ws("-", F.lit("suppliers"), slug(F.col("region")), "edition")
    return copies.select(
        key.alias("document_id"), "region", F.concat(F.lit("Suppliers of "), F.col("region")).alias("title"), "page_number", "text", F.lit("provided_markdown").alias("extraction_method"), F.lit("indexed_markdown").alias("coverage_status"), F.sha2(key, 256).alias("source_checksum"),
    )


def prose_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as reports of one page each, lines as paragraphs."""
    docs = table(spark, folder, "documents")
    return docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), F.col("source").alias("region"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.lit(1).alias("page_number"), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n").alias("text"),
        F.lit("provided_markdown").alias("extraction_method"), F.lit("indexed_markdown").alias("coverage_status"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_checksum"),
    )
