"""Queries of what depends on order: notes below tables, rows of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import tables as T
from factloom.plans.corpus import corpus
from factloom.plans.q_facts import CELLS
from factloom.plans.registry import query, table
from factloom.plans.staging import shared_folder, staged
from factloom.sources import artifacts

BELOW, OVER = "*Figures are provisional.*", "Note: # none were counted in statement {}"


@query(
    CELLS
    + """
    , s AS (SELECT slug, statement, count(*) AS n, count(*) FILTER (WHERE value = 0 AND statement <> 2) AS n_none FROM cells GROUP BY ALL)
    SELECT 'orders-' || slug AS document_id, statement, 1 AS note_no, NULL AS mark, 'Figures are provisional.' AS note, n AS n_cells FROM s
    UNION ALL SELECT 'orders-' || slug, statement, 2, '#', 'Note: # none were counted in statement ' || statement, n_none FROM s
    """
)
def table_footnotes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of all tables: one below each, and one at the top of the page that follows, which only marked cells are meant by."""
    pages = corpus(spark, folder).pages
    nothing = F.regexp_replace("text", r"\| 0 (?=\|)", "| 0# ")
    before = F.when(F.col("page_number") > 2, F.concat(F.format_string(OVER.replace("{}", "%d"), F.col("page_number") - 2), F.lit("\n\n"))).otherwise("")
    noted = pages.filter("page_number > 1").withColumn("text", F.concat(before, nothing, F.lit("\n\n" + BELOW)))
    # The last statement's note stands on a page of its own.
    last = pages.filter("page_number = 4").withColumns({"page_number": F.lit(5), "text": F.lit(OVER.format(3))})
    whole = staged(pages.filter("page_number = 1").unionByName(noted).unionByName(last), "noted-pages")
    found = staged(T.statement_tables(whole), "noted-tables")
    notes = staged(T.footnotes(whole, found), "notes")
    counts = T.cell_notes(found, notes).groupBy("document_id", "table_id", "note_no").agg(F.count("*").alias("n"))
    of = found.groupBy("document_id", "table_id").agg(F.min("statement").cast("int").alias("statement"))
    met = notes.join(of, ["document_id", "table_id"]).join(counts, ["document_id", "table_id", "note_no"], "left")
    return met.select("document_id", "statement", "note_no", "mark", "note", F.coalesce("n", F.lit(0)).cast("long").alias("n_cells"))


@query(
    """
    WITH o AS (SELECT o_orderkey, min(o_custkey) AS o_custkey, min(o_totalprice) AS o_totalprice FROM orders GROUP BY 1),
    a AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no FROM o),
    b AS (SELECT *, row_number() OVER (ORDER BY o_orderkey + CASE WHEN o_orderpriority = '1-URGENT' THEN 1.5 ELSE 0 END) - 1 AS "at" FROM o JOIN (SELECT o_orderkey, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1) USING (o_orderkey))
    SELECT 'ROW_MOVED' AS code, row_no, NULL AS "column", row_no::VARCHAR AS written, b."at"::VARCHAR AS "read" FROM a JOIN b USING (o_orderkey) WHERE row_no <> b."at"
    """
)
def ordered_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a dataset and as a file of several parts in which urgent ones stand later: each row that moved, and to where."""
    o = table(spark, folder, "orders").groupBy("o_orderkey").agg(F.min("o_custkey").alias("o_custkey"), F.min("o_totalprice").alias("o_totalprice"), F.min("o_orderpriority").alias("p"))
    path = f"{shared_folder(spark)}/artifacts/{uuid.uuid4().hex}"
    place = F.col("o_orderkey") + F.when(F.col("p") == "1-URGENT", 1.5).otherwise(0.0)
    columns = ["o_orderkey", "o_custkey", "o_totalprice"]
    parts = o.withColumn("place", place).repartitionByRange(6, "place").sortWithinPartitions("place").select(columns)
    parts.write.option("header", True).option("escape", '"').csv(f"{path}/data")
    # Numbers of the rows that are meant: the keys before each, counted by stretch of keys first.
    stretch = F.floor(F.col("o_orderkey") / 1024)
    sizes = o.groupBy(stretch.alias("stretch")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("stretch").orderBy("o_orderkey")) - 1
    meant = o.withColumn("stretch", stretch).join(sizes.select("stretch", before.alias("before")), "stretch").select((F.col("before") + within).alias("row_no"), *columns)
    return artifacts.order_differences(meant, spark, path)
