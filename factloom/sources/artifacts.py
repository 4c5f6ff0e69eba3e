"""Files of a dataset: CSV, Markdown and a manifest of its sources; written, read back, compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.plans.staging import staged

# Fixed value: the files that each kind of artifact must have.
EXPECTED = {"chart": ("chart.png", "plotted-data.csv", "source-manifest.json"), "table": ("table.csv", "table.md", "source-manifest.json")}


def write_dataset(rows: DataFrame, sources: DataFrame, folder: str) -> None:
    """``rows`` as CSV and ``sources`` as JSON lines, by Spark's writers."""
    rows.write.option("header", True).option("escape", '"').csv(f"{folder}/data")
    sources.write.json(f"{folder}/manifest")


def read_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of a CSV with quoted line breaks and doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/data")


def header(spark: SparkSession, folder: str) -> list[str]:
    """The columns of a CSV in the order in which its files have them."""
    return spark.read.option("header", True).option("escape", '"').csv(f"{folder}/data").columns


def numbered_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a CSV as strings, with ``row_no`` from 0 in the order of files and lines.

    A task reads a stretch of a file in order, so the order within a stretch is
    that of the numbers that tasks give to rows.  What lies before a stretch is
    added up over the counts of stretches, of which there is one for each
    hundred megabytes or so; no rows meet in one task.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/data")
    names = raw.columns
    rows = raw.select(F.struct(*names).alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = staged(rows, "numbered")
    stretches = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = stretches.select("file", "block", "first", before.alias("before"))
    return rows.join(placed, ["file", "block"]).select("row.*", (F.col("before") + F.col("at") - F.col("first")).alias("row_no"))


def order_differences(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """``code, row_no, column, written, read`` of a dataset (``row_no`` from 0, then its columns in order) and its file.

    ``COLUMN_ORDER`` and ``ROW_COUNT`` come once; a row that stands in another
    place is ``ROW_MOVED``, with its place in the file; a place whose row is
    nowhere in the file has ``CELL_DIFFERS`` for each cell.
    """
    names, found = [c for c in rows.columns if c != "row_no"], header(spark, folder)
    text = lambda c: F.col(c).cast("string")
    tell = lambda df, code, row_no, column, a, b: df.select(F.lit(code).alias("code"), row_no.cast("long").alias("row_no"), column.cast("string").alias("column"), a.cast("string").alias("written"), b.cast("string").alias("read"))
    one = spark.range(1)
    none = F.lit(None)
    if sorted(names) != sorted(found):
        return tell(one, "COLUMNS_DIFFER", none, none, F.lit(",".join(names)), F.lit(",".join(found)))
    out = tell(one.filter(F.lit(names != found)), "COLUMN_ORDER", none, none, F.lit(",".join(names)), F.lit(",".join(found)))
    key = F.xxhash64(*[F.coalesce(F.trim(text(c)), F.lit("")) for c in names])
    read = staged(numbered_rows(spark, folder).select("row_no", key.alias("key"), F.struct(*[text(c).alias(c) for c in names]).alias("b")), "read")
    meant = staged(rows.select("row_no", key.alias("key"), F.struct(*[text(c).alias(c) for c in names]).alias("a")), "meant")
    sizes = meant.agg(F.count("*").alias("n_a")).crossJoin(read.agg(F.count("*").alias("n_b")))
    out = out.unionByName(tell(sizes.filter("n_a <> n_b"), "ROW_COUNT", none, none, F.col("n_a"), F.col("n_b")))
    cells_ = lambda: F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").alias("x"), F.col(f"b.{c}").alias("y")) for c in names])
    met = meant.join(read.select("row_no", F.col("key").alias("b_key"), "b"), "row_no")
    unlike = met.filter(F.exists(cells_(), lambda p: ~same_cell(p["x"], p["y"])))
    # A row that stands elsewhere: equal rows are met at their first place.
    places = read.groupBy("key").agg(F.min("row_no").alias("at"))
    unlike = staged(unlike.select("row_no", "key", "a", "b").join(places, "key", "left"), "unlike")
    out = out.unionByName(tell(unlike.filter("at is not null"), "ROW_MOVED", F.col("row_no"), none, F.col("row_no"), F.col("at")))
    each = unlike.filter("at is null").select("row_no", F.explode(cells_()).alias("p")).filter(~same_cell(F.col("p.x"), F.col("p.y")))
    return out.unionByName(tell(each, "CELL_DIFFERS", F.col("row_no"), F.col("p.column"), F.col("p.x"), F.col("p.y")))


def read_manifest(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{folder}/manifest")


def same_cell(a: Column, b: Column) -> Column:
    """Whether two cells say the same: forms of nothing, truth values, numbers by value, else text."""
    text = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit(""))
    nothing = lambda c: F.lower(text(c)).isin("", "na", "n/a", "nan", "none", "null")
    number = lambda c: text(c).try_cast("decimal(38,10)")
    return F.when(nothing(a) | nothing(b), nothing(a) & nothing(b)).when(number(a).isNotNull() & number(b).isNotNull(), number(a) == number(b)).when(F.lower(text(a)).isin("true", "false"), F.lower(text(a)) == F.lower(text(b))).otherwise(text(a) == text(b))


def differing(rows: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """Cells that a dataset and its file do not share: ``key, column, written, read``."""
    names = [c for c in rows.columns if c != key]
    left = rows.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in names])
    right = read.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in names])
    both = left.join(right, key, "full")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("written"), F.col(f"b_{c}").alias("read")) for c in names])
    return both.select(key, F.explode(pairs).alias("p")).select(key, "p.*").filter(~same_cell(F.col("written"), F.col("read")))


def markdown(rows: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """One Markdown table for each group of rows."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    lines = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("ls"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    return lines.select(group, F.concat_ws("\n", F.lit(head), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("table"))


def missing_files(found: DataFrame, kind: str) -> DataFrame:
    """``artifact_id, missing, extra`` of artifacts whose files are not exactly those expected; hidden names never are."""
    want = F.array(*map(F.lit, EXPECTED[kind]))
    names = found.groupBy("artifact_id").agg(F.collect_set("name").alias("names"))
    return names.select("artifact_id", F.array_except(want, "names").alias("missing"), F.array_except("names", want).alias("extra")).filter("size(missing) > 0 or size(extra) > 0")
