"""Files of artifacts checked as they lie in storage: names, sizes, rows, schemas, pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How many files and bytes an artifact may have, rows of a CSV, endings of names, sides and pixels of a picture.
MOST_FILES, MOST_BYTES, MOST_ROWS, MOST_PIXELS, LEAST_SIDE = 8, 20 * 1024 * 1024, 10_000, 25_000_000, 10
ENDINGS = ("png", "csv", "md", "json")
PNG = "89504E470D0A1A0A"
#: Folder and file of a path: one folder for each artifact, named files in it.
PLACE = r"/([^/]+)/([^/]+)$"


def files(spark: SparkSession, root: str, place: str = PLACE, content: bool = False) -> DataFrame:
    """``artifact_id, name, bytes`` of the files below a folder, and their ``content`` if asked; a file's bytes are read only then, and none larger than an artifact may be."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    part = lambda k: F.regexp_extract(F.col("path"), place, k)
    found = found.filter(F.col("length") <= MOST_BYTES) if content else found
    return found.select(part(1).alias("artifact_id"), part(2).alias("name"), F.col("length").alias("bytes"), *(["content"] if content else []))


def _number(content: Column, at: int) -> Column:
    """A big-endian number of four bytes."""
    return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")


def _flaw(content: Column, text: Column, ending: Column, columns: Column) -> Column:
    """What is wrong inside of a file, by its ending."""
    wide, high = _number(content, 17), _number(content, 21)
    head = F.hex(F.substring(content, 1, 8)) == PNG
    picture = F.when(~head, "PNG_SIGNATURE").when((F.length(content) < 33) | (wide * high > MOST_PIXELS), "PNG_UNSAFE").when((wide < LEAST_SIDE) | (high < LEAST_SIDE), "PNG_DIMENSIONS")
    # Line breaks and commas in quotes are none.
    bare = F.regexp_replace(text, '"[^"]*"', "x")
    lines = F.filter(F.split(bare, r"\r?\n", -1), lambda x: x != "")
    first = F.regexp_extract(text, r"^((?:[^\n\"]|\"[^\"]*\")*)", 1)
    names = F.transform(F.regexp_extract_all(F.concat(F.regexp_replace(first, r"\r$", ""), F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,"]*),'), F.lit(1)), lambda c: F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"'))
    table = F.when(~F.is_valid_utf8(text), "NOT_UTF8").when(~F.coalesce(names == columns, F.lit(False)), "CSV_SCHEMA").when(F.size(lines) - 1 > MOST_ROWS, "CSV_ROWS")
    manifest = F.try_variant_get(F.try_parse_json(text), "$.sources", "string")
    listed = F.when(~F.is_valid_utf8(text), "NOT_UTF8").when(~F.coalesce(manifest.startswith("["), F.lit(False)), "MANIFEST_SCHEMA")
    return F.when(ending == "png", picture).when(ending == "csv", table).when(ending == "json", listed).otherwise(F.when(~F.is_valid_utf8(text), "NOT_UTF8"))


def checked(spark: SparkSession, root: str, expected: DataFrame, place: str = PLACE) -> DataFrame:
    """``artifact_id, code, names, n_files, bytes`` of artifacts below a folder: the first rule that each breaks, and by which files; null if none.

    ``expected``: ``artifact_id, name, columns`` (of a CSV).  A hidden file is
    never there, as Spark lists none.  Counts, names and
    sizes come from a listing; only files of artifacts that pass these are
    opened.
    """
    there = files(spark, root, place)
    ending = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    met = there.withColumn("there", F.lit(True)).join(expected.select("artifact_id", "name", F.lit(True).alias("wanted")), ["artifact_id", "name"], "full")
    name = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("name"))))
    sums = met.groupBy("artifact_id").agg(
        F.count("there").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        name(F.col("there").isNull()).alias("missing"), name(F.col("wanted").isNull()).alias("extra"), name(F.col("there") & (F.col("name").startswith(".") | ~ending.isin(*ENDINGS))).alias("odd"),
    )
    none = F.array().cast("array<string>")
    flaw = lambda code, names: F.struct(F.lit(code).alias("code"), names.alias("names"))
    outside = (
        F.when(F.col("n_files") > MOST_FILES, flaw("FILE_COUNT", none))
        .when(F.size("missing") > 0, flaw("MISSING", F.col("missing")))
        .when(F.size("extra") > 0, flaw("UNEXPECTED", F.col("extra")))
        .when(F.size("odd") > 0, flaw("EXTENSION", F.col("odd")))
        .when(F.col("bytes") > MOST_BYTES, flaw("TOTAL_BYTES", none))
    )
    sums = sums.withColumn("outside", outside)
    opened = files(spark, root, place, content=True).join(sums.filter("outside is null").select("artifact_id"), "artifact_id", "left_semi").join(expected, ["artifact_id", "name"])
    flaws = opened.select("artifact_id", "name", _flaw(F.col("content"), F.col("content").cast("string"), ending, F.col("columns")).alias("code")).filter("code is not null")
    inside = flaws.groupBy("artifact_id").agg(F.min(F.struct("name", "code")).alias("first"))
    out = sums.join(inside, "artifact_id", "left")
    return out.select("artifact_id", F.coalesce("outside.code", "first.code").alias("code"), F.when(F.col("outside").isNotNull(), F.col("outside.names")).when(F.col("first").isNotNull(), F.array("first.name")).otherwise(none).alias("names"), "n_files", "bytes")
