"""Evidence for a request: titles of tables, chunks by id, whole tables of a metric, cells of a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import tokens

# Words that make a table one of a subgroup; how long a title is.
SUBGROUP_WORDS = ("child", "children", "scheduled", "caste", "castes", "tribe", "tribes")
LEAST_TITLE, MOST_TITLE, CONTEXT_CHARS = 12, 220, 400


def title_of(text: Column, path: Column) -> Column:
    """The title that a chunk without a table is as a whole: one line, aside from its section path, neither short nor a sentence."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    crumb = F.array_join(path, " > ")
    own = F.filter(lines, lambda x, i: ~((i == 0) & (crumb != "") & (x == crumb)))
    bare = F.trim(F.regexp_replace(F.get(own, F.lit(0)), r"^[*# ]+|[*# ]+$", ""))
    good = ~F.contains(text, F.lit("|")) & (F.size(own) == 1) & F.length(bare).between(LEAST_TITLE, MOST_TITLE) & ~bare.endswith(".")
    return F.when(good, bare)


def titles(chunks: DataFrame) -> DataFrame:
    """``document_id, section_path, title`` of sections with one title."""
    told = chunks.select("document_id", "section_path", title_of(F.col("text"), F.col("section_path")).alias("title")).filter("title is not null")
    return told.groupBy("document_id", "section_path").agg(F.min("title").alias("title"), F.max("title").alias("other")).filter("title = other").drop("other")


def with_titles(chunks: DataFrame, titles_: DataFrame) -> DataFrame:
    """Chunks of tables with their section's title at the end of their path; others as they are."""
    met = chunks.join(titles_.select("document_id", "section_path", F.col("title").alias("__title")), ["document_id", "section_path"], "left")
    adds = F.contains("text", F.lit("|")) & F.col("__title").isNotNull() & ~F.array_contains("section_path", F.col("__title"))
    path = F.when(adds, F.concat("section_path", F.array("__title"))).otherwise(F.col("section_path"))
    return met.withColumn("section_path", path).drop("__title").select(chunks.columns)


def by_ids(references: DataFrame, chunks: DataFrame) -> DataFrame:
    """``evidence_id, reason``, and the chunk: stale if it is gone, has moved or comes from another version of its source.

    ``references``: ``evidence_id, document_id, page_number, source_checksum`` as they were; a null checksum isn't compared.
    """
    now = chunks.select(F.col("chunk_id").alias("evidence_id"), F.col("document_id").alias("n_document"), F.col("page_number").alias("n_page"), F.col("source_checksum").alias("n_sum"), "text")
    met = references.dropDuplicates(["evidence_id"]).join(now, "evidence_id", "left")
    sound = F.coalesce(F.col("n_sum").rlike("^[0-9a-f]{64}$"), F.lit(False)) & (F.col("source_checksum").isNull() | (F.col("source_checksum") == F.col("n_sum")))
    moved = (F.col("n_document") != F.col("document_id")) | (F.col("n_page") != F.col("page_number")) | ~sound
    return met.select("evidence_id", F.when(F.col("n_document").isNull(), "MISSING_EVIDENCE").when(moved, "PROVENANCE_CHANGED").alias("reason"), "text")


def metric_rows(requests: DataFrame, chunks: DataFrame, titles_: DataFrame) -> DataFrame:
    """All chunks of a document whose words hold a request's metric, none about a subgroup that isn't asked: ``spec_id, document_id, metric`` to chunks."""
    named = chunks.join(titles_, ["document_id", "section_path"], "left")
    around = tokens(F.concat_ws(" ", F.array_join("section_path", " "), "title", F.left("text", F.lit(CONTEXT_CHARS))))
    words = with_words(named, around)
    asked = requests.select("spec_id", "document_id", F.array_distinct(tokens(F.col("metric"))).alias("wanted"))
    met = asked.join(words, "document_id")
    barred = F.array_except(F.array(*map(F.lit, SUBGROUP_WORDS)), "wanted")
    fits = (F.size("wanted") > 0) & (F.size(F.array_except("wanted", "words")) == 0) & ~F.arrays_overlap(barred, "words")
    return met.filter(fits).select("spec_id", "document_id", "chunk_id", "page_number", "title")


def with_words(chunks: DataFrame, words: Column) -> DataFrame:
    return chunks.select("document_id", "chunk_id", "page_number", "title", F.array_distinct(words).alias("words"))


def cells_of(chunk_ids: DataFrame, facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts whose line stands verbatim in one of the given chunks, of the same document and page."""
    lines = chunks.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "document_id", "page_number", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line"))
    return facts.join(lines, ["chunk_id", "document_id", "page_number", "line"], "left_semi")
