"""Datasets of charts and tables: what may enter, rows bound to cells, what must be complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.frames import computed
from factloom.functions.text import plain, squeezed
from factloom.operators.citations import hydrated
from factloom.operators.chunking import cells

# Methods with the statuses they may have, labels of headers, kinds of charts.
SAFE = {"provided_markdown": "indexed_markdown", "pymupdf4llm_fallback": "indexed_fallback", "approved_manual_transcription": "approved_manual_transcription"}
HEADER_LABELS = ("state/district", "district", "state", "state/uts", "code", "state/district code", "district code", "total", "rural", "urban")
CHARTS = {"bar": "bar", "bar chart": "bar", "line": "line", "line chart": "line", "scatter": "scatter", "scatter plot": "scatter"}


def fold(text: Column) -> Column:
    return F.lower(squeezed(F.coalesce(text, F.lit(""))))


def untrusted(evidence: DataFrame) -> DataFrame:
    """``chunk_id, code``: evidence that no dataset may rest on, with the first of eight checks that it fails."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    pair = F.create_map(*[F.lit(x) for kv in SAFE.items() for x in kv])[F.col("extraction_method")]
    checks = (
        (blank("chunk_id"), "MISSING_CHUNK_ID"), (blank("text"), "MISSING_TRUSTED_TEXT"), (blank("document_title"), "MISSING_DOCUMENT_TITLE"), (blank("document_id"), "MISSING_DOCUMENT_ID"), (F.coalesce(F.col("page_number") < 1, F.lit(True)), "INVALID_PHYSICAL_PAGE"),
        (blank("citation_snippet") | ~F.coalesce(F.contains("text", "citation_snippet"), F.lit(False)), "INVALID_CITATION_PROVENANCE"), (~F.coalesce(F.col("source_checksum").rlike("^[0-9a-f]{64}$"), F.lit(False)), "INVALID_SOURCE_CHECKSUM"), (~F.coalesce(pair == F.col("coverage_status"), F.lit(False)), "UNSAFE_COVERAGE_STATUS"),
    )
    code = F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in checks])
    return evidence.select("chunk_id", code.alias("code")).filter("code is not null")


def unit_words(text: Column) -> Column:
    """A folded text with one word for percentages."""
    return F.regexp_replace(text, "percentage|per cent", "percent")


def names_rate(header: Column) -> Column:
    return F.array_contains(F.regexp_extract_all(F.lower(header), F.lit("[a-z]+"), F.lit(0)), "rate")


def unit_supported(unit: Column, header: Column, context: Column) -> Column:
    """Whether a unit stands in a header or around it; a rate is in percent."""
    wanted = F.trim(F.regexp_replace(unit_words(fold(unit)), "%", "percent"))
    return F.contains(unit_words(fold(F.concat_ws(" ", header, context))), wanted) | ((wanted == "percent") & names_rate(header))


def signature(text: Column) -> Column:
    """The first header line of a table in a text, in plain words; pieces of one table share it."""
    line = F.get(F.filter(F.split(text, "\n", -1), lambda x: F.size(F.split(x, r"\|", -1)) > 2), F.lit(0))
    return F.when(line.isNotNull(), F.array_join(F.transform(cells(line), lambda c: fold(plain(c))), "|"))


def same_table(evidence: DataFrame, used: DataFrame) -> DataFrame:
    """Evidence with the table of some chunk that was used, of the same request."""
    e = evidence.withColumn("signature", signature(F.col("text")))
    known = e.join(used.select("spec_id", "chunk_id").distinct(), ["spec_id", "chunk_id"], "left_semi").filter("signature is not null").select("spec_id", "signature").distinct()
    return e.join(known, ["spec_id", "signature"], "left_semi")


def entity_rows(evidence: DataFrame) -> DataFrame:
    """``spec_id, n_entities``: distinct labels of table rows in the evidence of a request: no rules, number rows, header labels, contents entries or region rows."""
    rows = evidence.filter(~F.exists("section_path", lambda p: fold(p).isin("contents", "table of contents"))).select("spec_id", F.lower(F.trim("region")).alias("region"), F.explode(F.split("text", "\n", -1)).alias("line")).filter(F.size(F.split("line", r"\|", -1)) > 2)
    r = computed(rows, cs=F.transform(cells(F.col("line")), plain))
    filled = F.filter("cs", lambda c: c != "")
    rule = F.forall("cs", lambda c: c.rlike("^[-: ]*$"))
    ordinal = (F.size(filled) >= 2) & F.forall(F.transform(filled, lambda c, i: c == (i + 1).cast("string")), lambda ok: ok)
    label = F.get(F.filter("cs", lambda c: (c != "") & ~c.rlike(r"^[0-9]*\.?[0-9]+$|^[-–—.]+$")), F.lit(0))
    folded = F.regexp_replace(F.lower(label), r"\s*/\s*", "/")
    kept = r.filter(~rule & ~ordinal).select("spec_id", "region", folded.alias("label")).filter(F.col("label").isNotNull() & (F.col("label") != "") & ~F.col("label").isin(*HEADER_LABELS) & (F.col("label") != F.col("region")) & ~F.col("label").rlike(r"^(?:statement|table|map|figure|chapter)\s*[-–—]?\s*[0-9]"))
    return kept.groupBy("spec_id").agg(F.countDistinct("label").alias("n_entities"))


def rebound(proposals: DataFrame, facts: DataFrame) -> DataFrame:
    """``row_id, chunk_id``: for rows with an unknown chunk the one chunk of their document with a cell of their label and value; null if not one."""
    f = facts.filter("chunk_id is not null and value is not null").select("document_id", F.lower("entity").alias("f_label"), F.col("year").alias("f_year"), F.col("residence").alias("f_residence"), F.col("value").cast("double").alias("f_value"), "chunk_id")
    p = proposals.select("row_id", "document_id", F.lower("label").alias("label"), F.col("value").cast("double").alias("value"), "year", "residence")
    met = p.join(f, "document_id").filter((F.col("label") == F.col("f_label")) & (F.abs(F.col("value") - F.col("f_value")) < 1e-6) & (F.col("year") == F.col("f_year")) & (F.col("residence") == F.col("f_residence")))
    one = met.groupBy("row_id").agg(F.countDistinct("chunk_id").alias("n"), F.min("chunk_id").alias("chunk_id"))
    return proposals.select("row_id").join(one, "row_id", "left").select("row_id", F.when(F.col("n") == 1, F.col("chunk_id")).alias("chunk_id"))


def hydrated_datasets(requests: DataFrame, proposals: DataFrame, facts: DataFrame, default_year: int = 2011) -> tuple[DataFrame, DataFrame]:
    """``spec_id, status, reason, n_rows`` of proposed datasets, and their rows with lineage.

    ``requests``: ``spec_id, metric, year, residence, regions``; ``proposals``:
    ``spec_id, row_id, document_id, region, label, value, residence``.  What a
    request leaves open is the default year and total.  A dataset is refused
    for the first of: no rows, a row that comes twice, a row that no cell
    holds, a region without rows.
    """
    asked = requests.select("spec_id", "metric", F.coalesce("year", F.lit(default_year)).alias("year"), F.coalesce("residence", F.lit("total")).alias("wanted"), "regions")
    rows = proposals.join(asked, "spec_id").withColumn("residence", F.coalesce("residence", "wanted"))
    bound = hydrated(rows.select("row_id", "document_id", "label", F.col("value").cast("decimal(38,10)").alias("value"), "metric", "year", "residence", "region"), facts)
    lineage = rows.join(bound, "row_id").select("spec_id", "row_id", "label", "region", "value", "year", "residence", "reason", "cell.chunk_id", "cell.raw_value")
    dims = rows.groupBy("spec_id", F.lower("label"), "residence").agg(F.count("*").alias("n")).groupBy("spec_id").agg(F.max("n").alias("most"))
    sums = lineage.groupBy("spec_id").agg(F.count("*").alias("n_rows"), F.min("reason").alias("flaw"), F.collect_set(F.lower("region")).alias("seen"))
    met = asked.join(sums, "spec_id", "left").join(dims, "spec_id", "left")
    lacking = F.size(F.array_except(F.transform("regions", lambda r: F.lower(r)), F.coalesce("seen", F.array().cast("array<string>")))) > 0
    reason = F.when(F.coalesce("n_rows", F.lit(0)) == 0, "EMPTY_PROPOSAL").when(F.col("most") > 1, "DUPLICATE_PROPOSAL_ROW").when(F.col("flaw").isNotNull(), F.col("flaw")).when(lacking, "MISSING_REQUIRED_TARGET")
    told = met.select("spec_id", F.when(reason.isNull(), "ok").otherwise("refused").alias("status"), reason.alias("reason"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))
    return told, lineage.join(told.filter("status = 'ok'").select("spec_id"), "spec_id", "left_semi")


def artifact_claims(lineage: DataFrame, metric: str) -> DataFrame:
    """One claim and one citation for each row of a dataset: ``spec_id, claim_id, text, citation_id``."""
    text = F.concat(F.col("label"), F.lit(" — "), F.lit(metric), F.lit(", "), F.col("residence"), F.lit(", "), F.col("year").cast("string"), F.lit(": "), F.col("raw_value"))
    return lineage.select("spec_id", F.concat_ws("/", F.lit("claim"), "row_id").alias("claim_id"), text.alias("text"), F.concat_ws("/", "chunk_id", "row_id").alias("citation_id"))


def chart_kind(name: Column) -> Column:
    """The kind of chart that a name means, or null."""
    return F.create_map(*[F.lit(x) for kv in CHARTS.items() for x in kv])[fold(F.regexp_replace(name, "[_-]", " "))]
