"""Uploaded files as rows: what is refused and why, jobs and their guards, what failures may tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import squeezed

# How names and ids look, and how long parts may be.
REGION = r"^[\p{L}\p{N}][\p{L}\p{N} .,'()&/-]*$"
UPLOADED = r"^upload-[a-z0-9-]+-[0-9a-f]{10}$"
TITLE_CHARS, REGION_CHARS, SLUG_CHARS, FAILURE_CHARS = 200, 80, 40, 400
PENDING = ("queued", "processing")


def ascii_slug(name: Column) -> Column:
    """A short slug of plain letters and digits: composed letters lose their accents."""
    plain = F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    dashed = F.regexp_replace(F.regexp_replace(plain, "[^\\x00-\\x7f]", ""), "[^a-z0-9]+", "-")
    cut = F.left(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(SLUG_CHARS))
    return F.when(cut == "", "document").otherwise(cut)


def staged_uploads(uploads: DataFrame, library: DataFrame, jobs: DataFrame, max_bytes: int, max_pages: int) -> DataFrame:
    """``upload_id, document_id, status, reason``: uploads as jobs, or why they are refused, the first reason in order.

    ``uploads``: ``upload_id, title, region, byte_size, head, encrypted,
    page_count, source_checksum``; ``library`` and ``jobs`` tell checksums that
    are there or on their way (``status``).
    """
    title, region = squeezed(F.coalesce("title", F.lit(""))), squeezed(F.coalesce("region", F.lit("")))
    there = library.select("source_checksum", F.lit(True).alias("there")).distinct()
    coming = jobs.filter(F.col("status").isin(*PENDING)).select("source_checksum", F.lit(True).alias("coming")).distinct()
    met = uploads.join(there, "source_checksum", "left").join(coming, "source_checksum", "left")
    # Of equal files that come together the first goes on.
    nth = F.row_number().over(Window.partitionBy("source_checksum").orderBy("upload_id"))
    reason = (
        F.when(~F.length(title).between(1, TITLE_CHARS), "TITLE_LENGTH")
        .when(~F.length(region).between(1, REGION_CHARS) | ~region.rlike(REGION), "REGION_NAME")
        .when(F.col("byte_size") > max_bytes, "TOO_LARGE")
        .when(~F.col("head").rlike(r"^\s*%PDF-"), "NOT_A_PDF")
        .when(F.col("encrypted"), "ENCRYPTED")
        .when(F.coalesce("page_count", F.lit(0)) < 1, "NO_PAGES")
        .when(F.col("page_count") > max_pages, "TOO_MANY_PAGES")
        .when(F.col("there"), "DUPLICATE_DOCUMENT")
        .when(F.col("coming") | (F.col("nth") > 1), "ALREADY_PROCESSING")
    )
    out = met.withColumn("nth", nth).withColumn("reason", reason)
    document = F.concat(F.lit("upload-"), ascii_slug(title), F.lit("-"), F.left("source_checksum", F.lit(10)))
    ok = F.col("reason").isNull()
    return out.select("upload_id", F.when(ok, document).alias("document_id"), F.when(ok, "queued").otherwise("refused").alias("status"), "reason")


def latest_jobs(jobs: DataFrame, most: int = 50) -> DataFrame:
    """The newest jobs first, a top-k report."""
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(most)


def deletions(requests: DataFrame, documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """``document_id, reason``: whether documents may be deleted: uploaded ones that exist and are not being indexed."""
    known = documents.select("document_id", F.lit(True).alias("known")).distinct()
    busy = jobs.filter(F.col("status").isin(*PENDING)).select("document_id", F.lit(True).alias("busy")).distinct()
    met = requests.join(known, "document_id", "left").join(busy, "document_id", "left")
    return met.select("document_id", F.when(~F.col("document_id").rlike(UPLOADED), "NOT_UPLOADED").when(F.col("known").isNull(), "UNKNOWN_DOCUMENT").when(F.col("busy"), "BEING_INDEXED").alias("reason"))


def interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: those that had not ended have failed."""
    cut = F.col("status").isin(*PENDING)
    return jobs.withColumn("detail", F.when(cut, "Processing was interrupted by a service restart. Please upload again.").otherwise(F.col("detail"))).withColumn("status", F.when(cut, "failed").otherwise(F.col("status")))


def safe_failure(message: Column) -> Column:
    """What a failure may tell: no paths, and not too much."""
    bare = F.trim(F.regexp_replace(F.coalesce(message, F.lit("")), r"(?:/[\w.-]+)+/", ""))
    return F.left(F.when(bare == "", "Ingestion failed.").otherwise(bare), F.lit(FAILURE_CHARS))


def redacted_error(message: Column) -> Column:
    """A provider's message without bearer and access tokens."""
    return F.regexp_replace(F.regexp_replace(message, r"(?i)(authorization:\s*bearer\s+)[^\s,;]+", "$1[REDACTED]"), r"(?i)(access[_ -]?token[=:]\s*)[^\s,;]+", "$1[REDACTED]")


def good_session_id(session_id: Column) -> Column:
    return F.coalesce(session_id.rlike("^[0-9a-f]{32}$"), F.lit(False))


def good_file_name(name: Column) -> Column:
    """Plain names of one part, none hidden."""
    return F.coalesce(name.rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.-]*$") & ~F.contains(name, F.lit("..")), F.lit(False))


def terminal_events(events: DataFrame, failures: DataFrame) -> DataFrame:
    """Traces of failed runs: the events that there were and one that ends them. ``events``: ``run_id, seq, event``; ``failures``: ``run_id, error_code``."""
    last = events.groupBy("run_id").agg(F.max("seq").alias("last"))
    ends = failures.join(last, "run_id", "left").select("run_id", (F.coalesce("last", F.lit(0)) + 1).alias("seq"), F.concat(F.lit("run_failed:"), "error_code").alias("event"))
    return events.join(failures.select("run_id"), "run_id", "left_semi").select("run_id", F.col("seq").cast("long").alias("seq"), "event").unionByName(ends.select("run_id", F.col("seq").cast("long").alias("seq"), "event"))


def token_usage(calls: DataFrame) -> DataFrame:
    """``run_id`` and the tokens of its calls, by kind; ``usage`` is JSON as providers give it."""
    kinds = {"input": "$.input_tokens", "output": "$.output_tokens", "total": "$.total_tokens", "output_reasoning": "$.output_token_details.reasoning", "input_cache_read": "$.input_token_details.cache_read"}
    return calls.groupBy("run_id").agg(F.count("*").alias("n_calls"), *[F.coalesce(F.sum(F.get_json_object("usage", path).cast("long")), F.lit(0).cast("long")).alias(k) for k, path in kinds.items()])


def research_sections(plan: DataFrame, most: int = 5) -> DataFrame:
    """``plan_id, question, turn``: the questions of a plan, each once whatever its case and spaces, the first ``most``."""
    folded = squeezed(F.lower("question"))
    once = plan.withColumn("folded", folded).filter("folded <> ''").groupBy("plan_id", "folded").agg(F.min(F.struct("position", "question")).alias("q"))
    turn = F.row_number().over(Window.partitionBy("plan_id").orderBy("q.position"))
    return once.withColumn("turn", turn).filter(F.col("turn") <= most).select("plan_id", "q.question", "turn")


def research_rollup(citations: DataFrame) -> DataFrame:
    """``plan_id``, how many claims its sections make and how many places they cite, each once."""
    return citations.groupBy("plan_id").agg(F.countDistinct("claim_id").alias("n_claims"), F.countDistinct(F.struct("document_id", "page_number", "chunk_id")).alias("n_places"))
