"""Page mapping: which text stands on which page of a document, and how well pages are covered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.frames import computed, spread
from factloom.functions.text import tokens
from factloom.operators.chunking import split_blocks

# Page markers, the converter's note, and the statuses of pages.
MARKER = r"(?i)^\s*(?:<!--\s*page:\s*([0-9]+)\s*-->|\[page\s+([0-9]+)\])\s*$"
CONVERTED = r"Pages converted:\s*([0-9]+)/([0-9]+)(?:\s*Skipped:\s*\[([0-9,\s]*)\])?"
STATUSES = ("indexed_markdown", "indexed_fallback", "approved_manual_transcription", "excluded_blank", "excluded_decorative", "excluded_unverified_visual", "failed_page_mapping")
ALIGNED, APART = 0.75, 0.15


def marked_pages(documents: DataFrame) -> DataFrame:
    """``document_id, page_number, text, n_markers``: lines under the last marker before them; a preamble is page 0.

    Documents without any marker have no rows; a page that is opened twice goes
    on where it ended.
    """
    lines = documents.select("document_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    number = F.coalesce(F.nullif(F.regexp_extract("line", MARKER, 1), F.lit("")), F.nullif(F.regexp_extract("line", MARKER, 2), F.lit(""))).cast("int")
    order = Window.partitionBy("document_id").orderBy("line_no")
    lines = lines.withColumn("opens", number).withColumn("page_number", F.coalesce(F.last("opens", ignorenulls=True).over(order), F.lit(0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("opens").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    out = lines.groupBy("document_id", "page_number").agg(F.regexp_replace(body, r"^\s+|\s+$", "").alias("text"), F.count("opens").alias("n_markers"))
    marked = F.max("n_markers").over(Window.partitionBy("document_id"))
    return out.withColumn("any", marked).filter("any > 0 and (page_number > 0 or text <> '')").drop("any")


def converter_pages(documents: DataFrame) -> DataFrame:
    """Pages by the converter's own note ``a/b Skipped: [...]``: blocks go in order to the pages not skipped.

    ``documents`` has ``document_id, text, page_count, blocks``; where the note
    contradicts the count, the skipped pages or the blocks, a reason is given.
    """
    part = lambda k: F.regexp_extract("text", CONVERTED, k)
    skipped = F.transform(F.regexp_extract_all(part(3), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    d = documents.filter(F.col("text").rlike(CONVERTED)).withColumn("skipped", F.array_distinct(skipped)).withColumn("converted", part(1).cast("int")).withColumn("declared", part(2).cast("int"))
    reason = F.when(F.col("declared") != F.col("page_count"), "PAGE_COUNT").when(F.exists("skipped", lambda p: (p < 1) | (p > F.col("page_count"))), "SKIPPED_PAGE").when(F.col("converted") != F.col("page_count") - F.size("skipped"), "SKIPPED_COUNT").when(F.size("blocks") != F.col("converted"), "BLOCK_COUNT")
    pages = F.array_except(F.sequence(F.lit(1), F.col("page_count")), "skipped")
    d = d.withColumn("reason", reason)
    return d.select("document_id", "reason", F.explode_outer(F.when(F.col("reason").isNull(), F.arrays_zip(pages.alias("page_number"), F.col("blocks").alias("text")))).alias("p")).select("document_id", "reason", "p.page_number", "p.text")


def alignment(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The page of each block without markers, where one page of its document is clearly best; null where none is.

    The score is the share of the block's words, with their counts, that the
    page has.  Words are counted and met within a document, so only pages that
    share a word are scored.  All blocks of a document with one page are on it.

    Texts are dealt by document once; every step after that stays on its task,
    as its groups are parts of a document.
    """
    part = lambda df, side, key: df.select("document_id", F.lit(side).alias("side"), F.col(key).cast("long").alias("no"), F.coalesce("text", F.lit("")).alias("text"))
    both = spread(part(blocks, 0, "block_no").unionByName(part(pages, 1, "page_number")), "document_id")
    both = computed(both, words=tokens(F.col("text")))
    # A row without a word keeps each block and page in sight, whatever they share.
    each = both.select("document_id", "side", "no", F.size("words").alias("n"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "words")).alias("word"))
    counted = each.groupBy("document_id", "side", "no", "n", "word").agg(F.count("*").alias("k"))
    some = lambda side, *cols: F.collect_list(F.when(F.col("side") == side, F.struct(*cols)))
    met = counted.groupBy("document_id", "word").agg(some(0, "no", "n", "k").alias("bs"), some(1, "no", "k").alias("ps"))
    # Blocks as such, each once, with the only page of their document.
    only = F.when(F.size("ps") == 1, F.get("ps", F.lit(0))["no"])
    pairs = met.select("document_id", "word", F.when(F.col("word").isNull(), only).alias("only"), F.explode("bs").alias("b"), "ps")
    pairs = pairs.select("document_id", "word", "only", "b", F.explode_outer(F.when(F.col("word").isNotNull(), F.col("ps"))).alias("p"))
    shared = pairs.groupBy("document_id", F.col("b.no").alias("block_no"), F.col("p.no").alias("page_number")).agg(F.max("only").alias("only"), F.max("b.n").alias("n"), F.sum(F.least("b.k", "p.k")).alias("both"))
    scored = shared.withColumn("score", F.when(F.col("page_number").isNotNull(), F.round(F.col("both") / F.col("n"), 6)))
    rated = F.array_sort(F.collect_list(F.when(F.col("page_number").isNotNull(), F.struct((-F.col("score")).alias("minus"), "page_number"))))
    best = scored.groupBy("document_id", "block_no").agg(F.max("only").alias("only"), F.min(F.when(F.col("page_number").isNotNull(), F.struct((-F.col("score")).alias("minus"), "page_number"))).alias("first"), rated.alias("rated"))
    score, second = -F.col("first.minus"), F.coalesce(-F.get("rated", F.lit(1))["minus"], F.lit(0.0))
    clear = (score >= ALIGNED) & (score - second >= APART)
    return best.select("document_id", "block_no", F.coalesce("only", F.when(clear, F.col("first.page_number"))).alias("page_number"), F.coalesce(score, F.lit(0.0)).alias("score"))


def review_errors(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """``document_id, reason`` of documents with reviews (decisions or transcriptions) of another version of the file, or two of one page."""
    met = reviews.join(documents.select("document_id", F.col("source_checksum").alias("now")), "document_id")
    pages = met.groupBy("document_id", "page_number").agg(F.count("*").alias("n"), F.count_if(~F.col("source_checksum").eqNullSafe(F.col("now"))).alias("old"))
    sums = pages.groupBy("document_id").agg(F.max("n").alias("n"), F.sum("old").alias("old"))
    return sums.select("document_id", F.when(F.col("old") > 0, "CHECKSUM_MISMATCH").when(F.col("n") > 1, "DUPLICATE_PAGE").alias("reason")).filter("reason is not null")


def mapped_pages(documents: DataFrame, supplied: DataFrame, fallback: DataFrame, decisions: DataFrame, transcriptions: DataFrame, overridden: DataFrame | None = None) -> DataFrame:
    """Every page of every document with its text and status: transcription, then decision, then supplied text, then fallback, else failed.

    All supplied text of ``overridden`` documents is discarded, as a reviewer asked.
    """
    if overridden is not None:
        supplied = supplied.join(overridden.select("document_id"), "document_id", "left_anti")
    spine = documents.select("document_id", "source_checksum", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_number"))
    key = ["document_id", "page_number"]
    bound = lambda df, *cols: df.select(*key, F.col("source_checksum").alias("__sum"), *cols)
    out = spine
    for df, cols in ((bound(transcriptions, F.col("text").alias("typed")), ("typed",)), (bound(decisions, F.col("coverage_status").alias("decided")), ("decided",))):
        out = out.join(df, key, "left")
        # A review of another version of the file is void.
        out = out.select(*[F.when(F.col("__sum") == F.col("source_checksum"), F.col(c)).alias(c) if c in cols else F.col(c) for c in out.columns if c != "__sum"])
    out = out.join(supplied.select(*key, F.col("text").alias("given")), key, "left").join(fallback.select(*key, F.col("text").alias("read")), key, "left")
    has = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    status = F.when(has("typed"), "approved_manual_transcription").when(F.col("decided").isNotNull(), F.col("decided")).when(has("given"), "indexed_markdown").when(has("read"), "indexed_fallback").otherwise("failed_page_mapping")
    out = out.withColumn("coverage_status", status)
    text = F.when(F.col("coverage_status") == "approved_manual_transcription", F.col("typed")).when(F.col("coverage_status") == "indexed_markdown", F.col("given")).when(F.col("coverage_status") == "indexed_fallback", F.col("read")).otherwise("")
    return out.select(*key, "source_checksum", "coverage_status", text.alias("text"))


def failed_pages(documents: DataFrame, decisions: DataFrame, transcriptions: DataFrame) -> DataFrame:
    """Pages of documents that could not be mapped: transcribed and decided ones as they are, all others failed."""
    none = documents.select("document_id", F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("text")).limit(0)
    return mapped_pages(documents, none, none, decisions, transcriptions)


def coverage_report(pages: DataFrame) -> DataFrame:
    """Per document: how many pages have each status, which, and the share that is indexed."""
    indexed = F.col("coverage_status").rlike("^(indexed_|approved_)")
    counts = [F.count_if(F.col("coverage_status") == s).alias(f"n_{s}") for s in STATUSES]
    lists = [F.array_sort(F.collect_list(F.when(F.col("coverage_status") == s, F.col("page_number")))).alias(s) for s in STATUSES]
    share = F.round(F.count_if(indexed) / F.count("*") * 100, 2)
    gap = F.count("*") != F.max("page_number")
    return pages.groupBy("document_id").agg(F.count("*").alias("n_pages"), share.alias("percent_indexed"), (gap | (F.countDistinct("page_number") != F.count("*"))).alias("incomplete"), *counts, *lists)


def limitations(pages: DataFrame) -> DataFrame:
    """What a reader must be told: only pages whose visuals nobody has checked, and never that something isn't there."""
    some = pages.filter("coverage_status = 'excluded_unverified_visual'").groupBy("document_id").agg(F.array_sort(F.collect_list("page_number")).alias("pages"))
    return some.withColumn("limitation", F.concat(F.lit("Visual content on page(s) "), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), F.lit(" has not been verified and is not searched.")))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def discovered(pdfs: DataFrame, texts: DataFrame, overrides: DataFrame) -> DataFrame:
    """Pairs of files ``path`` by override, else by equal stems; with what is wrong.

    Reasons: a stem that several files share, a text paired twice or with none,
    an override whose file is missing.
    """
    from factloom.functions.names import file_key

    key = lambda df: df.withColumn("stem", file_key(stem(F.col("path"))))
    p, t = key(pdfs).select(F.col("path").alias("pdf"), "stem"), key(texts).select(F.col("path").alias("markdown"), F.col("stem").alias("t_stem"))
    shared = p.groupBy("stem").agg(F.count("*").alias("n_pdfs"))
    # One key for both rules: a join on a condition of two columns would compare every pair of files.
    told, own = lambda c: F.concat(F.lit("="), F.col(c)), lambda c: F.concat(F.lit("~"), F.col(c))
    by_rule = p.join(overrides.select(F.col("pdf_filename").alias("pdf"), F.col("markdown_filename").alias("told")), "pdf", "left").join(shared, "stem").withColumn("key", F.coalesce(told("told"), own("stem")))
    paired = by_rule.join(t.select("markdown", F.explode(F.array(told("markdown"), own("t_stem"))).alias("key")), "key", "left")
    # Counted aside: in a window all files without a text would be one group.
    uses = paired.filter("markdown is not null").groupBy("markdown").agg(F.count("*").alias("uses")).withColumnRenamed("markdown", "used")
    out = paired.join(uses, F.col("markdown") == F.col("used"), "left").select("pdf", "markdown", F.when((F.col("n_pdfs") > 1) & F.col("told").isNull(), "AMBIGUOUS_STEM").when(F.col("uses") > 1, "MARKDOWN_PAIRED_TWICE").alias("reason"))
    orphans = t.join(out.select("markdown"), "markdown", "left_anti").select(F.lit(None).cast("string").alias("pdf"), "markdown", F.lit("ORPHAN_MARKDOWN").alias("reason"))
    missing = overrides.join(p.select(F.col("pdf").alias("pdf_filename")), "pdf_filename", "left_anti").select(F.col("pdf_filename").alias("pdf"), F.col("markdown_filename").alias("markdown"), F.lit("OVERRIDE_MISSING_PDF").alias("reason"))
    return reduce(DataFrame.unionByName, [out, orphans, missing])


def headed_blocks(documents: DataFrame) -> DataFrame:
    """``document_id, block_no, text``: blocks between blank lines, headings joined to what follows them."""
    b = documents.select("document_id", F.posexplode(split_blocks(F.col("text"))).alias("n", "text"))
    only = F.forall(F.split("text", "\n"), lambda line: F.ltrim(line).startswith("#"))
    order = Window.partitionBy("document_id").orderBy(F.desc("n"))
    b = b.withColumn("head", only).withColumn("next", F.last(F.when(~F.col("head"), F.col("n")), ignorenulls=True).over(order))
    part = F.coalesce("next", F.lit(1 << 30))
    return b.groupBy("document_id", part.alias("block_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
