"""Queries over the smaller parts: pairs of files, notes of converters, blocks, follow-ups, sets of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import analyzer as A
from factloom.operators import events as E
from factloom.operators import evidence as V
from factloom.operators import facts as N
from factloom.operators import index as X
from factloom.operators import pages as P
from factloom.operators import quotes as Q
from factloom.operators import retrieval as R
from factloom.plans.corpus import corpus
from factloom.plans.q_audit import LINES, lines
from factloom.plans.q_facts import CELLS, REPORTS, _scopes
from factloom.plans.q_retrieval import TOP, _asked, _items, bm25_sql
from factloom.plans.registry import query, table
from factloom.plans.staging import shared_folder
from factloom.sources import artifacts, stores


@query(
    """
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'AMBIGUOUS_STEM' WHEN 4 THEN 'ORPHAN_MARKDOWN' WHEN 5 THEN 'OVERRIDE_MISSING_PDF' END AS reason, CASE WHEN p_partkey % 6 IN (1, 2) THEN TRUE ELSE FALSE END AS paired FROM part
    """
)
def document_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Files of two kinds paired by override or stem; what is wrong with the rest."""
    p = table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 6).alias("turn"), F.col("p_partkey").cast("string").alias("k"))
    name = lambda some, *parts: p.filter(some).select(F.concat(*[F.lit(x) if x != "k" else F.col("k") for x in parts]).alias("path"))
    pdfs = name("turn = 0", "a/Doc One ", "k", ".pdf").unionByName(name("turn = 0", "b/doc-one-", "k", ".pdf")).unionByName(name("turn = 1", "Sole ", "k", ".pdf")).unionByName(name("turn = 2", "told-", "k", ".pdf")).unionByName(name("turn = 3", "lone-", "k", ".pdf"))
    texts = name("turn = 1", "SOLE_", "k", ".md").unionByName(name("turn = 2", "other-", "k", ".md")).unionByName(name("turn = 4", "orphan-", "k", ".md"))
    told = p.filter("turn in (2, 5)").select(F.when(F.col("turn") == 2, F.concat(F.lit("told-"), "k", F.lit(".pdf"))).otherwise(F.concat(F.lit("gone-"), "k", F.lit(".pdf"))).alias("pdf_filename"), F.concat(F.lit("other-"), "k", F.lit(".md")).alias("markdown_filename"))
    out = P.discovered(pdfs, texts, told)
    key = F.regexp_extract(F.coalesce("pdf", "markdown"), r"([0-9]+)\.[a-z]+$", 1).cast("long")
    return out.groupBy(key.alias("p_partkey")).agg(F.min("reason").alias("reason"), F.bool_or(F.col("pdf").isNotNull() & F.col("markdown").isNotNull() & F.col("reason").isNull()).alias("paired"))


@query(
    """
    WITH d AS (SELECT o_orderkey AS document_id, o_custkey % 5 AS k FROM orders)
    SELECT document_id, CASE k WHEN 1 THEN 'PAGE_COUNT' WHEN 2 THEN 'SKIPPED_PAGE' WHEN 3 THEN 'SKIPPED_COUNT' WHEN 4 THEN 'BLOCK_COUNT' END AS reason, CASE WHEN k = 0 THEN '1:a,3:b' END AS pages FROM d
    """
)
def converter_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by a converter's own note, and notes that contradict themselves."""
    k = F.col("o_custkey") % 5
    note = F.when(k == 0, "Pages converted: 2/3 Skipped: [2]").when(k == 1, "Pages converted: 2/4 Skipped: [2]").when(k == 2, "Pages converted: 2/3 Skipped: [7]").when(k == 3, "Pages converted: 3/3 Skipped: [2]").otherwise("Pages converted: 3/3")
    docs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("document_id"), note.alias("text"), F.lit(3).alias("page_count"), F.array(F.lit("a"), F.lit("b")).alias("blocks"))
    out = P.converter_pages(docs)
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("page_number").isNotNull(), F.struct("page_number", "text")))), lambda x: F.concat_ws(":", x["page_number"].cast("string"), x["text"])), ",")
    return out.groupBy("document_id").agg(F.min("reason").alias("reason"), F.nullif(told, F.lit("")).alias("pages"))


@query("SELECT p_partkey AS document_id, n, CASE n WHEN 0 THEN '# ' || p_name || chr(10) || chr(10) || '## ' || p_brand || chr(10) || chr(10) || 'Body of ' || p_name ELSE '# End' END AS text FROM part, (VALUES (0), (1)) t(n)")
def headed_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of a text with the headings before them; a last heading stands alone."""
    text = F.concat(F.lit("# "), "p_name", F.lit("\n\n## "), "p_brand", F.lit("\n\nBody of "), "p_name", F.lit("\n\n# End"))
    b = P.headed_blocks(table(spark, folder, "part").select(F.col("p_partkey").alias("document_id"), text.alias("text")))
    first = F.min("block_no").over(Window.partitionBy("document_id"))
    return b.select("document_id", F.when(F.col("block_no") == first, 0).otherwise(1).alias("n"), "text")


@query(LINES + ", e AS (SELECT l_orderkey AS query_id, sk AS chunk_id, 0 AS source_no FROM ln WHERE f = 'A' UNION ALL SELECT l_orderkey, sk, 1 FROM ln WHERE f <> 'A') SELECT query_id, chunk_id, min(source_no) AS source_no FROM e GROUP BY ALL")
def first_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of several searches: the first search that found a chunk has it."""
    l = lines(spark, folder).select(F.col("l_orderkey").alias("query_id"), F.col("sk").alias("chunk_id"), "f")  # noqa: E741
    key = F.concat_ws("/", "query_id", "chunk_id").alias("key")
    part = lambda some: l.filter(some).select(key, "query_id", "chunk_id")
    return R.first_wins([part("f = 'A'"), part("f <> 'A'")], "key").select("query_id", "chunk_id", "source_no")


@query(
    """
    WITH o AS (SELECT o_orderkey AS session_id, o_custkey % 3 AS k, left(o_orderpriority, 1) AS p FROM orders)
    SELECT session_id, CASE k WHEN 0 THEN 'ASIA,EUROPE' WHEN 1 THEN 'ASIA' ELSE 'EUROPE' END AS regions, CASE WHEN p = '1' THEN 'sex ratio' ELSE 'literacy rate' END AS metric, 'persons' AS population, CASE WHEN p = '2' THEN 'rural' ELSE 'total' END AS residence, CASE WHEN k = 2 THEN 'lookup' WHEN p = '3' THEN 'ranking' ELSE 'comparison' END AS kind FROM o
    """
)
def merged_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Follow-up questions with what the question before them said and they don't; a ranking stays one."""
    o = table(spark, folder, "orders")
    k, p = F.col("o_custkey") % 3, F.left("o_orderpriority", F.lit(1))
    none = F.lit(None).cast("string")
    arr = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    new = o.select(F.col("o_orderkey").alias("session_id"), F.when(k == 0, arr("ASIA", "EUROPE")).when(k == 1, arr("ASIA")).otherwise(arr("EUROPE")).alias("regions"), F.when(p == "1", "sex ratio").when(k == 2, "literacy rate").otherwise(none).alias("metric"), F.when(k == 2, "persons").otherwise(none).alias("population"), F.when(p == "2", "rural").when(k == 2, "total").otherwise(F.lit("")).alias("residence"), F.when(k == 2, "lookup").otherwise("comparison").alias("kind"))
    old = o.filter("o_custkey % 3 <> 2").select(F.col("o_orderkey").alias("session_id"), F.when(k == 0, arr("EUROPE")).otherwise(arr()).alias("regions"), F.lit("literacy rate").alias("metric"), F.lit("persons").alias("population"), F.lit("total").alias("residence"), F.when(p == "3", "ranking").otherwise("lookup").alias("kind"))
    return A.merged_requirement(old, new).select("session_id", F.array_join("regions", ",").alias("regions"), "metric", "population", "residence", "kind")


@query(LINES + "SELECT l_orderkey AS answer_id, bool_and(f <> 'R') AS supported, count(*) FILTER (WHERE f = 'N' AND q < 25) = 0 AND count(*) FILTER (WHERE f = 'A' AND s = 'F' AND q > 45) = 0 AS parted FROM ln GROUP BY 1")
def support_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an answer's sources are those that were expected, and whether supported and unsupported claims part all claims."""
    l = lines(spark, folder).groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.collect_set("l_linenumber").alias("every"), F.collect_set(F.when(F.col("f") != "R", F.col("l_linenumber"))).alias("found"), F.collect_set(F.when(F.col("f") == "A", F.col("l_linenumber"))).alias("yes"), F.collect_set(F.when((F.col("f") == "R") | ((F.col("f") == "N") & (F.col("q") >= 25)) | ((F.col("f") == "A") & (F.col("s") == "F") & (F.col("q") > 45)), F.col("l_linenumber"))).alias("no"))  # noqa: E741
    return l.select("answer_id", V.same_members(F.col("every"), F.col("found")).alias("supported"), Q.parted(F.col("every"), F.col("yes"), F.col("no")).alias("parted"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'scheduled tribes' ELSE '' END AS unasked, CASE WHEN p_size % 2 = 0 THEN p_size || '.0,1234567.0' ELSE p_size || '.0' END AS numbers FROM part")
def unasked_subgroups(spark: SparkSession, folder: str) -> DataFrame:
    """Subgroups that a text is about and the request isn't; the numbers that it states."""
    p = table(spark, folder, "part")
    text = F.concat(F.lit("Size "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, " of Scheduled Tribes").otherwise(" of scheduled castes"), F.when(F.col("p_size") % 2 == 0, ", out of 12,34,567.").otherwise("."))
    return p.select("p_partkey", F.array_join(A.unrequested_subgroups(text, F.lit("sizes of scheduled castes")), ",").alias("unasked"), F.array_join(F.transform(T.numbers(text), lambda x: F.format_string("%.1f", x)), ",").alias("numbers"))


@query(LINES + ", a AS (SELECT l_orderkey AS artifact_id, l_linenumber, f FROM ln) SELECT artifact_id, 3 - count(*) FILTER (WHERE l_linenumber <= 3) AS n_missing, count(*) FILTER (WHERE l_linenumber > 3) AS n_extra FROM a GROUP BY 1 HAVING count(*) FILTER (WHERE l_linenumber <= 3) < 3 OR count(*) FILTER (WHERE l_linenumber > 3) > 0")
def artifact_files(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts whose files are not exactly those of their kind."""
    n = F.col("l_linenumber")
    name = F.when(n == 1, "table.csv").when(n == 2, "table.md").when(n == 3, "source-manifest.json").otherwise(F.concat(F.lit(".hidden"), n.cast("string")))
    found = lines(spark, folder).select(F.col("l_orderkey").alias("artifact_id"), name.alias("name"))
    return artifacts.missing_files(found, "table").select("artifact_id", F.size("missing").cast("long").alias("n_missing"), F.size("extra").cast("long").alias("n_extra"))


@query(REPORTS + "SELECT 'orders-' || replace(lower(r_name), ' ', '-') AS document_id, k AS statement, CASE k WHEN 2 THEN 'dollars per order' ELSE 'persons' END AS unit, CASE WHEN k = 3 THEN 'scheduled castes' ELSE '' END AS subgroups, 21::BIGINT AS n_columns FROM reports, (VALUES (1), (2), (3)) t(k)")
def column_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units and subgroups of value columns, read from headers and titles."""
    c = corpus(spark, folder)
    of = c.tables.select("document_id", "page_number", "block_no", F.col("statement").cast("int").alias("statement"))
    met = c.columns.join(of, ["document_id", "page_number", "block_no"])
    return met.groupBy("document_id", "statement", "unit", F.array_join("qualifiers", ",").alias("subgroups")).agg(F.count("*").alias("n_columns"))


@query(LINES + "SELECT l_orderkey AS run_id, l_linenumber, CASE WHEN s = 'O' AND f = 'R' THEN 'citation_validation_failed' WHEN s = 'O' AND q > 25 THEN 'artifact_generation_failed' WHEN s = 'O' THEN 'insufficient_evidence' END AS reason FROM ln")
def refusal_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why completed runs refused."""
    return lines(spark, folder).select(F.col("l_orderkey").alias("run_id"), "l_linenumber", E.refusal_reason(F.col("s") == "O", F.col("f") == "R", F.col("q") > 25).alias("reason"))


@query("SELECT event_id, '{\"kind\":\"' || event_type || '\"}' AS details FROM events")
def trace_allowed(spark: SparkSession, folder: str) -> DataFrame:
    """Details of events under allowed names alone."""
    e = table(spark, folder, "events")
    details = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("note"), F.col("props"), F.lit("user_token"), F.col("event_type"))
    return e.select("event_id", F.to_json(E.allowed_details(details, ("kind", "user_token"))).alias("details"))


@query(
    """
    WITH p AS (SELECT doc_id, doc_id % 6 AS k FROM documents WHERE length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) > 0)
    SELECT doc_id AS chunk_id, CASE k WHEN 1 THEN 'bad_page' WHEN 2 THEN 'bad_checksum' WHEN 3 THEN 'unsafe_status' WHEN 4 THEN 'snippet_not_in_text' ELSE 'unverified_ocr' END AS errors FROM p WHERE k > 0 ORDER BY doc_id LIMIT 25
    """
)
def audit_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as points with one field spoilt in turns: the first 25 that an audit lists."""
    return X.audit_errors(_spoilt(spark, folder)).select("chunk_id", F.array_join("errors", ",").alias("errors"))


@query(
    """
    WITH p AS (SELECT doc_id, doc_id % 6 AS k, source FROM documents WHERE length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) > 0)
    SELECT count(*) + count(*) FILTER (WHERE doc_id % 50 = 0) AS n_points, sum((k = 1)::INT + (k = 1 AND doc_id % 50 = 0)::INT)::BIGINT AS bad_page, sum((k = 2)::INT + (k = 2 AND doc_id % 50 = 0)::INT)::BIGINT AS bad_checksum, sum((k = 4)::INT + (k = 4 AND doc_id % 50 = 0)::INT)::BIGINT AS snippet_not_in_text,
        count(*) FILTER (WHERE doc_id % 50 = 0) AS repeated_ids, sum((source = 'src1' AND k <> 1)::INT + (source = 'src1' AND k <> 1 AND doc_id % 50 = 0)::INT)::BIGINT AS excluded_page FROM p
    """
)
def index_audit(spark: SparkSession, folder: str) -> DataFrame:
    """All rules over documents as points: some spoilt, some there twice, the pages of one source excluded."""
    points = _spoilt(spark, folder)
    twice = points.unionByName(points.filter("chunk_id % 50 = 0"))
    excluded = points.select("document_id").distinct().filter("document_id = 'src1'").select("document_id", F.lit(1).alias("page_number"))
    return X.audit(twice, 0, excluded).select("n_points", "bad_page", "bad_checksum", "snippet_not_in_text", "repeated_ids", "excluded_page")


def _spoilt(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").filter(F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))) > 0)
    k = F.col("doc_id") % 6
    return d.select(
        F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("document_id"), F.lit("Title").alias("document_title"), F.col("source").alias("region"), F.when(k == 1, 0).otherwise(1).alias("page_number"), F.array().cast("array<string>").alias("section_path"), F.lit(0).alias("chunk_index"),
        F.when(k == 4, "0xFFFF not there").otherwise(F.left("text", F.lit(30))).alias("citation_snippet"), F.when(k == 5, "unverified_ocr").otherwise("provided_markdown").alias("extraction_method"), F.when(k == 2, "abc").otherwise(F.sha2("text", 256)).alias("source_checksum"), F.when(k == 3, "excluded_blank").otherwise("indexed_markdown").alias("coverage_status"),
    ).filter(F.trim("citation_snippet") != "")


@query("WITH p AS (SELECT doc_id, source FROM documents WHERE source <> 'src3' AND doc_id % 5 <> 0) SELECT s AS document_id, (SELECT count(*) FROM p WHERE source = s) AS n_points FROM (SELECT DISTINCT source AS s FROM documents)")
def index_deletions(spark: SparkSession, folder: str) -> DataFrame:
    """An index without a document and without some points: how many each document has left."""
    p = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"))
    left = X.without(p, p.filter("document_id = 'src3'"), p.filter("chunk_id % 5 = 0"))
    return X.document_counts(left, p.select("document_id").distinct())


@query("SELECT o_orderkey AS document_id, CASE o_custkey % 4 WHEN 0 THEN 'CHECKSUM_MISMATCH' WHEN 1 THEN 'DUPLICATE_PAGE' END AS reason FROM orders WHERE o_custkey % 4 < 2")
def review_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews that can't stand: of another version of a file, or two of one page."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 4).alias("k"), F.md5(F.col("o_orderkey").cast("string")).alias("source_checksum"))
    pages = F.explode(F.when(F.col("k") == 1, F.array(F.lit(1), F.lit(2), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2))))
    reviews = o.select("document_id", pages.alias("page_number"), F.when(F.col("k") == 0, F.upper("source_checksum")).otherwise(F.col("source_checksum")).alias("source_checksum"))
    return P.review_errors(o, reviews)


@query(
    bm25_sql()
    + """
    , f AS (SELECT query_id, query_id % 2 = 0 AS filtered, source, coalesce(text, '') AS text FROM bm JOIN documents ON doc_id = chunk_id WHERE rank < 5),
    c AS (SELECT query_id, bool_and(NOT filtered OR source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9')) AS kept, bool_or(filtered) AS filtered FROM f GROUP BY 1)
    SELECT round(count(*) FILTER (WHERE kept AND filtered) / count(*) FILTER (WHERE filtered), 6) AS filter_accuracy, (SELECT round(count(*) FILTER (WHERE length(text) % 3 <> 0) / count(*), 6) FROM f) AS citation_accuracy FROM c
    """
)
def retrieval_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """How many filtered cases an unfiltered search gets right, and how many results can be cited (a third have a spoilt snippet)."""
    items = _items(spark, folder).withColumn("text", F.coalesce("text", F.lit("")))
    found = R.bm25_leg(_asked(spark, folder), items, R.leg_size(TOP)).filter(F.col("rank") < TOP).join(items, "chunk_id")
    regions = F.array(*[F.lit(f"src{k}") for k in range(10)])
    cases = _asked(spark, folder).select(F.col("query_id").alias("case_id"), F.when(F.col("query_id") % 2 == 0, regions).alias("regions"))
    snippet = F.when(F.length("text") % 3 == 0, "0xFFFF not there").otherwise(F.left("text", F.lit(40)))
    return R.filter_accuracy(cases, found.withColumnRenamed("query_id", "case_id").withColumn("citation_snippet", snippet))


@query("WITH r AS (SELECT user_id || '-' || event_type AS run_id, count(*) AS n FROM events GROUP BY 1) SELECT run_id, CASE WHEN n = 1 THEN 'trace of ' || run_id END AS trace, n % 2 = 0 AS positive FROM r UNION ALL SELECT 'nobody', NULL, NULL")
def trace_store(spark: SparkSession, folder: str) -> DataFrame:
    """Traces written by session and read by run: only an unmistakable one is given; and the last rating of each."""
    at = f"{shared_folder(spark)}/staged/traces-{uuid.uuid4().hex}"
    e = table(spark, folder, "events")
    run = F.concat_ws("-", "user_id", "event_type")
    stores.write_traces(e.select(F.col("user_id").cast("string").alias("session_id"), run.alias("run_id"), F.concat(F.lit("trace of "), run).alias("trace")), at)
    runs = e.select(run.alias("run_id")).distinct()
    asked = runs.unionByName(spark.range(1).select(F.lit("nobody").alias("run_id")))
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id"))
    rated = e.select(run.alias("run_id"), "ts", "event_id").withColumn("nth", nth).select("run_id", F.col("ts").alias("rated_at"), F.col("event_id").alias("feedback_id"), (F.col("nth") % 2 == 0).alias("positive"))
    return stores.read_traces(spark, at, asked).join(stores.latest_feedback(rated), "run_id", "left").select("run_id", "trace", "positive")


@query(CELLS + "SELECT r_name || '/' || res AS spec_id, y AS year, CASE WHEN r_name LIKE 'ASIA %' THEN 'TABLE_STORE_MISSING_OR_STALE' END AS reason, CASE WHEN r_name NOT LIKE 'ASIA %' THEN value END AS value FROM cells WHERE aggregate AND statement = 1 AND y IN (1996, 2000)")
def live_year_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of years against chunks some of which have changed since."""
    c = corpus(spark, folder)
    changed = c.chunks.withColumn("text", F.when(F.col("region").startswith("ASIA "), F.regexp_replace("text", r"\|", "||")).otherwise(F.col("text")))
    cells = N.live_cells(N.year_cells(_scopes(spark, folder), c.facts), changed)
    return cells.select("spec_id", F.col("year").cast("long").alias("year"), "reason", F.col("value").cast("double").alias("value"))


@query("WITH t AS (SELECT l_orderkey AS query_id, l_returnflag AS target, min(l_partkey) AS p FROM lineitem GROUP BY ALL) SELECT query_id, CASE WHEN count(*) > 2 THEN 'TOO_MANY_TARGETS' ELSE 'TARGET_DOES_NOT_FIT' END AS reason FROM t GROUP BY 1 HAVING count(*) > 2 OR sum(50 + p % 50) > 120")
def unfit_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Requests whose required targets do not fit the budget."""
    t = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("target")).agg(F.min("l_partkey").alias("p"))
    items = t.select("query_id", "target", F.col("target").alias("region"), F.concat_ws("/", "query_id", "target").alias("item_id"), F.lit(1.0).alias("score"), F.repeat(F.lit("x"), (50 + F.col("p") % 50).cast("int")).alias("text"))
    return V.unfit_targets(items, t.select("query_id", "target"), max_chars=120, max_chunks=2)
