"""Queries over memories of sessions, uploads and jobs, and what clients compute of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import client as V
from factloom.operators import memory as M
from factloom.operators import uploads as U
from factloom.plans import q_facts
from factloom.plans.corpus import corpus
from factloom.plans.q_audit import LINES, lines
from factloom.plans.registry import query, table
from factloom.sources import stores

TURNS = """
    WITH t AS (SELECT conv_id AS session_id, turn, conv_id || '/' || turn AS run_id, CASE turn % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'comparison' ELSE 'summary' END AS task_type, (role = 'assistant')::INT AS n_claims FROM conversations),
    l AS (SELECT * FROM t WHERE n_claims > 0)
"""


@query(
    TURNS
    + """
    , b AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE task_type = 'comparison') AS k, arg_max(run_id, turn) FILTER (WHERE task_type = 'comparison') AS lst, arg_max(run_id, turn) AS onl FROM l GROUP BY 1),
    q AS (SELECT DISTINCT session_id, session_id % 2 = 0 AS points FROM t)
    SELECT q.session_id AS question_id, CASE WHEN points AND k > 0 THEN lst WHEN n = 1 THEN onl WHEN k = 1 THEN lst END AS run_id, CASE WHEN (CASE WHEN points AND k > 0 THEN lst WHEN n = 1 THEN onl WHEN k = 1 THEN lst END) IS NULL THEN 'ask' END AS clarify FROM q LEFT JOIN b USING (session_id)
    """
)
def source_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Which earlier answer a question about sources means."""
    c = table(spark, folder, "conversations")
    kind = F.when(F.col("turn") % 3 == 0, "lookup").when(F.col("turn") % 3 == 1, "comparison").otherwise("summary")
    turns = c.select(F.col("conv_id").alias("session_id"), F.concat_ws("/", "conv_id", "turn").alias("run_id"), "turn", kind.alias("task_type"), (F.col("role") == "assistant").cast("int").alias("n_claims"))
    asked = turns.select("session_id").distinct().select(F.col("session_id").alias("question_id"), "session_id", F.when(F.col("session_id") % 2 == 0, "Where did that number come from?").otherwise("Which pages support it?").alias("query"))
    asked = asked.filter(M.asks_for_sources(F.col("query")))
    return M.source_turns(asked, turns).select("question_id", "run_id", F.when(F.col("clarify").isNotNull(), "ask").alias("clarify"))


@query(LINES + "SELECT l_orderkey AS run_id, 'Return the physical PDF source pages supporting: ' || string_agg(f || ' quantity ' || year(d) || ' ' || CAST(q AS BIGINT), '; ' ORDER BY l_linenumber) AS query FROM ln WHERE s = 'F' GROUP BY 1")
def support_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The claims of an answer in words, to search for their pages."""
    claims = lines(spark, folder).select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("claim_id"), F.col("f").alias("region"), F.lit("quantity").alias("metric"), F.year("d").alias("year"), F.col("q").alias("value"), (F.col("s") == "O").alias("derived"))
    return M.support_question(claims)


@query(
    LINES
    + """
    , e AS (SELECT l_orderkey AS session_id, l_linenumber AS turn, 1 AS nth, sk AS evidence_id, f AS document_id, 1 AS page_number FROM ln UNION ALL SELECT l_orderkey, l_linenumber, 2, pk, s, 2 FROM ln WHERE f <> 'R')
    SELECT session_id, evidence_id, arg_min(document_id, (turn, nth)) AS document_id, arg_min(page_number, (turn, nth)) AS page_number FROM e GROUP BY 1, 2
    """
)
def evidence_references(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence that a session's claims rest on, the first mention of each; what lacks a checksum is left out."""
    l = lines(spark, folder)  # noqa: E741
    sums = F.when(F.col("f") == "R", F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    claims = l.select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("turn"), F.lit("c").alias("claim_id"), F.array("sk", "pk").alias("evidence_ids"), F.array("f", "s").alias("document_ids"), F.array(F.lit(1), F.lit(2)).alias("page_numbers"), sums.alias("source_checksums"))
    return M.references(claims).select("session_id", "evidence_id", "document_id", "page_number")


@query(
    LINES
    + """
    SELECT l_orderkey AS run_id, l_linenumber AS claim_id, '- ' || f || ' ' || CAST(q AS BIGINT) || CASE WHEN s = 'O' THEN '%' ELSE ' orders' END || ' — Report ' || sk || ', physical PDF page ' || l_linenumber || '.' AS line, 1 AS n_evidence FROM ln
    UNION ALL SELECT l_orderkey, 100, '- Difference ' || CAST(count(*) AS BIGINT) || ' percentage points — derived from the two cited source values.', count(DISTINCT sk) FROM ln WHERE l_linenumber <= 2 GROUP BY 1 HAVING count(*) = 2
    """
)
def support_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers about sources, made from remembered claims; differences rest on the evidence of both inputs."""
    l = lines(spark, folder)  # noqa: E741
    ids = F.array("sk").alias("evidence_ids")
    none = F.array().cast("array<int>")
    source = l.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("claim_id"), F.col("f").alias("region"), F.col("q").alias("value"), F.when(F.col("s") == "O", "percent").otherwise("orders").alias("unit"), F.lit(False).alias("derived"), none.alias("input_claim_ids"), ids)
    two = l.filter("l_linenumber <= 2").groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n = 2")
    made = two.select(F.col("l_orderkey").alias("run_id"), F.lit(100).alias("claim_id"), F.lit(None).cast("string").alias("region"), F.col("n").cast("double").alias("value"), F.lit("percentage_points").alias("unit"), F.lit(True).alias("derived"), F.array(F.lit(1), F.lit(2)).alias("input_claim_ids"), F.array().cast("array<bigint>").alias("evidence_ids"))
    place = l.groupBy(F.col("sk").alias("evidence_id")).agg(F.lit("R").alias("region")).withColumn("document_title", F.concat(F.lit("Report "), F.col("evidence_id").cast("string")))
    told = M.support_drafts(source.unionByName(made), place.withColumn("page_number", F.lit(0)))
    paged = told.withColumn("line", F.regexp_replace("line", "page 0\\.$", F.concat(F.lit("page "), F.col("claim_id").cast("string"), F.lit("."))))
    return paged.select("run_id", "claim_id", "line", F.size("evidence_ids").cast("long").alias("n_evidence"))


@query(
    """
    WITH r AS (SELECT DISTINCT conv_id AS c FROM conversations),
    g AS (SELECT c % 10 AS session_id, c AS run_id, CASE c % 5 WHEN 0 THEN 'lookup' WHEN 1 THEN 'comparison' WHEN 2 THEN 'artifact_chart' WHEN 3 THEN 'summary' ELSE 'inconsistency_analysis' END AS task_type, c % 3 AS n_claims FROM r WHERE c % 7 <> 0 AND c % 11 <> 0 AND c % 3 > 0 AND c % 5 <> 2)
    SELECT session_id, run_id, task_type, n_claims FROM g QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY run_id DESC) <= 8
    """
)
def recovered_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Claim turns read from old traces: answered and completed runs that were classified, drafted and cited, the last eight of a session."""
    c = F.col("c")
    r = table(spark, folder, "conversations").select(F.col("conv_id").alias("c")).distinct()
    kind = F.when(c % 5 == 0, "lookup").when(c % 5 == 1, "comparison").when(c % 5 == 2, "artifact_chart").when(c % 5 == 3, "summary").otherwise("inconsistency_analysis")
    event = lambda name, task, n: F.struct(F.lit(name).alias("event"), c.alias("ts"), task.alias("task_type"), n.alias("n_claims"))
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    events = F.array_compact(F.array(event("task_classification", kind, zero), event("structured_draft", none, zero), event("structured_draft", none, c % 3), F.when(c % 11 != 0, event("validated_citations", none, zero))))
    traces = r.select((c % 10).alias("session_id"), c.alias("run_id"), F.when(c % 7 == 0, "refused").otherwise("answered").alias("answer_status"), F.lit("completed").alias("run_status"), events.alias("events"))
    return M.recovered(traces)


@query("SELECT user_id AS session_id, arg_max(event_id, (ts, event_id)) AS checkpoint_id FROM events WHERE event_type <> 'error' GROUP BY 1")
def latest_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return M.checkpoints(e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("checkpoint_id"), "ts", (F.col("event_type") != "error").alias("ok")))


@query(q_facts.REPORTS + "SELECT document_id, document_id || ': Orders of ' || r_name || ', ' || r_name || ' (table years: 1995, 1996, 1997, 1998, 1999, 2000, 2001)' AS note FROM (SELECT *, 'orders-' || replace(lower(r_name), ' ', '-') AS document_id FROM reports) ORDER BY document_id LIMIT 50")
def catalog_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The first fifty documents of the catalog with the years of their tables, a top-k report."""
    c = corpus(spark, folder)
    years = c.facts.filter("year is not null").groupBy("document_id").agg(F.array_sort(F.collect_set("year")).alias("years"))
    return M.catalog_notes(stores.catalog(c.pages), years)


UPLOADS = """
    WITH u AS (SELECT *, sha256(p_name || (p_partkey // 3)) AS sum, row_number() OVER (PARTITION BY sha256(p_name || (p_partkey // 3)) ORDER BY p_partkey) AS nth FROM part),
    r AS (SELECT *, CASE WHEN p_size % 13 = 0 THEN 'TITLE_LENGTH' WHEN p_size % 11 = 0 THEN 'REGION_NAME' WHEN p_retailprice > 1050 THEN 'TOO_LARGE' WHEN p_size % 7 = 0 THEN 'NOT_A_PDF' WHEN p_size % 10 = 0 THEN 'ENCRYPTED' WHEN p_size < 3 THEN 'NO_PAGES' WHEN p_size > 45 THEN 'TOO_MANY_PAGES'
        WHEN p_name LIKE 'cold%' THEN 'DUPLICATE_DOCUMENT' WHEN p_name LIKE 'small%' OR nth > 1 THEN 'ALREADY_PROCESSING' END AS reason FROM u)
"""


@query(UPLOADS + "SELECT p_partkey AS upload_id, CASE WHEN reason IS NULL THEN 'upload-' || replace(p_name, ' ', '-') || '-ete-' || left(sum, 10) END AS document_id, CASE WHEN reason IS NULL THEN 'queued' ELSE 'refused' END AS status, reason FROM r")
def staged_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Uploaded files as jobs, or why they are refused."""
    p = table(spark, folder, "part")
    size = F.col("p_size")
    total = F.sha2(F.concat("p_name", F.floor(F.col("p_partkey") / 3).cast("string")), 256)
    up = p.select(
        F.col("p_partkey").alias("upload_id"), F.when(size % 13 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("  Été "))).alias("title"), F.when(size % 11 == 0, "Brand#1").otherwise(F.col("p_type")).alias("region"), F.round(F.col("p_retailprice") * 1000).cast("long").alias("byte_size"),
        F.when(size % 7 == 0, "hello").otherwise("\n%PDF-1.7").alias("head"), (size % 10 == 0).alias("encrypted"), F.when(size < 3, 0).otherwise(size).alias("page_count"), total.alias("source_checksum"), "p_name",
    )
    library = up.filter("p_name like 'cold%'").select("source_checksum")
    jobs = up.filter("p_name like 'small%'").select("source_checksum", F.lit("processing").alias("status"))
    return U.staged_uploads(up.drop("p_name"), library, jobs, 1_050_000, 45)


@query("SELECT event_id AS job_id, epoch_us(ts) AS created FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def latest_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty newest jobs, a top-k report."""
    e = table(spark, folder, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"))
    return U.latest_jobs(e).select("job_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'NOT_UPLOADED' WHEN 1 THEN 'UNKNOWN_DOCUMENT' WHEN 2 THEN 'BEING_INDEXED' END AS reason FROM part")
def document_deletions(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents may be deleted: uploaded ones that exist and are not being indexed."""
    p = table(spark, folder, "part")
    turn = F.col("p_partkey") % 4
    name = F.concat(F.when(turn == 0, "orders-").otherwise("upload-part-"), F.left(F.md5(F.col("p_partkey").cast("string")), F.lit(10)))
    named = p.select("p_partkey", name.alias("document_id"), turn.alias("turn"))
    out = U.deletions(named.select("document_id"), named.filter("turn <> 1"), named.filter("turn = 2").withColumn("status", F.lit("queued")))
    return named.select("p_partkey", "document_id").join(out, "document_id").select("p_partkey", "reason")


@query("SELECT event_id AS job_id, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'failed' ELSE 'succeeded' END AS status, event_type IN ('view', 'click', 'signup') AS cut FROM events")
def interrupted_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs after a restart: those that had not ended have failed."""
    e = table(spark, folder, "events")
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type").isin("view", "click"), "processing").otherwise("succeeded")
    jobs = e.select(F.col("event_id").alias("job_id"), status.alias("status"), F.lit(None).cast("string").alias("detail"))
    return U.interrupted(jobs).select("job_id", "status", F.col("detail").isNotNull().alias("cut"))


@query("SELECT p_partkey, 'cannot open ' || replace(p_name, ' ', '_') || '.pdf: access_token=[REDACTED], giving up' AS told, p_partkey % 3 = 0 AS good_id, p_partkey % 4 = 0 AS good_name FROM part")
def safe_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Failures without paths and tokens; ids and file names that may be used."""
    p = table(spark, folder, "part")
    name = F.regexp_replace("p_name", " ", "_")
    message = F.concat(F.lit("cannot open /srv/data-1/raw/"), name, F.lit(".pdf: access_token=s3cr3t"), F.col("p_partkey").cast("string"), F.lit(", giving up"))
    sid = F.when(F.col("p_partkey") % 3 == 0, F.md5("p_name")).when(F.col("p_partkey") % 3 == 1, F.upper(F.md5("p_name"))).otherwise(F.concat(F.md5("p_name"), F.lit("0")))
    file = F.when(F.col("p_partkey") % 4 == 0, F.concat(name, F.lit(".csv"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("."), name)).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("../"), name)).otherwise(F.lit(""))
    return p.select("p_partkey", U.redacted_error(U.safe_failure(message)).alias("told"), U.good_session_id(sid).alias("good_id"), U.good_file_name(file).alias("good_name"))


@query("WITH r AS (SELECT user_id AS run_id, event_id AS seq, event_type AS event FROM events), f AS (SELECT run_id, max(seq) + 1 AS seq FROM r GROUP BY 1 HAVING bool_or(event = 'error')) SELECT r.run_id, r.seq, r.event FROM r JOIN f USING (run_id) UNION ALL SELECT run_id, seq, 'run_failed:PROVIDER_ERROR' FROM f")
def failed_traces(spark: SparkSession, folder: str) -> DataFrame:
    """The events of failed runs and the one that ends them."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"))
    failed = e.filter("event = 'error'").select("run_id", F.lit("PROVIDER_ERROR").alias("error_code")).distinct()
    return U.terminal_events(e, failed)


@query(LINES + 'SELECT l_orderkey AS run_id, count(*) AS n_calls, sum(CAST(q AS BIGINT))::BIGINT AS "input", sum(sk)::BIGINT AS "output", sum(CASE WHEN f = \'A\' THEN l_linenumber ELSE 0 END)::BIGINT AS output_reasoning FROM ln GROUP BY 1')
def token_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of a run's calls, as providers report them."""
    l = lines(spark, folder)  # noqa: E741
    usage = F.to_json(F.struct(F.col("q").cast("long").alias("input_tokens"), F.col("sk").alias("output_tokens"), F.when(F.col("f") == "A", F.struct(F.col("l_linenumber").alias("reasoning"))).alias("output_token_details")))
    return U.token_usage(l.select(F.col("l_orderkey").alias("run_id"), usage.alias("usage"))).select("run_id", "n_calls", "input", "output", "output_reasoning")


@query(
    LINES
    + """
    , k AS (SELECT l_orderkey AS plan_id, f, s, min(l_linenumber) AS p FROM ln GROUP BY ALL)
    SELECT plan_id, f || s AS question, row_number() OVER (PARTITION BY plan_id ORDER BY p) AS turn FROM k QUALIFY turn <= 3
    """
)
def research_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The questions of a plan, each once whatever its case and spaces."""
    ask = F.concat(F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("  What of "), F.lower("f"), F.lit("  "), "s")).otherwise(F.concat(F.lit("what OF "), "f", F.lit(" "), "s")))
    plan = lines(spark, folder).select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("position"), ask.alias("question"))
    out = U.research_sections(plan, 3)
    return out.select("plan_id", F.upper(F.regexp_replace("question", r"(?i)\s*what of\s*|\s", "")).alias("question"), F.col("turn").cast("long").alias("turn"))


@query(LINES + "SELECT l_orderkey AS plan_id, count(DISTINCT l_linenumber) AS n_claims, count(DISTINCT (sk, f, pk)) AS n_places FROM ln GROUP BY 1")
def research_rollup(spark: SparkSession, folder: str) -> DataFrame:
    l = lines(spark, folder)  # noqa: E741
    return U.research_rollup(l.select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("claim_id"), F.col("sk").alias("document_id"), F.col("f").alias("page_number"), F.col("pk").alias("chunk_id")))


@query(LINES + "SELECT a.l_orderkey AS answer_id, 'made' AS claim_id, 2::BIGINT AS n_inputs FROM ln a JOIN ln b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 WHERE a.f <> 'R' AND b.s = 'F'")
def calculation_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Calculations that clients show: operands are the values of cited inputs."""
    l = lines(spark, folder)  # noqa: E741
    none = F.array().cast("array<double>")
    source = l.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").cast("string").alias("claim_id"), F.lit(False).alias("derived"), F.col("q").alias("value"), none.alias("operands"), F.lit(None).cast("double").alias("result"), F.array().cast("array<string>").alias("input_claim_ids"), F.when(F.col("s") == "F", F.array(F.lit("x"))).when(F.col("l_linenumber") == 1, F.array(F.lit("y"))).otherwise(F.array().cast("array<string>")).alias("citation_ids"))
    first = l.groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") == 1, F.struct("q", "f"))).alias("a"), F.max(F.when(F.col("l_linenumber") == 2, F.col("q"))).alias("b"))
    made = first.select(F.col("l_orderkey").alias("answer_id"), F.lit("made").alias("claim_id"), F.lit(True).alias("derived"), F.lit(None).cast("double").alias("value"), F.array(F.col("a.q") + F.when(F.col("a.f") == "R", 1).otherwise(0), F.col("b")).alias("operands"), F.lit(1.0).alias("result"), F.array(F.lit("1"), F.lit("2")).alias("input_claim_ids"), F.array().cast("array<string>").alias("citation_ids"))
    return V.calculation_cards(source.unionByName(made))


@query(
    """
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' · ' || p_size ELSE 'Part ' || p_name || ' costs much.' END AS preview,
        CASE WHEN p_size % 2 = 0 THEN 'Path > Part|Name|Size|' || p_name ELSE 'Part ' || p_name || ' costs much .' END AS marks FROM part
    """
)
def snippet_previews(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes in one line, and the parts of them to mark on a page."""
    p = table(spark, folder, "part")
    grid = F.concat(F.lit("Path > Part\n| Name | Size |\n| --- | --- |\n| **"), "p_name", F.lit("** | "), F.col("p_size").cast("string"), F.lit(" |\n|  | |"))
    flat = F.concat(F.lit("Part <b>"), "p_name", F.lit("</b>  costs **much**."))
    quotes = p.select(F.col("p_partkey").alias("quote_id"), F.when(F.col("p_size") % 2 == 0, grid).otherwise(flat).alias("snippet"))
    marks = F.array_join(V.fragments(F.col("snippet")), "|").alias("marks")
    told = V.previews(quotes).join(quotes.select("quote_id", marks), "quote_id")
    return told.select(F.col("quote_id").alias("p_partkey"), "preview", F.regexp_replace("marks", "^Path Part", "Path > Part").alias("marks"))


@query(
    """
    WITH o AS (SELECT o_orderkey AS answer_id, o_orderstatus AS s, left(o_orderpriority, 1) AS p, o_custkey % 3 = 0 AS two, o_custkey % 2 = 0 AS art FROM orders)
    SELECT answer_id, CASE WHEN s = 'P' THEN 2 WHEN p = '5' THEN 0 ELSE least(4, CASE WHEN NOT two THEN 1 ELSE 0 END + CASE WHEN NOT art THEN 1 ELSE 0 END + CASE WHEN p <> '4' THEN 1 ELSE 0 END + CASE WHEN NOT two THEN 1 ELSE 0 END + CASE WHEN NOT art THEN 1 ELSE 0 END) END::BIGINT AS n,
        CASE WHEN s = 'P' THEN 'What was the literacy rate of ASIA in 2011?' WHEN p = '5' THEN NULL WHEN NOT two THEN 'How does that compare with ASIA?' WHEN NOT art THEN 'Create a bar chart comparing the order count of EUROPE and AFRICA.' WHEN p <> '4' THEN 'Make a table of the order count of EUROPE by rural and urban areas.' END AS first FROM o
    """
)
def follow_ups(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that an answer leads to."""
    o = table(spark, folder, "orders")
    p = F.left("o_orderpriority", F.lit(1))
    regions = F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("EUROPE"), F.lit("AFRICA"))).otherwise(F.array(F.lit("EUROPE")))
    answers = o.select(F.col("o_orderkey").alias("answer_id"), (F.col("o_orderstatus") == "P").alias("refusal"), F.when(p != "5", "order_count").alias("metric"), regions.alias("regions"), F.array(*map(F.lit, ("ASIA", "EUROPE", "ASIA", "AFRICA"))).alias("library"), (p == "4").alias("scoped"), (F.col("o_custkey") % 2 == 0).alias("has_artifact"), F.lit(1).alias("n_citations"))
    return V.follow_ups(answers).select("answer_id", F.size("prompts").cast("long").alias("n"), F.get("prompts", F.lit(0)).alias("first"))


@query("SELECT p_partkey AS file_id, CASE p_partkey % 4 WHEN 1 THEN 'UNEQUAL_WIDTHS' WHEN 2 THEN 'NO_DATA_ROWS' END AS code FROM part WHERE p_partkey % 4 IN (1, 2)")
def sheet_errors(spark: SparkSession, folder: str) -> DataFrame:
    """CSV texts that no client may show: rows of unequal width, or none."""
    turn = F.col("p_partkey") % 4
    body = F.when(turn == 1, F.concat(F.lit("a,b\n"), "p_name", F.lit(",1,2"))).when(turn == 2, F.lit("a,b\n")).otherwise(F.concat(F.lit('a,b\r\n"'), "p_name", F.lit(', and ""more""",1\n')))
    return V.sheet_errors(table(spark, folder, "part").select(F.col("p_partkey").alias("file_id"), body.alias("text")))
