"""Queries over sessions, events, pages and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import analyzer as A
from factloom.operators import events as E
from factloom.operators import index as X
from factloom.operators import pages as P
from factloom.operators import sessions as S
from factloom.plans.registry import query, table

NOW = "timestamp '2024-02-01 00:00:00'"


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    """One session for each conversation; every fourth is a child of the one before it."""
    ids = table(spark, folder, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("session_id") * 7919, F.lit(40)) * 86_400 * 3 / 2)
    return ids.select("session_id", F.when(F.col("session_id") % 4 == 3, F.col("session_id") - 1).alias("parent_id"), at.alias("updated_at"), F.lit(None).cast("string").alias("title"))


SESSIONS = """
    WITH m AS (SELECT conv_id AS session_id, turn, role, coalesce(text, '') AS text FROM conversations),
    s AS (SELECT DISTINCT session_id, CASE WHEN session_id % 4 = 3 THEN session_id - 1 END AS parent_id, make_timestamp(CAST(floor(1704067200 + ((session_id * 7919) % 40) * 86400 * 1.5) AS BIGINT) * 1000000) AS updated_at FROM m)
"""


@query(SESSIONS + "SELECT s.session_id, count(*) AS n_messages, epoch(updated_at)::BIGINT AS updated FROM s JOIN m USING (session_id) WHERE parent_id IS NULL GROUP BY s.session_id, updated_at ORDER BY updated_at DESC, s.session_id LIMIT 20")
def list_recent(spark: SparkSession, folder: str) -> DataFrame:
    """The latest twenty top-level sessions, a top-k report."""
    out = S.list_recent(_sessions(spark, folder), _messages(spark, folder))
    return out.select("session_id", "n_messages", F.unix_seconds("updated_at").alias("updated"))


@query(SESSIONS + "SELECT session_id, turn, role FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 8")
def history_last8(spark: SparkSession, folder: str) -> DataFrame:
    return S.last_turns(_messages(spark, folder)).select("session_id", "turn", "role")


@query(SESSIONS + f"SELECT session_id FROM s WHERE updated_at < {NOW} - INTERVAL 30 DAYS")
def stale_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return S.stale(_sessions(spark, folder), F.expr(NOW)).select("session_id")


@query(
    SESSIONS
    + f"""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 7 THEN 'Previous 7 days' WHEN d < 30 THEN 'Previous 30 days' ELSE 'Older' END AS bucket
    FROM (SELECT date_diff('day', CAST(updated_at AS DATE), CAST({NOW} AS DATE)) AS d FROM s)) GROUP BY 1"""
)
def session_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return _sessions(spark, folder).groupBy(S.age_bucket(F.col("updated_at"), F.expr(NOW)).alias("bucket")).agg(F.count("*").alias("n"))


@query(SESSIONS + "SELECT session_id, CASE WHEN n <= 6 THEN n ELSE 3 END AS n_kept, CASE WHEN n <= 6 THEN 0 ELSE n - 3 END AS n_summarised FROM (SELECT session_id, count(*) AS n FROM m GROUP BY 1)")
def message_pruning(spark: SparkSession, folder: str) -> DataFrame:
    return S.pruned(_messages(spark, folder), over=6, keep=3)


@query(SESSIONS + "SELECT session_id, string_agg(role || ': ' || left(text, 1200), chr(10) ORDER BY turn) AS context FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 8) GROUP BY 1")
def context_window(spark: SparkSession, folder: str) -> DataFrame:
    return S.context_window(_messages(spark, folder))


@query(
    SESSIONS
    + r"""
    , u AS (SELECT session_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\s+', ' ', 'g') AS t FROM m WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn) = 1)
    SELECT s.session_id, CASE WHEN t IS NULL THEN NULL WHEN length(t) <= 60 THEN t ELSE regexp_replace(CASE WHEN contains(left(t, 60), ' ') THEN regexp_replace(left(t, 60), ' [^ ]*$', '') ELSE left(t, 60) END, '[ ,.;:]+$', '') || '…' END AS title
    FROM s LEFT JOIN u USING (session_id)
    """
)
def session_titles(spark: SparkSession, folder: str) -> DataFrame:
    return S.titled(_sessions(spark, folder), _messages(spark, folder)).select("session_id", "title")


@query(SESSIONS + "SELECT session_id, count(*) FILTER (WHERE role = 'assistant') AS n_answers, bool_or(role = 'user' AND regexp_matches(lower(text), '\\b(?:compare|versus|vs|than|between)\\b')) AS any_comparison FROM m GROUP BY 1")
def session_status(spark: SparkSession, folder: str) -> DataFrame:
    return S.status(_messages(spark, folder))


@query(SESSIONS + "SELECT session_id, CASE WHEN session_id % 5 = 0 THEN 'renamed' END AS title FROM s WHERE session_id % 7 <> 0")
def session_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions after one in five is renamed and one in seven deleted."""
    old = _sessions(spark, folder)
    new = old.filter("session_id % 5 = 0").withColumn("title", F.lit("renamed"))
    return S.without(S.merged(old, new, "session_id"), old.filter("session_id % 7 = 0"), "session_id").select("session_id", "title")


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a trace: each user's day is a run."""
    e = table(spark, folder, "events")
    return e.withColumn("run_id", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))


RUNS = "WITH r AS (SELECT *, user_id || '/' || strftime(ts, '%Y-%m-%d') AS run_id FROM events)"


@query(RUNS + " SELECT run_id, count(*) AS n_events, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds FROM r GROUP BY 1")
def trace_duration(spark: SparkSession, folder: str) -> DataFrame:
    return E.durations(_runs(spark, folder))


@query("SELECT event_type, p, n FROM (SELECT event_type, value AS p, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE i = greatest(0, CAST(round_even(n * 0.95, 0) AS BIGINT) - 1)")
def latency_p95(spark: SparkSession, folder: str) -> DataFrame:
    """The 95th percentile as an exact value, by nearest rank."""
    return E.nearest_rank(table(spark, folder, "events").filter("value is not null"), ["event_type"], "value")


@query("SELECT event_type, median(value) AS median, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def median_latency(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    means = events.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"))
    return means.join(E.median(events, ["event_type"], "value"), "event_type", "left").select("event_type", "median", "mean")


JOBS = """
    WITH j AS (SELECT event_id, ts, user_id * 100 + CAST(json_extract(props, '$.k') AS BIGINT) AS job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status FROM events),
    d AS (SELECT *, coalesce(max(CASE WHEN status = 'succeeded' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM j)
"""


@query(JOBS + "SELECT job_id, arg_max(status, (ts, event_id)) AS status, count(*) FILTER (WHERE status = 'queued') AS n_queued FROM d WHERE done = 0 GROUP BY 1")
def job_latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state of upload jobs after all their events; success ends a job."""
    kind = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type").isin("view", "click"), "processing").when(F.col("event_type") == "purchase", "succeeded").otherwise("failed")
    job = F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("long")
    return E.latest_state(table(spark, folder, "events").select("event_id", "ts", job.alias("job_id"), kind.alias("status"))).select("job_id", "status", "n_queued")


@query(RUNS + ", t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS turn FROM r) SELECT run_id, count(*) AS n_calls, count(*) FILTER (WHERE turn > 2) AS n_over FROM t GROUP BY 1")
def tool_budget(spark: SparkSession, folder: str) -> DataFrame:
    calls = E.tool_budget(_runs(spark, folder), 2)
    return calls.groupBy("run_id").agg(F.count("*").alias("n_calls"), F.count_if("limit_exceeded").alias("n_over"))


@query(RUNS + ", k AS (SELECT *, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'refused' END AS kind FROM r) SELECT run_id, coalesce(arg_max(kind, (ts, event_id)) FILTER (WHERE kind IS NOT NULL), 'running') AS status FROM k GROUP BY 1")
def run_status(spark: SparkSession, folder: str) -> DataFrame:
    return E.run_status(_runs(spark, folder), {"error": "error", "purchase": "completed", "signup": "refused"})


@query("SELECT event_id, '{\"event\":\"' || event_type || '\"}' AS details FROM events")
def trace_sanitised(spark: SparkSession, folder: str) -> DataFrame:
    """Details of events without names that may hold secrets, and without long values."""
    e = table(spark, folder, "events")
    details = F.create_map(F.lit("event"), F.col("event_type"), F.lit("api_key"), F.col("props"), F.lit("prompt_text"), F.col("event_type"), F.lit("dump"), F.repeat(F.lit("x"), F.lit(E.VALUE_CHARS + 1)))
    return e.select("event_id", F.to_json(E.safe_details(details)).alias("details"))


@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def events_windowed(spark: SparkSession, folder: str) -> DataFrame:
    out = E.windowed(table(spark, folder, "events"))
    return out.select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY 1")
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return E.sessions(table(spark, folder, "events"), "6 hours").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as Markdown with a page marker before every third line."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    mark = lambda line, i: F.when(i % 3 == 0, F.concat(F.when(i % 2 == 0, F.format_string("<!-- page: %d -->\n", (i / 3).cast("int") + 1)).otherwise(F.format_string("[page %d]\n", (i / 3).cast("int") + 1)), line)).otherwise(line)
    return table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), F.array_join(F.transform(lines, mark), "\n").alias("text"))


@query(
    r"""
    WITH l AS (SELECT doc_id AS document_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents)
    SELECT document_id, i // 3 + 1 AS page_number, 1::BIGINT AS n_markers, md5(regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+', ''), '\s+$', '')) AS text_md5 FROM l GROUP BY 1, 2
    """
)
def page_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Texts cut into pages at their markers, read back."""
    return P.marked_pages(_marked(spark, folder)).select("document_id", F.col("page_number").cast("long").alias("page_number"), "n_markers", F.md5("text").alias("text_md5"))


@query(
    """
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
    b AS (SELECT doc_id AS document_id, i AS block_no, regexp_extract_all(lower(line), '[a-z0-9]+') AS ts FROM l WHERE trim(line) <> ''),
    p AS (SELECT doc_id AS document_id, i // 4 AS page_number, list_reduce(list(regexp_extract_all(lower(line), '[a-z0-9]+') ORDER BY i), lambda x, y: list_concat(x, y)) AS ts FROM l GROUP BY ALL),
    bw AS (SELECT document_id, block_no, w, count(*) AS nb FROM (SELECT document_id, block_no, unnest(ts) AS w FROM b) GROUP BY ALL),
    pw AS (SELECT document_id, page_number, w, count(*) AS np FROM (SELECT document_id, page_number, unnest(ts) AS w FROM p) GROUP BY ALL),
    s AS (SELECT bw.document_id, block_no, page_number, sum(least(nb, np)) AS shared FROM bw JOIN pw USING (document_id, w) GROUP BY ALL),
    c AS (SELECT s.document_id, s.block_no, s.page_number, round(CASE WHEN len(b.ts) >= 4 AND contains(' ' || array_to_string(p.ts, ' ') || ' ', array_to_string(b.ts, ' ')) THEN 1.0 ELSE shared / len(b.ts) END, 6) AS score
          FROM s JOIN b USING (document_id, block_no) JOIN p ON p.document_id = s.document_id AND p.page_number = s.page_number),
    r AS (SELECT *, row_number() OVER w AS turn, coalesce(lead(score) OVER w, 0) AS second FROM c WINDOW w AS (PARTITION BY document_id, block_no ORDER BY score DESC, page_number)),
    o AS (SELECT document_id, min(page_number) AS only FROM p GROUP BY 1 HAVING min(page_number) = max(page_number))
    SELECT b.document_id, b.block_no, CASE WHEN o.only IS NOT NULL THEN o.only WHEN r.score >= 0.75 AND r.score - second >= 0.15 THEN r.page_number END AS page_number, coalesce(r.score, 0) AS score
    FROM b LEFT JOIN (SELECT * FROM r WHERE turn = 1) r ON r.document_id = b.document_id AND r.block_no = b.block_no LEFT JOIN o ON o.document_id = b.document_id
    """
)
def align_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents put back on their pages of four lines, by their words."""
    d = table(spark, folder, "documents")
    lines = d.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "line")).withColumn("i", F.col("i").cast("long"))
    blocks = lines.filter(F.trim("line") != "").select("document_id", F.col("i").alias("block_no"), F.col("line").alias("text"))
    pages = lines.groupBy("document_id", F.floor(F.col("i") / 4).alias("page_number")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return P.alignment(blocks, pages)


@query(
    """
    WITH l AS (SELECT l_orderkey AS d, l_linenumber AS p, max(l_returnflag) AS f, min(l_returnflag) AS g, max(l_linestatus) AS s FROM lineitem GROUP BY ALL),
    x AS (SELECT o_orderkey AS document_id, r.p, CASE WHEN g = 'R' THEN 'approved_manual_transcription' WHEN f = 'A' THEN 'excluded_blank' WHEN l.d IS NOT NULL AND s = 'O' THEN 'indexed_markdown' WHEN l.d IS NOT NULL THEN 'indexed_fallback' ELSE 'failed_page_mapping' END AS status
          FROM orders, (SELECT unnest(range(1, 8)) AS p) r LEFT JOIN l ON l.d = o_orderkey AND l.p = r.p)
    SELECT document_id, count(*) AS n_pages, round(count(*) FILTER (WHERE regexp_matches(status, '^(indexed_|approved_)')) / count(*) * 100, 2) AS percent_indexed,
        count(*) FILTER (WHERE status = 'indexed_markdown') AS n_indexed_markdown, count(*) FILTER (WHERE status = 'approved_manual_transcription') AS n_approved_manual_transcription, count(*) FILTER (WHERE status = 'excluded_blank') AS n_excluded_blank, count(*) FILTER (WHERE status = 'failed_page_mapping') AS n_failed_page_mapping
    FROM x GROUP BY 1
    """
)
def coverage_report(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by precedence of transcription, decision, supplied text and fallback; counts by status."""
    docs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("document_id"), F.md5(F.col("o_orderkey").cast("string")).alias("source_checksum"), F.lit(7).alias("page_count"))
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number")).agg(F.max("l_returnflag").alias("f"), F.min("l_returnflag").alias("g"), F.max("l_linestatus").alias("s")).withColumn("source_checksum", F.md5(F.col("document_id").cast("string")))
    text = F.concat(F.lit("line "), F.col("page_number").cast("string")).alias("text")
    key = ["document_id", "page_number", "source_checksum"]
    pages = P.mapped_pages(docs, lines.filter("s = 'O'").select(*key, text), lines.select(*key, text), lines.filter("f = 'A'").select(*key, F.lit("excluded_blank").alias("coverage_status")), lines.filter("g = 'R'").select(*key, text))
    return P.coverage_report(pages).select("document_id", "n_pages", "percent_indexed", "n_indexed_markdown", "n_approved_manual_transcription", "n_excluded_blank", "n_failed_page_mapping")


def _points(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"))


@query("SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE sha256(coalesce(text, '')) END AS content FROM documents")
def upsert_merge(spark: SparkSession, folder: str) -> DataFrame:
    old = _points(spark, folder)
    return X.upsert(old, old.filter("chunk_id % 3 = 0").withColumn("content", F.lit("new"))).select("chunk_id", "content")


@query("SELECT source AS document_id, doc_id AS chunk_id FROM documents WHERE doc_id % 3 <> 0 AND source IN (SELECT source FROM documents WHERE doc_id % 3 = 0)")
def stale_ids(spark: SparkSession, folder: str) -> DataFrame:
    old = _points(spark, folder)
    return X.stale_ids(old, old.filter("chunk_id % 3 = 0"))


@query("SELECT source AS document_id, source NOT IN ('src1', 'src2') AS skip FROM documents GROUP BY 1")
def idempotent_skip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose chunks are as they were are skipped; one changed chunk is enough not to."""
    def state(points: DataFrame) -> DataFrame:
        prints = X.fingerprints(points.select(F.col("chunk_id").alias("chunk_index"), "document_id", "content"))
        return prints.withColumns({"source_checksum": F.md5("document_id"), "version": F.lit(1)})

    old = _points(spark, folder)
    first = old.filter(F.col("document_id").isin("src1", "src2")).groupBy("document_id").agg(F.min("chunk_id").alias("first"))
    new = old.join(F.broadcast(first), "document_id", "left").withColumn("content", F.when(F.col("chunk_id") == F.col("first"), "changed").otherwise(F.col("content"))).drop("first")
    return X.unchanged(state(old), state(new))


@query("WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT sha256(text) AS h FROM d WHERE doc_id % 2 = 0) SELECT doc_id AS chunk_id FROM d WHERE sha256(text) NOT IN (SELECT h FROM c)")
def embedding_cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Texts whose content isn't cached; copies of cached ones are."""
    items = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    empty = spark.createDataFrame([], "cache_key string")
    cache = X.embedding_misses(items.filter("chunk_id % 2 = 0"), empty, "model", 64).select("cache_key").distinct()
    return X.embedding_misses(items, cache, "model", 64).select("chunk_id")


@query(
    r"""
    SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+', ''), '-+$', '') AS slug,
        h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][(('0x' || h[17:17])::INT % 4) + 1] || h[18:20] || '-' || h[21:32] AS uuid
    FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(p_name)) AS h FROM part)
    """
)
def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Default ids: the name as a slug, and a UUID made from it."""
    p = table(spark, folder, "part")
    return p.select("p_partkey", T.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"), T.uuid5(T.URL_NAMESPACE, F.col("p_name")).alias("uuid"))


@query(
    r"""
    WITH t AS (SELECT p_partkey, 'Rates of ' || p_name || 's, ' || lower(p_type) || ' (number per 100 males) 2001-11 and ' || (1990 + p_size) || ' to ' || (1995 + p_size) AS t FROM part),
    w AS (SELECT p_partkey, t, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(lower(t), '\([^()]*\bper\b[^()]*\)', ' ', 'g'), '\b((?:19|20)[0-9]{2})\s*-\s*((?:19|20)?[0-9]{2})\b', ' ', 'g'), '\b(?:19|20)[0-9]{2}\b', ' ', 'g'), '[a-z0-9]+')) AS w FROM t),
    s AS (SELECT p_partkey, CASE WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(?:ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END AS w FROM w)
    SELECT p_partkey, (SELECT string_agg(DISTINCT w, ' ' ORDER BY w) FROM s WHERE s.p_partkey = t.p_partkey AND w NOT IN ('of', 'and', 'to', 'number', 'male')) AS words,
        array_to_string(list_distinct([2001, 1990 + CAST(regexp_extract(t, 'and ([0-9]+) to', 1) AS INT) - 1990, CAST(regexp_extract(t, 'to ([0-9]+)$', 1) AS INT)]), '|') IS NOT NULL AS has_years FROM t
    """
)
def metric_words(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    size = F.col("p_size")
    t = F.concat(F.lit("Rates of "), F.col("p_name"), F.lit("s, "), F.lower("p_type"), F.lit(" (number per 100 males) 2001-11 and "), (1990 + size).cast("string"), F.lit(" to "), (1995 + size).cast("string"))
    return p.select("p_partkey", F.array_join(T.metric_words(t), " ").alias("words"), (F.size(T.named_years(t)) > 0).alias("has_years"))


@query("WITH t AS (SELECT o_orderkey, year(o_orderdate) AS y FROM orders) SELECT o_orderkey, y || '|' || (y + 3) AS years, TRUE AS is_change, y + 3 > 2001 AS beyond FROM t")
def named_years(spark: SparkSession, folder: str) -> DataFrame:
    """Years that a question names, whether it asks for a change, and whether it goes beyond the corpus."""
    y = F.year("o_orderdate")
    t = F.concat(F.lit("How did orders change between "), y.cast("string"), F.lit(" and "), (y + 3).cast("string"), F.lit(", from "), y.cast("string"), F.lit("?"))
    years = T.named_years(t)
    return table(spark, folder, "orders").select("o_orderkey", F.array_join(F.transform(years, lambda v: v.cast("string")), "|").alias("years"), T.is_year_change(t).alias("is_change"), (F.size(A.beyond(years, F.lit(2001))) > 0).alias("beyond"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (WHERE round_even(CAST(l_extendedprice AS DECIMAL(18,2)), 1) = round_even(CAST(round(l_extendedprice, 1) AS DECIMAL(18,1)), 1)) AS n_compatible FROM lineitem GROUP BY ALL")
def compatible_rounding(spark: SparkSession, folder: str) -> DataFrame:
    """Prices beside what they round to at one place."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    short = F.round(F.col("l_extendedprice").cast("decimal(18,2)"), 1).cast("decimal(18,1)")
    return table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.count_if(T.compatible_rounding(price, short)).alias("n_compatible"))
