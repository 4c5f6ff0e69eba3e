"""Queries over ingested reports: chunks, facts, selections, rankings, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import chunking, facts, tables
from factloom.plans.corpus import corpus
from factloom.plans.registry import query, table
from factloom.plans.staging import staged
from factloom.sources import reports

YEAR = 1997
DOCUMENT = "concat('orders-', replace(lower(r_name), ' ', '-'))"
#: All cells of the reports, from the base tables (a printed name is read without emphasis marks): statement 1 counts, 2 average prices, 3 counts of one segment.
REPORTS = f"WITH blocks AS (SELECT DISTINCT c_custkey // {reports.BLOCK} AS b FROM customer), reports AS (SELECT r_regionkey, b, r_name || ' ' || b AS r_name FROM region, blocks)"
CELLS = REPORTS + f""",
    o AS (
        SELECT r_name || ' ' || (c_custkey // {reports.BLOCK}) AS r_name, n_name, n_nationkey, year(o_orderdate) AS y, o_orderstatus = 'O' AS rural, CAST(round(o_totalprice * 100) AS HUGEINT) AS cents, c_mktsegment = 'BUILDING' AS seg
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    grid AS (
        SELECT r_name, n_name, y, res FROM reports JOIN nation ON n_regionkey = r_regionkey, (SELECT unnest(range(1995, 2002)) AS y), (SELECT unnest(['total', 'rural', 'urban']) AS res)),
    hits AS (
        SELECT g.r_name, g.n_name, g.y, g.res, o.cents, o.seg
        FROM grid g LEFT JOIN o ON o.n_name = g.n_name AND o.r_name = g.r_name AND o.y = g.y AND (g.res = 'total' OR (g.res = 'rural') = o.rural)),
    sums AS (
        SELECT r_name, coalesce(replace(n_name, '_', ''), r_name) AS entity, n_name IS NULL AS aggregate, y, res, count(cents) AS n, count(cents) FILTER (WHERE seg) AS n_seg, coalesce(sum(cents), 0) AS cents
        FROM hits GROUP BY GROUPING SETS ((r_name, n_name, y, res), (r_name, y, res))),
    cells AS (
        SELECT r_name, replace(lower(r_name), ' ', '-') AS slug, entity, aggregate, y, res, 1 AS statement, CAST(n AS DOUBLE) AS value FROM sums
        UNION ALL SELECT r_name, replace(lower(r_name), ' ', '-'), entity, aggregate, y, res, 2, CASE WHEN n = 0 THEN 0.0 ELSE CAST((2 * cents + n) // (2 * n) AS DOUBLE) / 100 END FROM sums
        UNION ALL SELECT r_name, replace(lower(r_name), ' ', '-'), entity, aggregate, y, res, 3, CAST(n_seg AS DOUBLE) FROM sums)
"""


def specs(spark: SparkSession, folder: str) -> DataFrame:
    """Requests for each report: good ones and ones that must be refused."""
    documents = corpus(spark, folder).pages.select("document_id", "region").distinct()
    kinds = F.array(
        *[
            F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(("name", "metric", "year", "residence", "population", "entity_kind"), row, ("string", "string", "int", "string", "string", "string"), strict=True)])
            for row in (
                ("count", "order count", YEAR, None, None, "district"),
                ("rural", "number of orders count", YEAR, "rural", None, "district"),
                ("price", "average price", YEAR, "urban", None, "district"),
                ("segment", "order count of scheduled castes", YEAR, None, None, "district"),
                ("blank", "the number of persons in 2001", YEAR, None, None, "district"),
                ("unknown", "literacy rate", YEAR, None, None, "district"),
                ("late", "order count", 2011, None, None, "district"),
                ("sex", "order count", YEAR, None, "females", "district"),
                ("state", "order count", YEAR, None, None, "state"),
            )
        ]
    )
    return documents.select("document_id", "region", F.explode(kinds).alias("k")).select(F.concat_ws("/", "document_id", "k.name").alias("spec_id"), "document_id", "region", "k.metric", "k.year", "k.residence", "k.population", "k.entity_kind")


def selection(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus(spark, folder)
    return facts.select_columns(specs(spark, folder), facts.column_health(c.columns, c.rows, c.facts))


@query(CELLS + "SELECT 'orders-' || slug AS document_id, entity, aggregate, statement, y AS year, res AS residence, value FROM cells")
def facts_total(spark: SparkSession, folder: str) -> DataFrame:
    f = corpus(spark, folder).facts
    return f.select("document_id", "entity", "aggregate", F.col("statement").cast("int").alias("statement"), "year", "residence", F.col("value").cast("double").alias("value"))


@query(REPORTS + "SELECT 'orders-' || replace(lower(r_name), ' ', '-') AS document_id, y AS year FROM reports, (SELECT unnest(range(1995, 2002)) AS y)")
def census_years(spark: SparkSession, folder: str) -> DataFrame:
    return tables.census_years(corpus(spark, folder).facts).select("document_id", F.explode("years").alias("year")).withColumn("year", F.col("year").cast("long"))


@query(REPORTS + "SELECT 'orders-' || replace(lower(r_name), ' ', '-') AS document_id, 'bound' AS state, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) * 3 + 3 AS n FROM reports")
def row_binding(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of tables by whether one chunk alone holds their line."""
    rows = corpus(spark, folder).rows
    state = F.when(F.col("malformed"), "malformed").when(F.col("chunk_id").isNull(), "unbound").otherwise("bound")
    return rows.groupBy("document_id", state.alias("state")).agg(F.count("*").alias("n"))


@query(
    """
    WITH p AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> '' AS says FROM documents)
    SELECT count(*) FILTER (WHERE says AND doc_id % 10 <> 0 AND doc_id % 10 <> 1) AS n_pages, count(*) FILTER (WHERE doc_id % 10 = 0 OR doc_id % 10 = 1 AND says) AS n_unsafe_pages, 0::BIGINT AS n_unsafe_chunks, 0::BIGINT AS n_repeated_ids FROM p
    """
)
def chunk_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages, some of them unverified and some excluded: every other page with text has chunks; none is unsafe, no id repeats."""
    turn = F.regexp_extract("document_id", "[0-9]+$", 0).cast("long") % 10
    pages = reports.prose_pages(spark, folder).withColumn("extraction_method", F.when(turn == 0, "unverified_ocr").otherwise(F.col("extraction_method"))).withColumn("coverage_status", F.when(turn == 1, "excluded_blank").otherwise(F.col("coverage_status")))
    unsafe = staged(chunking.unsafe_pages(pages), "unsafe")
    made = staged(chunking.chunk_pages(pages.join(unsafe.select("document_id", "page_number"), ["document_id", "page_number"], "left_anti")), "made")
    repeated = made.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated_ids"))
    sums = made.select("document_id", "page_number").distinct().agg(F.count("*").alias("n_pages"))
    bad = chunking.unsafe_chunks(made).agg(F.count("*").alias("n_unsafe_chunks"))
    return sums.crossJoin(bad).crossJoin(unsafe.agg(F.count("*").alias("n_unsafe_pages"))).crossJoin(repeated).select("n_pages", "n_unsafe_pages", "n_unsafe_chunks", "n_repeated_ids")


@query()
def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).chunks


@query()
def prose_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All of ``documents``, in page-bounded chunks."""
    return chunking.chunk_pages(reports.prose_pages(spark, folder)).select("chunk_id", "document_id", "chunk_index", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), F.sha2("citation_snippet", 256).alias("snippet_sha256"))


@query(
    REPORTS
    + """,
    k(name, status, reason) AS (VALUES ('count', 'ok', NULL), ('rural', 'ok', NULL), ('price', 'ok', NULL), ('segment', 'ok', NULL), ('blank', 'refused', 'TABLE_METRIC_UNRECOGNIZED'),
        ('unknown', 'refused', 'TABLE_NO_MATCHING_COLUMN'), ('late', 'refused', 'TABLE_NO_MATCHING_COLUMN'), ('sex', 'refused', 'TABLE_NO_MATCHING_COLUMN'), ('state', 'refused', 'TABLE_NO_MATCHING_COLUMN'))
    SELECT 'orders-' || replace(lower(r_name), ' ', '-') || '/' || name AS spec_id, status, reason FROM reports, k
    """
)
def select_column(spark: SparkSession, folder: str) -> DataFrame:
    """One column for each request, or the reason why none."""
    return selection(spark, folder).select("spec_id", "status", "reason")


def _ranks(spark: SparkSession, folder: str) -> DataFrame:
    return facts.ranked(facts.selected_facts(selection(spark, folder), corpus(spark, folder).facts))


RANKED = CELLS + f"""
    , r AS (SELECT CASE WHEN statement = 1 AND res = 'total' THEN 'count' WHEN statement = 1 AND res = 'rural' THEN 'rural' WHEN statement = 2 AND res = 'urban' THEN 'price' WHEN statement = 3 AND res = 'total' THEN 'segment' END AS name, * FROM cells WHERE y = {YEAR} AND NOT aggregate),
    k AS (SELECT 'orders-' || slug || '/' || name AS spec_id, *, rank() OVER (PARTITION BY slug, name ORDER BY value DESC) AS rnk FROM r WHERE name IS NOT NULL)
"""


@query(RANKED + "SELECT spec_id, entity, value, rnk AS rank FROM k")
def rank_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: which nation of each region ranks where, from the printed tables alone."""
    return _ranks(spark, folder).select("spec_id", "entity", F.col("value").cast("double").alias("value"), F.col("rank").cast("long").alias("rank"))


@query(RANKED + "SELECT spec_id, string_agg(entity, ' and ' ORDER BY entity) AS winners, count(*) AS n_winners FROM k WHERE rnk = 1 GROUP BY spec_id")
def rank_ties(spark: SparkSession, folder: str) -> DataFrame:
    told = facts.ranking_sentence(_ranks(spark, folder))
    return told.select("spec_id", F.array_join("winners", " and ").alias("winners"), F.size("winners").cast("long").alias("n_winners"))


@query(RANKED + "SELECT spec_id, count(*) AS n_rows, count(*) AS n_cited FROM k GROUP BY spec_id")
def ranking_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of a ranking quotes a line that its chunk still has, verbatim, with the value in it."""
    c = corpus(spark, folder)
    checked = facts.still_cited(facts.selected_facts(selection(spark, folder), c.facts).filter("not aggregate"), c.chunks)
    cited = ~F.col("stale") & F.col("line").contains(F.col("raw_value"))
    return checked.groupBy("spec_id").agg(F.count("*").alias("n_rows"), F.count_if(cited).alias("n_cited"))


def _scopes(spark: SparkSession, folder: str) -> DataFrame:
    regions = corpus(spark, folder).pages.select("region").distinct()
    kinds = F.array(*[F.struct(F.lit(r).alias("residence")) for r in T.RESIDENCES])
    return regions.select("region", F.explode(kinds).alias("k")).select(F.concat_ws("/", "region", "k.residence").alias("spec_id"), "region", F.lit("order count").alias("metric"), F.array(F.lit(1996), F.lit(2000)).alias("years"), "k.residence")


@query(CELLS + "SELECT r_name || '/' || res AS spec_id, y AS year, value, row_number() OVER (PARTITION BY r_name, res ORDER BY y DESC) AS turn FROM cells WHERE aggregate AND statement = 1 AND y IN (1996, 2000)")
def year_cells(spark: SparkSession, folder: str) -> DataFrame:
    cells = facts.year_cells(_scopes(spark, folder), corpus(spark, folder).facts)
    return cells.filter("reason is null").select("spec_id", F.col("year").cast("long").alias("year"), F.col("value").cast("double").alias("value"), F.col("turn").cast("long").alias("turn"))


@query(CELLS + "SELECT a.r_name || '/' || a.res AS spec_id, a.value - b.value AS change, CASE WHEN b.value <> 0 THEN round((a.value - b.value) / b.value * 100, 6) END AS percent FROM cells a JOIN cells b ON a.r_name = b.r_name AND a.res = b.res AND a.entity = b.entity AND a.statement = b.statement WHERE a.aggregate AND a.statement = 1 AND a.y = 2000 AND b.y = 1996")
def year_change(spark: SparkSession, folder: str) -> DataFrame:
    """Change between two years: the later minus the earlier."""
    cells = facts.year_cells(_scopes(spark, folder), corpus(spark, folder).facts).filter("reason is null")
    both = cells.groupBy("spec_id").agg(F.max(F.when(F.col("turn") == 1, F.col("value"))).alias("left"), F.max(F.when(F.col("turn") == 2, F.col("value"))).alias("right"))
    return both.select("spec_id", facts.difference(F.col("left"), F.col("right")).cast("double").alias("change"), facts.percentage_difference(F.col("left"), F.col("right")).alias("percent"))


@query(CELLS + "SELECT a.r_name AS left_region, b.r_name AS right_region, a.y AS year, a.value - b.value AS gap, CASE WHEN a.value >= b.value THEN 'higher' ELSE 'lower' END AS verdict FROM cells a JOIN cells b ON regexp_extract(a.r_name, '[0-9]+$') = regexp_extract(b.r_name, '[0-9]+$') AND a.r_name < b.r_name AND a.res = b.res AND a.y = b.y AND a.statement = b.statement WHERE a.aggregate AND b.aggregate AND a.statement = 1 AND a.res = 'total'")
def comparison_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Regions held against each other within a block of customers, in every year, with the sentence that says so."""
    f = corpus(spark, folder).facts.filter("aggregate and statement = '1' and residence = 'total'")
    side = lambda name: f.select(F.substring_index("region", " ", -1).alias("block"), "year", F.col("region").alias(f"{name}_region"), F.col("value").alias(name), F.col("metric").alias(f"{name}_metric"))
    pairs = side("left").join(side("right"), ["block", "year"]).filter("left_region < right_region")
    gap = facts.difference(F.col("left"), F.col("right"))
    said = facts.comparison_sentence(F.col("left_region"), F.col("right_region"), gap, F.col("left_metric"), F.lit("total"))
    return pairs.select("left_region", "right_region", F.col("year").cast("long").alias("year"), gap.cast("double").alias("gap"), F.regexp_extract(said, " is (higher|lower) than ", 1).alias("verdict"))


@query(CELLS + "SELECT 'orders-' || slug AS document_id, y AS year, res AS residence, sum(value) FILTER (WHERE NOT aggregate) AS parts, max(value) FILTER (WHERE aggregate) AS total, sum(value) FILTER (WHERE NOT aggregate) - max(value) FILTER (WHERE aggregate) AS gap FROM cells WHERE statement = 1 GROUP BY ALL")
def components_vs_total(spark: SparkSession, folder: str) -> DataFrame:
    out = facts.components_vs_total(corpus(spark, folder).facts.filter("statement = '1'"))
    return out.select("document_id", "year", "residence", *[F.col(c).cast("double").alias(c) for c in ("parts", "total", "gap")])


@query(CELLS + "SELECT statement, y AS year, res AS residence, CASE WHEN statement <> 2 THEN sum(value) END AS total, count(*) AS n_cells FROM cells WHERE NOT aggregate GROUP BY ROLLUP (statement, y, res) HAVING statement IS NOT NULL")
def facts_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Beyond the reference: subtotals over statement, year and residence."""
    f = corpus(spark, folder).facts.filter("not aggregate").withColumn("statement", F.col("statement").cast("int"))
    sums = f.rollup("statement", "year", "residence").agg(F.sum("value").cast("double").alias("total"), F.count("*").alias("n_cells")).filter("statement is not null")
    return sums.withColumn("total", F.when(F.col("statement") != 2, F.col("total")))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS western, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS indian, NULL::DOUBLE AS no_number FROM orders")
def parse_number(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers printed with groups of three, or of two after the last three, read back."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    read = lambda c: T.parse_number(c).cast("double")
    return table(spark, folder, "orders").select("o_orderkey", read(T.western(price)).alias("western"), read(T.indian(price)).alias("indian"), read(F.concat(F.lit("about "), price.cast("string"))).alias("no_number"))


IRREGULAR = f"""
    WITH s AS (SELECT r_regionkey, r_name || ' ' || (s_suppkey // {reports.BLOCK}) AS region, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
    d AS (SELECT r_regionkey, region, 'suppliers-' || replace(lower(region), ' ', '-') || '-' || e AS document_id, n FROM s, (VALUES ('a'), ('b')) t(e) WHERE e = 'a' OR r_regionkey % 2 = 1)
"""


@query(
    IRREGULAR
    + """
    , k(name, reason) AS (VALUES ('account balance', NULL), ('parcel count', 'TABLE_ROWS_MALFORMED'), ('refund count', 'TABLE_COLUMN_INCOMPLETE'), ('tanker count', 'TABLE_TOO_FEW_ENTITIES'), ('visit count', 'TABLE_AMBIGUOUS_COLUMN'))
    SELECT document_id || '/' || name AS spec_id, CASE WHEN reason IS NOT NULL THEN reason WHEN n < 2 THEN 'TABLE_TOO_FEW_ENTITIES' END AS final_reason, CASE WHEN name = 'account balance' AND n >= 2 THEN n END AS n_entities
    FROM d, k WHERE n >= 2
    """
)
def select_refusals(spark: SparkSession, folder: str) -> DataFrame:
    """Requests for flawed tables: each is refused for its own flaw; a table on two pages is whole."""
    c = corpus(spark, folder, "irregular")
    names = F.array(*map(F.lit, ("account balance", "parcel count", "refund count", "tanker count", "visit count")))
    large = c.rows.filter("statement = '1' and not aggregate").groupBy("document_id").agg(F.count("*").alias("n")).filter("n >= 2").select("document_id")
    none = lambda kind: F.lit(None).cast(kind)
    asked = large.select("document_id", F.explode(names).alias("metric")).select(F.concat_ws("/", "document_id", "metric").alias("spec_id"), "document_id", "metric", F.lit(2001).alias("year"), none("string").alias("residence"), none("string").alias("population"), F.lit("district").alias("entity_kind"))
    chosen = facts.select_columns(asked, facts.column_health(c.columns, c.rows, c.facts))
    counted = facts.selected_facts(chosen, c.facts).filter("not aggregate").groupBy("spec_id").agg(F.count("*").alias("n_entities"))
    return chosen.join(counted, "spec_id", "left").select("spec_id", F.col("reason").alias("final_reason"), "n_entities")


@query(
    IRREGULAR
    + """
    SELECT DISTINCT region AS spec_id, y AS year, CASE WHEN r_regionkey % 2 = 1 THEN 'TABLE_AMBIGUOUS_DOCUMENT' WHEN y = 2002 THEN 'TABLE_STATE_ROW_MISSING' END AS reason FROM d, (VALUES (2001), (2002)) t(y)
    """
)
def year_refusals(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of a report's own row: refused if two documents are about its region, or if there is no such year."""
    c = corpus(spark, folder, "irregular")
    scopes = c.pages.select("region").distinct().select(F.col("region").alias("spec_id"), "region", F.lit("account balance").alias("metric"), F.array(F.lit(2001), F.lit(2002)).alias("years"), F.lit("total").alias("residence"))
    return facts.year_cells(scopes, c.facts).select("spec_id", "year", "reason")
