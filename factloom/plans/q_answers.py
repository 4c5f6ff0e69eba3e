"""Queries over answers: citations and their mutations, packing, datasets, trust, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.frames import changed
from factloom.operators import analyzer as A
from factloom.operators import citations as C
from factloom.operators import evidence as V
from factloom.operators import facts as X
from factloom.operators import retrieval as R
from factloom.operators import trust as T
from factloom.plans.corpus import corpus
from factloom.plans.q_facts import CELLS, REPORTS, selection
from factloom.plans.q_retrieval import TOP, _asked, _items, bm25_sql
from factloom.plans.registry import query, table


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus(spark, folder)
    return C.claims_of_facts(c.facts, c.pages)


def _mutations(claims: DataFrame) -> DataFrame:
    """Every claim, and copies of it with one field changed."""
    changes = {
        "none": {},
        "value": {"value": F.col("value") + 1_000_003},
        "year": {"year": F.col("year") + 1},
        "chunk": {"evidence_ids": F.array(F.lit("missing"))},
        "checksum": {"source_checksum": F.sha2("source_checksum", 256)},
        "region": {"region": F.lit("ELSEWHERE")},
        "subgroup": {"subgroup": F.lit("")},
        "no_evidence": {"evidence_ids": F.array().cast("array<string>")},
    }
    return changed(claims, "claim_id", changes)


@query(
    CELLS
    + """
    , m(mutation, code) AS (VALUES ('none', NULL), ('value', 'CLAIM_QUOTE_NOT_FOUND'), ('chunk', 'UNKNOWN_EVIDENCE_ID'), ('checksum', 'INVALID_PROVENANCE'), ('region', 'INVALID_PROVENANCE'), ('no_evidence', 'CLAIM_WITHOUT_EVIDENCE')),
    y AS (SELECT CASE WHEN b.value IS NOT NULL THEN NULL ELSE 'TABLE_YEAR_COLUMN_MISMATCH' END AS code FROM cells a LEFT JOIN cells b ON a.slug = b.slug AND a.entity = b.entity AND a.res = b.res AND a.statement = b.statement AND b.y = a.y + 1 AND a.value = b.value)
    SELECT mutation, code, count(*) AS n FROM m, cells GROUP BY ALL
    UNION ALL SELECT 'year', code, count(*) FROM y GROUP BY ALL
    UNION ALL SELECT 'subgroup', CASE WHEN statement = 3 THEN 'SUBGROUP_TABLE_FOR_WHOLE_POPULATION_CLAIM' END, count(*) FROM cells GROUP BY ALL
    """
)
def mutation_detection(spark: SparkSession, folder: str) -> DataFrame:
    """Claims with one field changed: which code each gets."""
    c = corpus(spark, folder)
    out = C.validate(_mutations(_claims(spark, folder)), c.chunks, c.facts)
    return out.groupBy(F.substring_index("claim_id", ":", 1).alias("mutation"), "code").agg(F.count("*").alias("n"))


@query(CELLS + "SELECT 'orders-' || slug AS document_id, count(*) AS n_claims, count(*) AS n_passed, 0::BIGINT AS n_failed FROM cells GROUP BY 1")
def citation_validate(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of all cells hold against their chunks."""
    c = corpus(spark, folder)
    out = C.validate(_claims(spark, folder), c.chunks, c.facts)
    return out.groupBy(F.substring_index("claim_id", "/", 1).alias("document_id")).agg(F.countDistinct("claim_id").alias("n_claims"), F.count_if(F.col("code").isNull()).alias("n_passed"), F.count_if(F.col("code").isNotNull()).alias("n_failed"))


@query(CELLS + "SELECT 'orders-' || slug AS document_id, count(*) AS n_kept, count(*) AS n_pruned FROM cells GROUP BY 1")
def pruned_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Each claim also cites the report's first chunk, which says nothing of it: that citation goes, the other stays."""
    c = corpus(spark, folder)
    first = c.chunks.filter("chunk_index = 0").select("document_id", F.col("chunk_id").alias("first_id"))
    claims = _claims(spark, folder).join(F.broadcast(first), "document_id").withColumn("evidence_ids", F.concat("evidence_ids", F.array("first_id"))).drop("first_id")
    out = C.validate(claims, c.chunks, c.facts)
    return out.groupBy(F.substring_index("claim_id", "/", 1).alias("document_id")).agg(F.count_if(F.col("code").isNull()).alias("n_kept"), F.count_if("pruned").alias("n_pruned"))


@query(CELLS + "SELECT 'orders-' || slug AS document_id, statement, count(*) AS n_spans, count(*) AS n_verbatim FROM (SELECT DISTINCT slug, statement, entity FROM cells) GROUP BY ALL")
def evidence_spans(spark: SparkSession, folder: str) -> DataFrame:
    """For each row of a table the stretch of its chunk that shows it: within bounds, short enough, ending with the row."""
    c = corpus(spark, folder)
    rows = c.rows.filter("not malformed").join(c.chunks.select("chunk_id", "text"), "chunk_id")
    start, end = C.table_span(F.col("text"), F.col("line"))
    told = rows.select("document_id", F.col("statement").cast("int").alias("statement"), "line", "text", start.alias("start"), end.alias("end"))
    quote = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    good = (F.length(quote) <= C.SPAN_CHARS) & quote.endswith(F.col("line")) & F.contains("text", quote)
    return told.groupBy("document_id", "statement").agg(F.count("*").alias("n_spans"), F.count_if(good).alias("n_verbatim"))


@query(
    CELLS
    + """
    , p AS (SELECT a.slug, a.entity, a.res, a.value - b.value AS result, a.y FROM cells a JOIN cells b ON a.slug = b.slug AND a.entity = b.entity AND a.res = b.res AND a.statement = b.statement AND a.y = b.y + 1)
    SELECT 'orders-' || slug AS document_id, CASE WHEN y = 2001 THEN 'INVALID_DERIVATION' WHEN y = 2000 THEN 'DERIVED_MISSING_INPUT_CITATIONS' END AS code, count(*) AS n FROM p GROUP BY ALL
    """
)
def derived_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Year-on-year differences: right ones, ones that state another number, ones with an input uncited."""
    c = corpus(spark, folder)
    claims = _claims(spark, folder)
    cited = C.validate(claims, c.chunks, c.facts)
    later, earlier = claims.alias("a"), claims.alias("b")
    same = (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.entity") == F.col("b.entity")) & (F.col("a.metric") == F.col("b.metric")) & (F.col("a.subgroup") == F.col("b.subgroup")) & (F.col("a.residence") == F.col("b.residence")) & (F.col("a.year") == F.col("b.year") + 1)
    result = X.difference(F.col("a.value"), F.col("b.value")).cast("double")
    pairs = later.join(earlier, same).select(
        F.concat_ws("|", F.col("a.claim_id"), F.lit("difference")).alias("calc_id"), F.col("a.claim_id").alias("left_claim"), F.when(F.col("a.year") == 2000, "nobody").otherwise(F.col("b.claim_id")).alias("right_claim"), F.lit("difference").alias("operation"), result.alias("result"), (result + F.when(F.col("a.year") == 2001, 1).otherwise(0)).alias("stated"),
    )
    out = C.derived(pairs, cited)
    return out.groupBy(F.substring_index("calc_id", "/", 1).alias("document_id"), "code").agg(F.count("*").alias("n"))


@query(
    """
    WITH a AS (SELECT o_orderkey AS answer_id, o_orderstatus AS s, year(o_orderdate) AS y FROM orders),
    l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'F') AS uncited, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS thin, bool_or(year(l_shipdate) = (SELECT y FROM a WHERE answer_id = l_orderkey)) AS has_year FROM lineitem GROUP BY 1)
    SELECT answer_id, concat_ws(',', CASE WHEN s = 'P' AND coalesce(n, 0) > 0 THEN 'ANSWER_REFUSAL_FLAG_CONFLICT' END, CASE WHEN s <> 'P' AND n > 0 AND NOT has_year THEN 'MISSING_REQUESTED_YEAR' END, CASE WHEN s = 'F' AND n IS NULL THEN 'EMPTY_CLAIMS_FOR_ANSWERABLE_TASK' END,
        CASE WHEN uncited > 0 THEN 'CLAIM_WITHOUT_EVIDENCE' END, CASE WHEN thin > 0 THEN 'DERIVED_CLAIM_MISSING_INPUT_CITATIONS' END) AS codes FROM a LEFT JOIN l ON l_orderkey = answer_id
    """
)
def response_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as answers and their lines as claims: which invariants each answer breaks."""
    o = table(spark, folder, "orders")
    answers = o.select(F.col("o_orderkey").alias("answer_id"), F.col("o_orderpriority").alias("answer"), (F.col("o_orderstatus") == "P").alias("refusal"), (F.col("o_orderstatus") == "F").alias("answerable"), F.array(F.year("o_orderdate")).alias("asked_years"), F.array().cast("array<string>").alias("asked_regions"))
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    claims = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.lit("r").alias("region"), F.year("l_shipdate").alias("year"), F.when((status == "F") & flag.isin("A", "N"), F.when(flag == "A", 1).otherwise(0)).otherwise(2).alias("n_citations"), (flag == "A").alias("derived"))
    return C.response_codes(answers, claims).select("answer_id", F.array_join("codes", ",").alias("codes"))


@query("WITH f AS (SELECT l_orderkey AS answer_id, l_suppkey AS document_id, l_linestatus AS chunk_id, min(l_linenumber) AS first FROM lineitem GROUP BY ALL) SELECT answer_id, document_id, chunk_id, row_number() OVER (PARTITION BY answer_id ORDER BY first, document_id, chunk_id) AS number FROM f")
def citation_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Each source of an answer numbered once, by first mention."""
    c = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.col("l_suppkey").alias("document_id"), F.lit(1).alias("page_number"), F.concat_ws("/", F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), "l_linestatus").alias("chunk_id"), F.col("l_linenumber").alias("position"))
    return C.references(c).select("answer_id", "document_id", F.substring_index("chunk_id", "/", -1).alias("chunk_id"), F.col("number").cast("long").alias("number"))


def _proposals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that a model might propose, right or wrong in one field, for all counts."""
    f = corpus(spark, folder).facts.filter("statement = '1' and not aggregate")
    base = f.select("document_id", "region", F.col("entity").alias("label"), "value", F.lit("order count").alias("metric"), "year", "residence", F.concat_ws("/", "document_id", "entity", "residence", F.col("year").cast("string")).alias("row_id"))
    changes = {"none": {}, "label": {"label": F.lit("NOWHERE")}, "value": {"value": F.col("value") + 1_000_003}, "year": {"year": F.lit(2011)}, "metric": {"metric": F.lit("literacy rate")}, "residence": {"residence": F.lit("suburban")}, "region": {"region": F.lit("ELSEWHERE")}}
    return changed(base, "row_id", changes)


@query(
    CELLS
    + """
    , m(mutation, reason) AS (VALUES ('none', NULL), ('label', 'WRONG_REGION_ROW'), ('value', 'UNSUPPORTED_OR_WRONG_TABLE_CELL'), ('year', 'WRONG_YEAR'), ('metric', 'WRONG_METRIC'), ('residence', 'WRONG_RESIDENCE'), ('region', 'WRONG_REQUIRED_REGION'))
    SELECT mutation, reason, count(*) AS n FROM m, cells WHERE statement = 1 AND NOT aggregate GROUP BY ALL
    """
)
def hydrate_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Proposed rows bound to the one cell that holds them, or the reason why not."""
    out = C.hydrated(_proposals(spark, folder), corpus(spark, folder).facts)
    return out.groupBy(F.substring_index("row_id", ":", 1).alias("mutation"), "reason").agg(F.count("*").alias("n"))


@query(CELLS + "SELECT code, count(*) AS n FROM (SELECT CASE WHEN res = 'urban' THEN 'MISSING_LINEAGE' WHEN res = 'rural' THEN 'VALUE_DIFFERS' END AS code FROM cells) WHERE code IS NOT NULL GROUP BY 1")
def lineage_check(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a dataset against their source records: one residence's are lost, another's say something else."""
    f = corpus(spark, folder).facts
    rows = f.select(F.concat_ws("/", "document_id", "table_id", "entity", F.col("column_index").cast("string")).alias("row_id"), "value", "unit", "residence")
    sources = rows.filter("residence <> 'urban'").withColumn("value", F.when(F.col("residence") == "rural", F.col("value") + 1).otherwise(F.col("value")))
    return C.lineage_errors(rows, sources).groupBy("code").agg(F.count("*").alias("n"))


@query(REPORTS + "SELECT 'orders-' || replace(lower(r_name), ' ', '-') || '/' || k AS spec_id, count(*) - CASE WHEN k = 'rural' THEN 1 ELSE 0 END AS n_rows, count(*) AS n_entities, CASE WHEN k = 'rural' THEN 'RANKING_COVERAGE_INCOMPLETE' END AS reason FROM reports JOIN nation ON n_regionkey = r_regionkey, (VALUES ('count'), ('rural'), ('price'), ('segment')) t(k) GROUP BY r_name, k")
def completeness_guard(spark: SparkSession, folder: str) -> DataFrame:
    """A ranking of fewer rows than its table has entities is refused; here one residence loses a row."""
    c = corpus(spark, folder)
    chosen = X.selected_facts(selection(spark, folder), c.facts).filter("not aggregate")
    last = F.max("entity").over(Window.partitionBy("spec_id"))
    kept = chosen.withColumn("last", last).filter(~(F.col("spec_id").endswith("/rural") & (F.col("entity") == F.col("last"))))
    have = kept.groupBy("spec_id", "document_id", "table_id").agg(F.count("*").alias("n_rows"))
    entities = c.rows.filter("not malformed and not aggregate").groupBy("document_id", "table_id").agg(F.countDistinct(F.lower("entity")).alias("n_entities"))
    return have.join(entities, ["document_id", "table_id"]).select("spec_id", "n_rows", "n_entities", F.when(F.col("n_rows") < F.col("n_entities"), "RANKING_COVERAGE_INCOMPLETE").alias("reason"))


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    items = _items(spark, folder)
    found = R.bm25_leg(_asked(spark, folder), items, R.leg_size(TOP))
    return found.join(items.select("chunk_id", "text", "region"), "chunk_id").select("query_id", F.col("chunk_id").alias("item_id"), F.col("region").alias("document_id"), "region", "text", "score", F.when(F.col("region").isin("src1", "src2"), F.col("region")).alias("target"))


def packed_sql(reserve: bool) -> str:
    """The same fold as a recursion over the items of each query."""
    turn = "row_number() OVER (PARTITION BY query_id, document_id ORDER BY place)"
    rnd = f"CASE WHEN document_id IN ('src1', 'src2') AND {turn} = 1 THEN 0 ELSE {turn} END" if reserve else turn
    return bm25_sql().replace("WITH items", "WITH RECURSIVE items", 1) + rf"""
    , it AS (SELECT query_id, chunk_id, source AS document_id, length(coalesce(text, '')) AS chars, row_number() OVER (PARTITION BY query_id ORDER BY (regexp_matches(text, '[0-9]') AND NOT regexp_matches(lower(text), '(?:map|graph|figure|contents)'))::INT DESC, score DESC, chunk_id) AS place FROM bm JOIN documents ON doc_id = chunk_id),
    r AS (SELECT *, {rnd} AS rnd, min(place) OVER (PARTITION BY query_id, document_id) AS first FROM it),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rnd, first, place) AS k FROM r),
    st AS (
        SELECT DISTINCT query_id, 0::BIGINT AS k, 0::BIGINT AS chars, 0 AS n, 0::BIGINT AS rnd, TRUE AS added, FALSE AS ended, NULL::BIGINT AS item, FALSE AS kept FROM o
        UNION ALL SELECT query_id, k, chars + fits * c, n + fits, rnd, CASE WHEN fresh THEN fits = 1 ELSE added OR fits = 1 END, ended, item, fits = 1
        FROM (SELECT *, CASE WHEN NOT ended AND chars + c <= 12000 AND n < 12 THEN 1 ELSE 0 END AS fits
            FROM (SELECT s.query_id, o.k, s.chars, s.n, o.rnd, o.rnd <> s.rnd AS fresh, s.added, s.ended OR (o.rnd <> s.rnd AND NOT s.added) AS ended, o.chunk_id AS item, o.chars AS c FROM st s JOIN o ON o.query_id = s.query_id AND o.k = s.k + 1)))
    SELECT query_id, item AS item_id, kept, CASE WHEN NOT kept THEN 'budget_or_chunk_limit' END AS reason FROM st WHERE k > 0
    """


@query(packed_sql(False))
def bound_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """What is found for each passage, packed in rounds over sources."""
    return V.packed(_evidence(spark, folder))


@query(packed_sql(True))
def pack_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The same, with the best item of each required source reserved."""
    return V.packed(_evidence(spark, folder), reserve_targets=True)


@query(
    """
    WITH t AS (SELECT l_orderkey AS query_id, l_suppkey AS target, bool_or(l_returnflag <> 'N' AND l_tax < 0.08 AND l_quantity > 2) AS direct, bool_and(l_discount < 0.1) AS enough FROM lineitem GROUP BY ALL)
    SELECT query_id, bool_and(direct) AND bool_and(enough) AS sufficient, count(*) FILTER (WHERE direct) AS n_direct FROM t GROUP BY 1
    """
)
def evidence_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as questions, lines as assessed evidence: whether every target has direct evidence."""
    yes = F.lit(True)
    a = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("target"), F.when(F.col("l_returnflag") == "A", "direct_answer").when(F.col("l_returnflag") == "R", "compatible_rounding").otherwise("related").alias("relevance"),
        (F.col("l_discount") < 0.1).alias("model_sufficient"), F.lit("persons").alias("text"), (F.col("l_tax") < 0.08).alias("region_match"), (F.col("l_quantity") > 2).alias("metric_match"), *[yes.alias(f) for f in V.FLAGS[2:-1]], F.lit(False).alias("unit_match"),
    )
    return V.gate(a)


@query(
    bm25_sql()
    + """
    , f AS (SELECT query_id, source, chunk_id AS page, min(rank) AS first FROM bm JOIN documents ON doc_id = chunk_id GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY first) AS turn FROM f)
    SELECT query_id, source AS document_id, count(*) AS n_pages FROM k WHERE turn <= 3 GROUP BY ALL
    """
)
def sibling_expand(spark: SparkSession, folder: str) -> DataFrame:
    """The first three pages of each source that a passage found, whole."""
    items = _items(spark, folder).select("chunk_id", F.col("region").alias("document_id"), F.col("chunk_id").alias("page_number"))
    found = R.bm25_leg(_asked(spark, folder), _items(spark, folder), R.leg_size(TOP)).join(items, "chunk_id")
    return R.sibling_pages(found, items).groupBy("query_id", "document_id").agg(F.countDistinct("page_number").alias("n_pages"))


@query(REPORTS + "SELECT 'orders-' || replace(lower(r_name), ' ', '-') AS document_id, 2::BIGINT AS n_sections FROM reports")
def summary_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return R.summary_evidence(corpus(spark, folder).chunks).groupBy("document_id").agg(F.count("*").alias("n_sections"))


TRUST = """
    WITH n AS (SELECT c_nationkey * 10000 + year(o_orderdate) AS case_id, c_nationkey AS k, year(o_orderdate) AS y, count(*) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    r AS (SELECT *, k + y + r AS s, k % 6 = 5 AS refusal FROM n, (VALUES (1), (2)) t(r)),
    x AS (SELECT case_id, r AS repeat, refusal AS expect_refusal, (s * 37 % 100) / 4.0 + k AS latency,
        CASE WHEN s % 13 = 0 THEN 'error' WHEN refusal THEN CASE WHEN s % 3 = 0 THEN 'wrong_answer' ELSE 'passed' END WHEN s % 11 = 0 THEN 'false_refusal' WHEN s % 5 = 0 THEN 'wrong_answer' WHEN s % 7 = 0 THEN 'unsupported' ELSE 'passed' END AS verdict FROM r)
"""


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """A question for each nation and year, asked twice; answers go wrong in turns."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    n = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy(F.col("c_nationkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("v"))
    r = n.withColumn("repeat", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("s", F.col("k") + F.col("y") + F.col("repeat")).withColumn("case_id", F.col("k") * 10000 + F.col("y"))
    s = F.col("s")
    refusal, silent = F.col("k") % 6 == 5, F.when(F.col("k") % 6 == 5, s % 3 != 0).otherwise(s % 11 == 0)
    cases = r.select("case_id", "repeat", refusal.alias("expect_refusal"), silent.alias("refused"), (s % 13 != 0).alias("responded"), ((s * 37 % 100) / 4.0 + F.col("k")).alias("latency"))
    slot = [F.concat(F.lit("nation "), F.col("k").cast("string")).alias("region"), F.lit("order count").alias("metric"), F.col("y").alias("year"), F.lit("total").alias("residence"), F.lit(None).cast("string").alias("population")]
    claims = r.filter(~silent).select("case_id", "repeat", F.lit("c1").alias("claim_id"), *slot, (F.col("v") + F.when(s % 5 == 0, 7).otherwise(0)).cast("double").alias("value"), (s % 7 != 0).alias("cited"), F.lit(None).cast("string").alias("operation"), F.array().cast("array<double>").alias("operands"))
    expected = r.filter("repeat = 1").filter(~refusal).select("case_id", F.lit("f1").alias("fact_id"), *slot, F.col("v").cast("string").alias("value"))
    return T.verdicts(cases, claims, expected).join(cases.select("case_id", "repeat", "latency"), ["case_id", "repeat"])


@query(TRUST + "SELECT case_id, repeat, verdict FROM x")
def trust_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).select("case_id", "repeat", "verdict")


@query(TRUST + "SELECT count(*) AS n, count(*) FILTER (WHERE verdict = 'passed') AS n_passed, count(*) FILTER (WHERE verdict = 'wrong_answer') AS n_wrong_answer, count(*) FILTER (WHERE verdict = 'error') AS n_error, round(median(latency) FILTER (WHERE verdict <> 'error'), 1) AS median_latency, (SELECT count(*) FROM (SELECT case_id FROM x GROUP BY 1 HAVING count(DISTINCT verdict = 'passed') > 1)) AS n_unstable FROM x")
def scorecard(spark: SparkSession, folder: str) -> DataFrame:
    return T.scorecard(_results(spark, folder)).select("n", "n_passed", "n_wrong_answer", "n_error", "median_latency", "n_unstable")


@query(
    TRUST
    + """SELECT round(avg((verdict = 'passed')::INT), 4) AS pass_rate, round(count(*) FILTER (WHERE verdict = 'false_refusal' AND NOT expect_refusal) / count(*) FILTER (WHERE NOT expect_refusal), 4) AS false_refusal_rate,
    round(count(*) FILTER (WHERE verdict = 'passed' AND expect_refusal) / count(*) FILTER (WHERE expect_refusal), 4) AS refusal_recall,
    (SELECT latency FROM (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS i, count(*) OVER () AS n FROM x WHERE verdict <> 'error') WHERE i = greatest(0, CAST(round_even(n * 0.95, 0) AS BIGINT) - 1)) AS p95_latency FROM x"""
)
def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = T.run_metrics(_results(spark, folder))
    return out.select("pass_rate", "false_refusal_rate", "refusal_recall", F.col("p95_latency").cast("double").alias("p95_latency"))


@query(TRUST + "SELECT case_id, count(*) AS n_repeats, count(*) FILTER (WHERE verdict = 'passed') AS n_passed FROM x GROUP BY 1 HAVING count(DISTINCT verdict = 'passed') > 1")
def unstable_cases(spark: SparkSession, folder: str) -> DataFrame:
    return T.unstable_cases(_results(spark, folder))


def _specs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as questions about one or two regions, some rankings, some changes."""
    k = F.col("o_orderkey")
    scope = F.when(F.col("o_orderstatus") == "O", "rural ").when(F.col("o_orderstatus") == "F", "urban ").otherwise("")
    who = F.when(F.col("o_orderpriority").startswith("1"), "women ").when(F.col("o_orderpriority").startswith("2"), "males ").otherwise("")
    verb = F.when(F.col("o_orderpriority").startswith("3"), "Rank the ").otherwise("What is the ")
    q = F.concat(verb, scope, who, F.lit("literacy in "), F.year("o_orderdate").cast("string"), F.lit("?"))
    return table(spark, folder, "orders").select(k.alias("spec_id"), q.alias("query"), F.lit("Literacy  Rates").alias("metric"), F.lit("all").alias("population"), F.lit("Urban").alias("residence"), F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("ASIA"), F.lit("EUROPE"))).otherwise(F.array(F.lit("ASIA"))).alias("regions"))


SPECS = """
    WITH q AS (SELECT o_orderkey AS spec_id, year(o_orderdate) AS y, left(o_orderpriority, 1) AS p, o_custkey % 3 = 0 AS two, CASE WHEN o_orderstatus = 'O' THEN 'rural' ELSE 'urban' END AS residence FROM orders),
    c AS (SELECT *, CASE WHEN p = '3' THEN 'ranking' WHEN two THEN 'comparison' ELSE 'lookup' END AS kind, CASE p WHEN '1' THEN 'female' WHEN '2' THEN 'male' END AS population FROM q)
"""


@query(SPECS + "SELECT spec_id, kind, population, residence, 'literacy rate' AS metric, CASE WHEN kind = 'ranking' AND two THEN 'RANKING_NEEDS_ONE_REGION' END AS clarify FROM c")
def answer_specs(spark: SparkSession, folder: str) -> DataFrame:
    """Requests in canonical form: what the question names beats what came with it."""
    return A.canonical(_specs(spark, folder)).select("spec_id", "kind", "population", "residence", "metric", "clarify")


@query(SPECS + "SELECT spec_id, target, concat_ws(' ', y, residence, population, 'literacy rate', target) AS target_query FROM c, (VALUES ('ASIA'), ('EUROPE')) t(target) WHERE NOT (kind = 'ranking' AND two) AND (two OR target = 'ASIA')")
def explode_targets(spark: SparkSession, folder: str) -> DataFrame:
    return A.targets(A.canonical(_specs(spark, folder))).select("spec_id", "target", "target_query")


@query("WITH s AS (SELECT l_orderkey AS chart_id, l_returnflag AS series, sign(l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) AS step FROM lineitem) SELECT chart_id, count(DISTINCT series) = 1 AND count(*) >= 5 AND (coalesce(min(step) >= 0, FALSE) OR coalesce(max(step) <= 0, FALSE)) AS ranking FROM s GROUP BY 1")
def chart_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as charts of their lines: which show a ranking."""
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("chart_id"), F.col("l_returnflag").alias("series"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("row_no"), F.col("l_quantity").alias("value"))
    return T.is_ranking(rows)
