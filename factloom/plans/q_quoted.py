"""Queries of tables read from their own text: quotes that carry claims, proposed rows bound to cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.frames import changed, met_as_dealt, spread
from factloom.operators import quoted_tables as Q
from factloom.plans.corpus import corpus
from factloom.plans.q_facts import CELLS
from factloom.plans.registry import query
from factloom.plans.staging import staged


@query(
    CELLS
    + """
    , place AS (SELECT *, y * 3 + CASE res WHEN 'total' THEN 0 WHEN 'rural' THEN 1 ELSE 2 END AS at FROM cells),
    c AS (SELECT 'none' AS mutation, slug, statement, value, y, res FROM cells UNION ALL SELECT 'value', slug, statement, value + 1000003, y, res FROM cells UNION ALL SELECT 'year', slug, statement, value, y + 1, res FROM cells
        UNION ALL SELECT 'residence', slug, statement, value, y, CASE res WHEN 'total' THEN 'rural' WHEN 'rural' THEN 'urban' ELSE 'total' END FROM cells),
    asked AS (SELECT *, row_number() OVER () AS id FROM c),
    hit AS (
        SELECT DISTINCT id FROM asked a JOIN place b ON a.slug = b.slug AND a.statement = b.statement AND a.value = b.value AND a.res = b.res
        WHERE a.y = b.y OR EXISTS (SELECT 1 FROM place l WHERE l.slug = b.slug AND l.statement = b.statement AND l.entity = b.entity AND l.at < b.at AND floor(l.value) = a.y AND l.value BETWEEN 1900 AND 2099))
    SELECT 'orders-' || slug AS document_id, statement, mutation, count(*) AS n_claims, count(hit.id) AS n_agree FROM asked LEFT JOIN hit USING (id) GROUP BY ALL
    """
)
def quote_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of all cells, right or with a field changed, against the whole page of their table, read by itself."""
    c = corpus(spark, folder)
    f = c.facts.filter("value is not null")
    quote = F.concat_ws("/", "document_id", F.col("page_number").cast("string"))
    text = F.concat(F.lit("It was "), F.col("raw_value"), F.lit(" in "), F.col("year").cast("string"), F.lit("."))
    base = f.select(F.concat_ws("/", "document_id", "statement", "entity", "residence", F.col("year").cast("string")).alias("claim_id"), quote.alias("quote_id"), text.alias("claim_text"), F.col("value").cast("double").alias("value"), "year", F.lit(None).cast("string").alias("population"), "residence", F.lit(None).cast("string").alias("claim_region"))
    turned = F.when(F.col("residence") == "total", "rural").when(F.col("residence") == "rural", "urban").otherwise("total")
    claims = changed(base, "claim_id", {"none": {}, "value": {"value": F.col("value") + 1_000_003}, "year": {"year": F.col("year") + 1}, "residence": {"residence": turned}})
    quotes = c.pages.filter("page_number > 1").select(quote.alias("quote_id"), F.col("text").alias("quote"))
    out = Q.read_claims(claims, quotes)
    named = F.split(F.substring_index("claim_id", "/", 2), "[:/]")
    return out.select(named.alias("p"), "agrees").groupBy(F.get("p", F.lit(1)).alias("document_id"), F.get("p", F.lit(2)).cast("int").alias("statement"), F.get("p", F.lit(0)).alias("mutation")).agg(F.count("*").alias("n_claims"), F.count_if("agrees").alias("n_agree"))


#: What is changed in a proposal, the reason that this gives, and the axis that is left without a cell.
CHANGES = {
    "none": (None, None), "label": ("UNSUPPORTED_OR_WRONG_TABLE_CELL", "label"), "value": ("UNSUPPORTED_OR_WRONG_TABLE_CELL", "value"), "metric": ("UNSUPPORTED_OR_WRONG_TABLE_CELL", "metric"),
    "late": ("UNSUPPORTED_OR_WRONG_TABLE_CELL", "year"), "suburban": ("UNSUPPORTED_OR_WRONG_TABLE_CELL", "residence"), "group": ("UNSUPPORTED_OR_WRONG_TABLE_CELL", "population"), "series": ("UNSUPPORTED_OR_WRONG_TABLE_CELL", "series"),
    "unit": ("UNSUPPORTED_OR_WRONG_TABLE_CELL", "unit"), "twice": ("AMBIGUOUS_TABLE_CELL", None), "chunk": ("UNKNOWN_EVIDENCE_ID", None), "row": ("WRONG_REGION_ROW", None), "region": ("WRONG_REQUIRED_REGION", None), "subgroup": ("SUBGROUP_TABLE", None),
    "no_year": ("MISSING_AUTHORITATIVE_YEAR", None), "no_group": ("MISSING_AUTHORITATIVE_POPULATION_SCOPE", None), "no_residence": ("MISSING_AUTHORITATIVE_RESIDENCE_SCOPE", None),
    "other_year": ("WRONG_YEAR", None), "other_group": ("WRONG_POPULATION_SCOPE", None), "other_residence": ("WRONG_RESIDENCE_SCOPE", None),
}


#: Pages whose proposals and cells a task holds at most, on average.
PAGES = 256


def _proposals(facts: DataFrame) -> DataFrame:
    """Twenty copies of a cell's row on the task that its ``page`` is dealt to."""
    none, true = F.lit(None).cast("string"), F.lit(True)
    base = facts.select(
        "page", F.concat_ws("/", "statement", "document_id", "entity", "residence", F.col("year").cast("string")).alias("row_id"), F.col("page").alias("chunk_id"), F.col("entity").alias("label"), "value", "year", none.alias("population"), "residence", none.alias("series"), none.alias("unit"),
        F.when(F.col("statement") == "2", "average price").otherwise("order count").alias("asked_metric"), F.col("year").alias("asked_year"), none.alias("asked_population"), F.col("residence").alias("asked_residence"), F.array().cast("array<string>").alias("asked_regions"), F.lit(False).alias("names_region"), F.lit(False).alias("needs_group"),
    )
    year, male = F.lit(2011), F.lit("male")
    return changed(
        base,
        "row_id",
        {
            "none": {}, "label": {"label": F.lit("NOWHERE")}, "value": {"value": F.col("value") + 1_000_003}, "metric": {"asked_metric": F.lit("literacy rate")}, "late": {"year": year, "asked_year": year}, "suburban": {"residence": F.lit("suburban"), "asked_residence": F.lit("suburban")},
            "group": {"needs_group": true, "population": male, "asked_population": male}, "series": {"series": F.lit("a second one")}, "unit": {"unit": F.lit("hectares")}, "twice": {"chunk_id": F.concat("chunk_id", F.lit("|twice"))}, "chunk": {"chunk_id": F.lit("missing")}, "row": {"names_region": true}, "region": {"asked_regions": F.array(F.lit("ELSEWHERE"))},
            "subgroup": {"chunk_id": F.concat("chunk_id", F.lit("|castes"))}, "no_year": {"asked_year": F.lit(None).cast("int")}, "no_group": {"needs_group": true}, "no_residence": {"asked_residence": none}, "other_year": {"year": F.col("year") + 1}, "other_group": {"needs_group": true, "population": male, "asked_population": F.lit("female")}, "other_residence": {"residence": F.lit("elsewhere")},
        },
    )


@query(
    CELLS
    + f", m(mutation, reason, emptied) AS (VALUES {', '.join('(' + ', '.join('NULL' if x is None else repr(x) for x in (k, *v)) + ')' for k, v in CHANGES.items())}) "
    + "SELECT mutation, statement, reason, emptied, count(*) AS n, count(*) FILTER (WHERE reason IS NULL) AS n_bound FROM m, cells WHERE NOT aggregate GROUP BY ALL"
)
def cell_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Proposed rows for the cells of all statements and years, right or changed in one way: what each is bound to, or the axis that leaves no cell."""
    c = corpus(spark, folder)
    page = F.concat_ws("/", "document_id", F.col("page_number").cast("string"))
    # Pages and facts are dealt by page before copies of them are made, so that no copy is shuffled.
    tasks = c.pages.count() // PAGES + 1
    pages = spread(c.pages.filter("page_number > 1").select(page.alias("page"), "text", "region"), "page", least=tasks)
    facts = spread(c.facts.filter("value is not null and chunk_id is not null and not aggregate").select(page.alias("page"), "statement", "document_id", "entity", "residence", "year", "value"), "page", least=tasks)
    copy = lambda mark, text, section: F.struct(F.concat("page", F.lit(mark)).alias("chunk_id"), text.alias("text"), F.lit(section).alias("section"))
    copies = F.array(copy("", F.col("text"), "Statements"), copy("|twice", F.concat_ws("\n\n", "text", "text"), "Statements"), copy("|castes", F.col("text"), "Statements > Scheduled Castes"))
    out = Q.matched_cells(_proposals(facts), pages.select("page", "region", F.inline(copies)), "page")
    named = F.split("row_id", "[:/]")
    with met_as_dealt(spark):
        return staged(out.groupBy(F.get(named, F.lit(0)).alias("mutation"), F.get(named, F.lit(1)).cast("int").alias("statement"), "reason", "emptied").agg(F.count("*").alias("n"), F.count("raw").alias("n_bound")), "matches")
