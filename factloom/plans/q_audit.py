"""Queries of the independent audit: scopes, places of values, verdicts of old results, attempts, assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import audit as A
from factloom.plans.q_answers import TRUST, _results
from factloom.plans.q_evidence import YEARLY, _yearly
from factloom.plans.registry import query, table

LINES = "WITH ln AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, min(l_returnflag) AS f, min(l_linestatus) AS s, min(l_suppkey) AS sk, min(l_partkey) AS pk, min(l_shipdate) AS d FROM lineitem GROUP BY ALL)"


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each line number of an order."""
    return table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"), F.min("l_suppkey").alias("sk"), F.min("l_partkey").alias("pk"), F.min("l_shipdate").alias("d"))


@query(
    """
    WITH o AS (SELECT o_orderkey AS claim_id, year(o_orderdate) AS y, left(o_orderpriority, 1) AS p, o_orderstatus AS s FROM orders)
    SELECT claim_id, 'asia' AS s_region, CASE WHEN s = 'P' THEN NULL ELSE y END AS s_year, CASE WHEN p = '5' THEN 'urban' WHEN s = 'F' THEN 'rural' ELSE 'total' END AS s_residence, CASE p WHEN '1' THEN 'females' WHEN '2' THEN 'scheduled castes' WHEN '3' THEN 'children' END AS s_group FROM o
    """
)
def claim_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """What claims are about, by their fields and words; the phrase that defines a ratio names no group."""
    o = table(spark, folder, "orders")
    y, p, s = F.year("o_orderdate").cast("string"), F.left("o_orderpriority", F.lit(1)), F.col("o_orderstatus")
    who = F.when(p == "1", "women ").when(p == "2", "scheduled castes and women ").when(p == "3", "the child population ").otherwise("females per 1,000 males ")
    text = F.concat(F.lit("The ratio of "), who, F.when(s == "F", "in rural places ").otherwise(""), F.lit("was 9 in "), y, F.when(s == "P", " and 1901.").otherwise("."))
    claims = o.select(F.col("o_orderkey").alias("claim_id"), text.alias("text"), F.lit("ratio").alias("metric"), F.lit("<b>A</b>SIA 3").alias("region"), F.lit(None).cast("int").alias("year"), F.when(p == "5", "Urban").alias("residence"), F.lit(None).cast("string").alias("population"))
    return A.scopes(claims).select("claim_id", "s_region", "s_year", "s_residence", "s_group")


@query(
    YEARLY
    + """
    , p AS (SELECT a.c, a.n AS x, b.n AS w FROM z a JOIN z b ON a.c = b.c AND a.y = a.last AND b.y = b.first AND a.k > 1)
    SELECT c || '/' || m AS claim_id, CASE WHEN m = 'value' THEN 0 WHEN x = w THEN 2 ELSE 1 END AS n_locations, CASE WHEN m = 'value' THEN 'VALUE_NOT_ON_A_ROW_OF_ITS_REGION' WHEN m = 'year' AND x <> w THEN 'CONTRADICTED_YEAR' WHEN m = 'group' THEN 'CONTRADICTED_GROUP' END AS reason
    FROM p, (VALUES ('right'), ('value'), ('year'), ('group')) t(m)
    """
)
def quote_support(spark: SparkSession, folder: str) -> DataFrame:
    """Quoted tables read anew: where a claim's value is, and whether headers or section contradict it."""
    y = _yearly(spark, folder)
    ends = y.groupBy("c").agg(F.max_by("n", "y").alias("x"), F.min_by("n", "y").alias("w"), F.max("y").alias("last"), F.min("y").alias("first"), F.count("*").alias("k")).filter("k > 1")
    kinds = F.explode(F.array(*map(F.lit, ("right", "value", "year", "group"))))
    each = ends.select("*", kinds.alias("m"))
    s = lambda c: F.col(c).cast("string")
    snippet = F.concat(F.lit("| Code | District | Orders |  |\n| --- | --- | --- | --- |\n|  |  | "), s("first"), F.lit(" | "), s("last"), F.lit(" |\n| 1 | 2 | 3 | 4 |\n| 077 | <b>Place</b> | "), s("w"), F.lit(" | "), s("x"), F.lit(" |"))
    key = F.concat_ws("/", "c", "m").alias("claim_id")
    claims = each.select(key, F.lit("Orders were counted.").alias("text"), F.lit("orders").alias("metric"), F.lit("Place").alias("region"), F.when(F.col("m") == "year", F.col("first")).otherwise(F.col("last")).alias("year"), F.lit("total").alias("residence"), F.lit(None).cast("string").alias("population"), (F.col("x") + F.when(F.col("m") == "value", 5000).otherwise(0)).cast("double").alias("value"))
    quotes = each.select(key, F.lit(1).alias("quote_id"), snippet.alias("snippet"), F.when(F.col("m") == "group", "Orders of females").otherwise("Orders").alias("context"))
    return A.support(claims, quotes).select("claim_id", F.col("n_locations").cast("long").alias("n_locations"), "reason")


@query(
    LINES
    + """
    SELECT l_orderkey, l_linenumber, CASE WHEN f = 'A' AND s = 'F' AND l_linenumber = 1 OR l_linenumber = 7 THEN 'error' WHEN q > 40 THEN 'passed' WHEN s = 'O' AND f <> 'N' THEN 'false_refusal' WHEN q < 5 THEN 'unsupported' WHEN f = 'N' OR q < 10 THEN 'wrong_answer' ELSE 'incomplete' END AS verdict FROM ln
    """
)
def legacy_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Results recorded before there were verdicts, in the terms of today."""
    f, s, q, n = F.col("f"), F.col("s"), F.col("q"), F.col("l_linenumber")
    old = lines(spark, folder).select(
        "l_orderkey", "l_linenumber", F.when((f == "A") & (s == "F") & (n == 1), "PROVIDER_TIMEOUT").alias("error_code"), F.when(n == 7, "error").when(s == "O", "refused").otherwise("answered").alias("outcome"), (q > 40).alias("passed"),
        F.when(f == "N", "refusal").otherwise("lookup").alias("category"), F.when(q < 5, 1).otherwise(0).alias("n_ungrounded"), F.when(q < 10, 1).otherwise(0).alias("n_arithmetic"),
    )
    return old.select("l_orderkey", "l_linenumber", A.legacy_verdict(old).alias("verdict"))


@query(
    LINES
    + """
    , a AS (SELECT l_orderkey AS case_id, l_linenumber AS attempt, CASE f WHEN 'A' THEN 'PROVIDER_TIMEOUT' WHEN 'R' THEN 'PROVIDER_AUTH' END AS error_code, q FROM ln),
    e AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY attempt) AS nth FROM a WHERE attempt >= 2 OR error_code IS NULL OR error_code <> 'PROVIDER_TIMEOUT')
    SELECT case_id, attempt, error_code, CASE WHEN case_id % 2 = 0 THEN q ELSE 0.0 END AS latency, CASE WHEN case_id % 2 = 0 THEN 2 ELSE 1 END AS attempts FROM e WHERE nth = 1
    """
)
def benchmark_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """The attempt that counts for each case, with what an earlier run recorded of it."""
    l = lines(spark, folder)  # noqa: E741
    code = F.when(F.col("f") == "A", "PROVIDER_TIMEOUT").when(F.col("f") == "R", "PROVIDER_AUTH")
    tried = l.select(F.col("l_orderkey").alias("case_id"), F.lit(1).alias("repeat"), F.col("l_linenumber").alias("attempt"), code.alias("error_code"), "q")
    last = A.last_attempts(tried)
    recorded = last.filter("case_id % 2 = 0").select("case_id", "repeat", F.col("q").alias("latency"), F.lit(2).alias("attempts"))
    return A.rescored(last.drop("q"), recorded).select("case_id", "attempt", "error_code", "latency", "attempts")


@query(
    TRUST
    + """
    , c AS (SELECT x.*, CASE WHEN x.expect_refusal THEN (r.s % 3 = 0)::INT ELSE (r.s % 11 <> 0)::INT END AS n_claims FROM x JOIN r ON x.case_id = r.case_id AND x.repeat = r.r)
    SELECT repeat, name, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT repeat, 'passed' AS name, (verdict = 'passed')::INT AS value FROM c UNION ALL SELECT repeat, 'claims', n_claims FROM c UNION ALL SELECT repeat, 'latency_seconds', latency FROM c) GROUP BY 1, 2
    """
)
def experiment_items(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of each result, one experiment for each repeat."""
    return A.item_scores(_results(spark, folder)).groupBy("repeat", "name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(
    LINES
    + """
    , a AS (SELECT o_orderkey AS answer_id FROM orders WHERE o_orderstatus <> 'P'),
    x AS (SELECT answer_id, 'LACKS_CLAIMS_OR_CITATIONS' AS code FROM a WHERE answer_id NOT IN (SELECT l_orderkey FROM ln)
        UNION ALL SELECT answer_id, 'CITATION_NOT_VALIDATED' FROM a JOIN ln ON l_orderkey = answer_id WHERE f = 'R'
        UNION ALL SELECT answer_id, 'PAGE_NOT_ONE_BASED' FROM a JOIN ln ON l_orderkey = answer_id WHERE q = 50
        UNION ALL SELECT answer_id, 'CLAIM_CITES_UNKNOWN' FROM a JOIN ln ON l_orderkey = answer_id WHERE f = 'A' AND s = 'O')
    SELECT DISTINCT answer_id, code FROM x
    """
)
def grounded_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Which assertions an answer breaks: it must have claims that cite what was validated, as it stands."""
    l = lines(spark, folder).withColumnRenamed("l_orderkey", "answer_id")  # noqa: E741
    answers = table(spark, folder, "orders").select(F.col("o_orderkey").alias("answer_id"), (F.col("o_orderstatus") == "P").alias("refusal"))
    n = F.col("l_linenumber").cast("string")
    claims = l.select("answer_id", n.alias("claim_id"), F.array(F.when((F.col("f") == "A") & (F.col("s") == "O"), "99").otherwise(n)).alias("citation_ids"))
    cited = l.select("answer_id", n.alias("citation_id"), F.col("sk").alias("document_id"), F.when(F.col("q") == 50, 0).otherwise(1).alias("page_number"), F.col("pk").alias("chunk_id"), "f")
    trusted = cited.select("answer_id", "citation_id", "document_id", "page_number", "chunk_id", F.when(F.col("f") == "R", "other").otherwise(F.col("f")).alias("snippet"))
    return A.ungrounded(answers, claims, cited.withColumnRenamed("f", "snippet"), trusted)
