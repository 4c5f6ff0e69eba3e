"""Numbers in names are no years."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import calculations, quoted_tables


def test_number_in_the_name_of_a_row_is_no_year(spark):
    quote = "| Code | District | Orders |  |\n| --- | --- | --- | --- |\n|  |  | 1997 | 1998 |\n| 1 | 2 | 3 | 4 |\n| 00 | ASIA 1996 | 5 | 6 |"
    quotes = spark.createDataFrame([("q", quote)], "quote_id string, quote string")
    row = lambda name, value, year: (name, "q", f"It was {value}.", float(value), year, None, None, None)
    claims = spark.createDataFrame([row("right", 5, 1997), row("named", 5, 1996), row("next", 6, 1997)], "claim_id string, quote_id string, claim_text string, value double, year int, population string, residence string, claim_region string")
    assert {r.claim_id: r.agrees for r in quoted_tables.read_claims(claims, quotes).collect()} == {"right": True, "named": False, "next": False}
    down = quotes.withColumn("quote", F.lit("| District | Year | Orders |\n| --- | --- | --- |\n| ASIA 1 | 1996 | 5 |"))
    assert quoted_tables.read_claims(claims.filter("claim_id <> 'next'"), down).filter("agrees").first().claim_id == "named"


def test_number_in_the_name_of_a_region_is_no_year_of_its_claim(spark):
    claim = lambda name, region, text, year: (name, region, text, 5.0, "orders", "total", None, year, ["c"])
    claims = spark.createDataFrame(
        [claim("right", "ASIA 1996", "orders of ASIA 1996, ASIA 1996, was 5 in 1997.", 1997), claim("other", "ASIA 1996", "orders of ASIA 1996 was 5 in 1998.", 1997), claim("odd", r"A\E(1999", r"orders of A\E(1999 was 5 in 1997.", 1997)],
        "claim_id string, region string, text string, value double, metric string, residence string, population string, year int, evidence_ids array<string>",
    )
    facts = spark.createDataFrame([("c", e, 5.0, "orders", "total", None, "Orders", 1997) for e in ("ASIA 1996", r"A\E(1999")], "chunk_id string, entity string, value double, metric string, residence string, population_group string, title string, year int")
    assert {r.claim_id: r.verdict for r in calculations.year_verdicts(claims, facts).collect()} == {"right": "confirmed", "other": "contradicted", "odd": "confirmed"}
