"""Requests as typed rows: scopes, metrics, targets and what must be asked back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import QUALIFIERS, is_year_change, named_years, qualifiers, squeezed

# Other names of metrics; words that name no group; deictic questions.
ALIASES = {"literacy": "literacy rate", "literacy rates": "literacy rate", "effective literacy rate": "literacy rate", "effective literacy rates": "literacy rate", "gender ratio": "sex ratio", "sex ratios": "sex ratio"}
EVERYBODY = ("total", "all", "overall", "total population", "all persons", "everyone")
SUPPORT = r"(?i)\b(?:source|sources|cite|citation|evidence|where (?:does|did) (?:that|this)|support(?:s|ed)?)\b"


def word(text: Column, pattern: str) -> Column:
    return F.coalesce(F.lower(text).rlike(rf"\b(?:{pattern})\b"), F.lit(False))


def population_scope(query: Column, given: Column) -> Column:
    """A group named in the question beats one given; words for everybody are none."""
    named = F.when(word(query, "females?|women|girls"), "female").when(word(query, "males?|men|boys"), "male").when(word(query, "persons?|people"), "persons")
    low = F.lower(F.trim(given))
    told = F.when(low.isin(*EVERYBODY), None).when(word(low, "females?|women|girls"), "female").when(word(low, "males?|men|boys"), "male").when(word(low, "persons?|people"), "persons")
    return F.coalesce(named, told)


def residence_scope(query: Column, given: Column) -> Column:
    """The one residence named in the question, else the one given."""
    named = F.array_compact(F.array(*[F.when(word(query, r), F.lit(r)) for r in ("total", "rural", "urban")]))
    told = F.lower(F.trim(given))
    return F.when(F.size(named) == 1, F.get(named, F.lit(0))).when(told.isin("total", "rural", "urban"), told)


def residence_scopes(query: Column) -> Column:
    """All residences that a question names, where it names several."""
    named = F.array_compact(F.array(*[F.when(word(query, r), F.lit(r)) for r in ("total", "rural", "urban")]))
    return F.when(F.size(named) > 1, named)


def canonical_metric(metric: Column) -> Column:
    low = F.lower(squeezed(metric))
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(table[low], low)


def unrequested_subgroups(context: Column, request: Column) -> Column:
    """Subgroups that a context is about and the request isn't."""
    return F.array_except(qualifiers(context), qualifiers(request))


def canonical(specs: DataFrame) -> DataFrame:
    """``query, metric, population, residence, regions`` in canonical form, with the kind of request."""
    q = F.col("query")
    kind = F.when(word(q, "highest|lowest|most|least|top|rank(?:ing)?"), "ranking").when(is_year_change(q), "year_change").when(F.size("regions") > 1, "comparison").when(q.rlike(SUPPORT), "source_support").otherwise("lookup")
    out = specs.withColumn("kind", kind).withColumn("population", population_scope(q, F.col("population"))).withColumn("residences", residence_scopes(q)).withColumn("residence", residence_scope(q, F.col("residence"))).withColumn("metric", canonical_metric(F.col("metric"))).withColumn("years", named_years(q))
    # A ranking is over all of one region; two regions can't be ranked as one.
    asks = F.when((F.col("kind") == "ranking") & (F.size("regions") != 1), "RANKING_NEEDS_ONE_REGION").when((F.col("kind") != "source_support") & (F.col("metric") == ""), "METRIC_NEEDED")
    return out.withColumn("clarify", asks)


def beyond(years: Column, last_year: Column) -> Column:
    """Named years that no table can know."""
    return F.filter(years, lambda y: y > last_year)


def targets(specs: DataFrame) -> DataFrame:
    """One search for each region of a comparison, one for other requests; with the text to search for."""
    t = F.explode_outer(F.when((F.col("kind") == "comparison") | (F.size("regions") > 0), F.col("regions")))
    out = specs.filter("clarify is null").select("*", t.alias("target"))
    year = F.get("years", F.lit(0)).cast("string")
    return out.withColumn("target_query", F.concat_ws(" ", year, "residence", "population", "metric", "target"))


def merged_requirement(old: DataFrame, new: DataFrame) -> DataFrame:
    """A follow-up with what the request before it said and it doesn't; a ranking stays one."""
    o = old.select("session_id", *[F.col(c).alias(f"o_{c}") for c in ("regions", "metric", "population", "residence", "kind")])
    keep = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"o_{c}")).alias(c)
    kind = F.when(F.col("o_kind") == "ranking", "ranking").otherwise(F.coalesce("kind", "o_kind")).alias("kind")
    return new.join(o, "session_id", "left").select("session_id", F.array_union("regions", F.coalesce("o_regions", F.array().cast("array<string>"))).alias("regions"), *[keep(c) for c in ("metric", "population", "residence")], kind)


def subgroup_names() -> list[str]:
    return list(QUALIFIERS)
