"""Scalar expressions over text, cells and numbers; all run inside the JVM.

Java's ``\\b`` and ``\\d`` read ASCII only, and lower case stands for case
folding, so the patterns say what they match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name space of chunk ids and, by RFC 9562, of URLs.
CHUNK_NAMESPACE = "8f125211-267f-47f0-a9dd-751177dcc485"
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
# Words and patterns that name dimensions of a printed table.
RESIDENCES = ("total", "rural", "urban")
GROUPS = {"persons": "persons", "person": "persons", "males": "males", "male": "males", "females": "females", "female": "females"}
YEAR = r"\b(?:19|20)[0-9]{2}\b"
PERIOD = r"\b((?:19|20)[0-9]{2})\s*[-–—]\s*((?:19|20)?[0-9]{2})\b"
UNIT = r"(?i)\(([^()]*\bper\b[^()]*)\)"
QUALIFIERS = {
    "scheduled castes": r"(?i)\bscheduled\s+castes?\b",
    "scheduled tribes": r"(?i)\bscheduled\s+tribes?\b",
    "children 0-6": r"(?i)\bchild(?:ren)?\b|\(?\b0\s*-\s*6\s*years?\b\)?",
}
METRIC_STOP_WORDS = ("a", "among", "an", "and", "as", "by", "effective", "for", "in", "number", "of", "on", "the", "to", "with")
SEARCH_STOP_WORDS = ("a", "an", "and", "in", "is", "of", "the", "to", "was", "what")
CHANGE_WORDS = r"(?i)\b(?:change[ds]?|differ(?:ence|ed)?|increase[ds]?|decrease[ds]?|gr[eo]w(?:th|n)?|r[io]se|fell|fall|trend|compare[ds]?|between)\b"


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain(cell: Column) -> Column:
    """A cell or block without tags and emphasis marks."""
    return squeezed(F.regexp_replace(F.regexp_replace(cell, "<[^>]+>", " "), "[*_`]+", ""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def parse_number(raw: Column) -> Column:
    """The value of a cell that is a number as a whole, with any grouping; else null."""
    bare = F.trim(F.regexp_replace(raw, ",", ""))
    return F.when(bare.rlike("[0-9]"), bare.try_cast("decimal(38,10)"))


def numbers(text: Column) -> Column:
    """All numbers of a text in order, commas dropped."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w.])-?[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), lambda n: F.regexp_replace(n, ",", "").try_cast("double"))


def named_years(text: Column) -> Column:
    """Distinct years from 1800 to 2199, in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b(?:18|19|20|21)[0-9]{2}\b"), F.lit(0)), lambda y: y.cast("int")))


def is_year_change(text: Column) -> Column:
    return (F.size(named_years(text)) >= 2) & text.rlike(CHANGE_WORDS)


def single_year(text: Column) -> Column:
    """The one year that a text names; null if it names a period or several."""
    years = F.array_distinct(F.regexp_extract_all(text, F.lit(YEAR), F.lit(0)))
    return F.when(~text.rlike(PERIOD) & (F.size(years) == 1), F.get(years, F.lit(0)).cast("int"))


def periods(text: Column) -> Column:
    """Periods with both years written out."""
    whole = lambda p: F.concat(F.regexp_extract(p, PERIOD, 1), F.lit("-"), F.when(F.length(F.regexp_extract(p, PERIOD, 2)) == 4, F.lit("")).otherwise(F.left(p, F.lit(2))), F.regexp_extract(p, PERIOD, 2))
    return F.transform(F.regexp_extract_all(text, F.lit(PERIOD), F.lit(0)), whole)


def qualifiers(text: Column) -> Column:
    """The population subgroups that a text names."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in QUALIFIERS.items()]))


def singular(word: Column) -> Column:
    return F.when((F.length(word) > 3) & word.endswith("s") & ~word.rlike("(?:ss|us|is)$"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def metric_words(text: Column) -> Column:
    """The set of words that tell a metric, sorted: no years, units, subgroups, dimensions or stop words."""
    bare = reduce(lambda t, p: F.regexp_replace(t, p, " "), [*QUALIFIERS.values(), UNIT, PERIOD, YEAR], text)
    drop = sorted({*METRIC_STOP_WORDS, *RESIDENCES, *GROUPS} | {w[:-1] for w in GROUPS if w.endswith("s")})
    return F.array_sort(F.array_except(F.array_distinct(F.transform(tokens(bare), singular)), F.array(*map(F.lit, drop))))


def unit(metric: Column, title: Column) -> Column:
    """The unit in brackets, of the metric before the title; else what such metrics are counted in."""
    bracket = lambda t: F.when(t.rlike(UNIT), squeezed(F.regexp_replace(F.regexp_extract(t, UNIT, 1), r"(?i)^\s*number\s+of\s+", "")))
    ratio = F.when(F.size(qualifiers(metric)) > 0, "girls per 1000 boys").otherwise("females per 1000 males")
    return F.coalesce(bracket(metric), bracket(F.coalesce(title, F.lit(""))), F.when(F.lower(metric).contains("sex ratio"), ratio), F.when(F.lower(metric).rlike(r"\b(?:rate|percentage|proportion|per\s*cent|decadal)\b"), "percent"), F.lit("persons"))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5)."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def slug(name: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def default_title(message: Column) -> Column:
    """A session's title from its first message: at most 60 characters, cut at a word."""
    text = squeezed(message)
    cut = F.left(text, F.lit(60))
    at_word = F.when(cut.rlike(" "), F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(text) <= 60, text).otherwise(F.concat(F.regexp_replace(at_word, "[ ,.;:]+$", ""), F.lit("…")))


def western(n: Column) -> Column:
    """Digits in groups of three."""
    return F.regexp_replace(n.cast("string"), r"(?<=[0-9])(?=(?:[0-9]{3})+(?:\.|$))(?<!\.[0-9]{0,9})", ",")


def indian(n: Column) -> Column:
    """The last three digits, then groups of two."""
    return F.regexp_replace(n.cast("string"), r"(?<=[0-9])(?=(?:[0-9]{2})*[0-9]{3}(?:\.|$))(?<!\.[0-9]{0,9})", ",")


def same_number(a: Column, b: Column, within: float = 0.005) -> Column:
    return F.abs(a - b) <= within


def decimals(value: Column) -> Column:
    """Digits after the point as a number is stated."""
    return F.length(F.regexp_extract(value.cast("string"), r"\.([0-9]+)$", 1))


def compatible_rounding(a: Column, b: Column) -> Column:
    """Whether the less precise of two stated numbers is the other, rounded half to even."""
    def to(x: Column, places: Column) -> Column:
        rounded = F.when(places == 0, F.bround(x.cast("decimal(38,10)"), 0))
        for n in range(1, 7):
            rounded = rounded.when(places == n, F.bround(x.cast("decimal(38,10)"), n))
        return rounded.otherwise(x.cast("decimal(38,10)")).cast("decimal(38,10)")

    places = F.least(decimals(a), decimals(b))
    return to(a, places) == to(b, places)
