"""Places of regular-expression matches in texts, by SQL functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points kept of what lies before and after a match.
BEFORE, AFTER = 32, 8
EMPTY = "array<struct<start:int,end:int,found:string,before:string,after:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def prefixes(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each value what those before it merge to, by blocks of about the root of their number."""

    def some(vs: Column) -> Column:
        block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(vs))).cast("int"))
        part = lambda j: F.floor(j / block).cast("int")
        totals = F.transform(F.sequence(F.lit(0), part(F.size(vs) - 1)), lambda j: F.aggregate(F.slice(vs, j * block + 1, block), zero, merge))
        before = let(totals, lambda t: F.transform(t, lambda _, j: F.aggregate(F.slice(t, F.lit(1), j), zero, merge)))
        filled = lambda ts: F.transform(vs, lambda _, i: F.aggregate(F.slice(vs, part(i) * block + 1, i - part(i) * block), F.get(ts, part(i)), merge))
        return F.when(F.size(vs) > 0, let(before, filled)).otherwise(vs)

    return let(values, some)


def matches(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches: ``start, end`` in code points from 0, end exclusive, the text, and its surroundings.

    A match starts after all the pieces between matches and all the matches
    before it.  These running sums go by blocks of about the root of the
    number of matches, so that many matches in one text stay cheap.
    """

    def placed(found: Column, pieces: Column, lengths: Column) -> Column:
        n = F.size(found)
        block = F.ceil(F.sqrt(n)).cast("int")
        part = lambda j: _sum(F.slice(lengths, j * block + 1, block))
        sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), part)

        def located(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                j = F.floor(i / block).cast("int")
                start = F.get(before, j) + _sum(F.slice(lengths, j * block + 1, i - j * block)) + F.length(F.get(pieces, i))
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("found"), F.right(F.get(pieces, i), F.lit(BEFORE)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(AFTER)).alias("after"))

            return F.transform(found, one)

        return let(let(sums, lambda s: F.transform(s, lambda _, j: _sum(F.slice(s, 1, j)))), located)

    def some(found: Column) -> Column:
        split = F.split(text, pattern, -1)
        lengths = lambda pieces: F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.length(m) + F.length(p))
        filled = let(split, lambda pieces: let(lengths(pieces), lambda ls: placed(found, pieces, ls)))
        return F.when(F.size(found) > 0, filled).otherwise(F.array().cast(EMPTY))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def kinds(kind: str, order: int, found: Column, good: Callable[[Column], Column]) -> Column:
    """Of matches those that are good, as ``start, rank, end, kind, found, before, after``."""
    return F.transform(F.filter(found, good), lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["found"].alias("found"), m["before"].alias("before"), m["after"].alias("after")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans by start, then rank, joined with commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
