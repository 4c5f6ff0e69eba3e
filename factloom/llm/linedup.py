"""Operator 7: removal of repeated line passages, by overlapping windows of three lines.

A text's lines are what ``\\n`` separates.  Every three consecutive lines that
are not all blank form a window, known by a 128-bit hash.  Of a window that
occurs more than once in the corpus the first occurrence, by ``doc_id`` and
then by place, stays.  The lines that later occurrences cover are merged, as
windows overlap, and removed.  Every removed line is thus still at an earlier
place, as it belongs to an earlier occurrence.

Only hashes are grouped and joined; a window that a third of all documents
share is counted before the shuffle and split when joined.  Only texts with
something to remove are shuffled, to meet the places.  Repeated passages of one
or two lines form no window and stay, as do texts under three lines.

Rows: a null text counts as empty; texts under three lines stay whole.  Rows
that repeat a ``doc_id`` with another text are ordered by a hash of the text;
rows that repeat both are one document, and treated alike.  No rows: no rows.
Other columns are kept by :func:`without_repeated_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.bloom import free_names, member_test
from factloom.plans.staging import staged

#: Seed that makes the second half of a window's hash differ from the first.
SECOND = 0x5EED


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _window(lines: Column, i: Column) -> Column:
    parts = [F.get(lines, i + k) for k in range(3)]
    blank = F.trim(F.regexp_replace(F.concat(*parts), r"[ \t-\r]+", "")) == ""
    return F.when(~blank, F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(SECOND), *parts).alias("b")))


def places_to_remove(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, places``: starts of windows that occurred earlier, for each text that has some."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"), _lines(F.col("text")).alias("lines")).filter(F.size("lines") >= 3)
    starts = F.sequence(F.lit(0), F.size("lines") - 3)
    windows = split.select("doc_id", "text_key", F.posexplode(F.transform(starts, lambda i: _window(F.col("lines"), i))).alias("place", "w")).filter("w is not null")
    windows = staged(windows.select("doc_id", "text_key", "place", "w.a", "w.b"), "windows")
    counted = windows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    repeated = staged(counted.filter("n > 1").drop("n"), "repeated")
    met = windows.join(repeated, ["a", "b"])
    at_first = F.col("doc_id").eqNullSafe(F.col("first_id"))
    other = met.filter(~at_first).select("doc_id", "text_key", "place")
    # Within the document of the first occurrence, later ones go as well.
    inner = Window.partitionBy("a", "b").orderBy("text_key", "place")
    same = met.filter(at_first).withColumn("nth", F.dense_rank().over(inner)).filter("nth > 1").select("doc_id", "text_key", "place")
    return other.unionByName(same).groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its text shortened, and ``n_lines`` and ``n_removed`` in place of any such columns.

    A filter of the texts with something to remove lets all others pass
    straight through; only those that it takes in are shuffled.  Other columns
    keep whatever names they have.
    """
    docs = docs.drop("n_lines", "n_removed")
    places = staged(places_to_remove(docs), "places")
    some = member_test(places, "text_key")
    key, found = free_names(docs, "text_key", "found")
    text, lines = F.coalesce(F.col("text").cast("string"), F.lit("")), _lines(F.col("text"))
    keyed = docs.withColumn(key, F.xxhash64(text))
    n_lines = F.size(lines).cast("long").alias("n_lines")
    shown = lambda new: [new.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    straight = keyed.filter(~some(F.col(key))).select(*shown(text), n_lines, F.lit(0).cast("long").alias("n_removed"))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.array(p, p + 1, p + 2))))
    remove = places.select(F.struct("doc_id", "text_key", covered.alias("covered")).alias(found))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(found)["doc_id"]) & (F.col(key) == F.col(found)["text_key"])
    met = keyed.filter(some(F.col(key))).join(remove, same, "left")
    # The numbers of the lines that stay, and so the lines themselves, by one pass over each list.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(F.col(found)["covered"], F.array().cast("array<int>")))
    (both,) = free_names(met, "both")
    cut = met.withColumn(both, F.struct(stay.alias("stay"), lines.alias("lines")))
    left = F.array_join(F.transform(F.col(both)["stay"], lambda i: F.get(F.col(both)["lines"], i)), "\n")
    removed = (F.size(F.col(both)["lines"]) - F.size(F.col(both)["stay"])).cast("long")
    cut = cut.select(*shown(left), n_lines, removed.alias("n_removed"))
    return straight.unionByName(cut)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256``, one row for each of ``docs``."""
    cut = without_repeated_lines(docs.select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    s AS (SELECT doc_id, unnest(range(0, greatest(len(l) - 2, 0))) AS place, l FROM d),
    w AS (SELECT doc_id, place, l[place + 1] || chr(10) || l[place + 2] || chr(10) || l[place + 3] AS w FROM s),
    r AS (SELECT doc_id, place, row_number() OVER (PARTITION BY w ORDER BY doc_id, place) AS nth FROM w WHERE regexp_replace(w, '[ \t-\r]+', '', 'g') <> ''),
    gone AS (SELECT DISTINCT doc_id, place + k AS place FROM r, (VALUES (0), (1), (2)) t(k) WHERE nth > 1),
    each_line AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS place FROM d)
    SELECT e.doc_id, count(*) AS n_lines, count(g.place) AS n_removed,
           sha256(coalesce(string_agg(e.line, chr(10) ORDER BY e.place) FILTER (WHERE g.place IS NULL), '')) AS kept_sha256
    FROM each_line e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.place = g.place GROUP BY e.doc_id
"""
