"""Operator 11: ranked lexical search by scanning documents with an Aho-Corasick automaton.

Terms are the maximal runs of digits, ASCII letters and characters beyond
ASCII; only A-Z are lower-cased.  In UTF-8 all bytes of characters beyond ASCII
are above 0x7F, so one table of 256 bytes folds a text and turns all that
separates terms into spaces.  The automaton holds each term of the items between
two spaces: its matches are whole terms, overlapping in a space only, and each
match names a term, which the postings of the *items* map to items.  Nothing is
kept about documents: a first scan counts documents, lengths and document
frequencies, a second one scores, and each task keeps the best of each item.

Items are dealt to groups of about ``MOST_PAIRS`` pairs of item and term; a
group is what is sent to tasks, so its size is bounded whatever the number of
items (a single item of more terms makes a larger group).  Each group scans the
documents for itself.  Weights are computed in doubles, all else in integers.

Rows: a null or empty text has no term and is never ranked.  Very long texts are
scanned in pieces cut at spaces, which no term crosses, and counted as one.
Every row of documents is one document: rows that repeat are ranked each.  Equal
scores go by ``doc_id``, a null one last.  Rows of items with the same
``item_id`` are one item, whose terms are added up; an item without terms, or
whose terms no document has, has no rows.  No documents or no items: no rows.
Other columns of either table are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.spans import give_back
from factloom.plans.staging import staged

#: Best documents of each item.
TOP = 10
#: Pairs of item and term that go to the tasks at once, about.
MOST_PAIRS = 400_000
#: Bytes of texts that are scanned together, cells of a matrix of scores, candidates of a task before they are cut.
PIECE, CELLS, HELD = 1 << 20, 1 << 20, 1 << 20
#: Shares over which the candidates of an item are cut before they meet.
SHARES = 64
# Fixed values of the score: saturation, length normalisation in percent, scale.
B_PERCENT, SCALE = 75, 1_000_000_000

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 32 for b in range(256))


def terms_of(items: DataFrame) -> DataFrame:
    """``item_id, term, times``: the distinct terms of each item, folded, in UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = Counter((text.as_py() or "").encode().translate(FOLD).split())
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["item_id", "term", "times"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class Group:
    """Some items: their distinct terms, and by term the items that hold it, with the times."""

    def __init__(self, rows: list) -> None:
        self.items = sorted({r["item_id"] for r in rows}, key=lambda i: (i is None, i))
        place = {i: k for k, i in enumerate(self.items)}
        self.terms = sorted({bytes(r["term"]) for r in rows})
        number = {t: k for k, t in enumerate(self.terms)}
        term = np.array([number[bytes(r["term"])] for r in rows], np.int64)
        order = np.argsort(term, kind="stable")
        self.item = np.array([place[r["item_id"]] for r in rows], np.int64)[order]
        self.times = np.array([r["times"] for r in rows], np.int64)[order]
        self.many = np.bincount(term, minlength=len(self.terms))
        self.begin = np.cumsum(self.many) - self.many

    def automaton(self) -> ahocorasick.Automaton:
        """Each term between two spaces; bytes stand as the characters of the same number."""
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, t in enumerate(self.terms):
            made.add_word(f" {t.decode('latin-1')} ", k)
        made.make_automaton()
        return made

    def scores(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """The values of a row's terms, added up by item: a row for each document."""
        wide = self.many[term]
        at = np.repeat(self.begin[term] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
        out = np.zeros(rows * len(self.items), np.int64)
        np.add.at(out, np.repeat(row, wide) * len(self.items) + self.item[at], np.repeat(value, wide) * self.times[at])
        return out.reshape(rows, -1)


class Scanner:
    """A group's automaton in one worker."""

    def __init__(self, sent: Broadcast) -> None:
        if not hasattr(sent, "automaton"):
            sent.automaton = sent.value[0].automaton()
        self.find = sent.automaton.iter

    def _pieces(self, text: str) -> Iterator[tuple[int, str]]:
        """Stretches of a folded text that begin and end with a space, which neighbours share."""
        at = 0
        while at < len(text) - 1:
            until = text.find(" ", at + PIECE)
            until = len(text) - 1 if until < 0 else until
            yield at, text[at : until + 1]
            at = until

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and frequency of each term found, and how many terms each row has."""
        folded = b" ".join([b"", *texts, b""]).translate(FOLD)
        ends = np.cumsum([len(t) + 1 for t in texts])  # the space after each text
        raw = np.frombuffer(folded, np.uint8) != 32
        begins = np.concatenate([[0], np.cumsum(raw[1:] & ~raw[:-1])])
        n = np.diff(begins[ends], prepend=0)
        joined, row, term = folded.decode("latin-1"), [], []
        for at, piece in self._pieces(joined):
            found = np.fromiter(self.find(piece), [("end", "i8"), ("term", "i8")])
            row.append(np.searchsorted(ends, found["end"] + at))
            term.append(found["term"])
        key, tf = np.unique(np.concatenate(row) << 32 | np.concatenate(term), return_counts=True) if row else (np.zeros(0, np.int64),) * 2
        return key >> 32, key & 0xFFFFFFFF, tf.astype(np.int64), n


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Ids and texts in UTF-8, about ``PIECE`` bytes at a time; null becomes empty."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
            ids.append(i)
            texts.append(text.as_py() or b"")
            size += len(texts[-1])
            if size >= PIECE:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts
        del ids, texts, batch
        give_back()


class Best:
    """The best documents of each item among what was added: by score, ties by ``doc_id``."""

    def __init__(self, items: int) -> None:
        self.floor, self.parts, self.held = np.ones(items, np.int64), [], 0

    def add(self, ids: np.ndarray, absent: np.ndarray, scores: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.floor)
        self.parts.append((item, ids[row], absent[row], scores[row, item]))
        self.held += len(row)
        if self.held > HELD:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 4
        item, ids, absent, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ids, absent, -score, item))
        item, ids, absent, score = item[order], ids[order], absent[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == TOP - 1
        self.floor[item[last]] = score[last]
        keep = place < TOP
        self.parts, self.held = [(item[keep], ids[keep], absent[keep], score[keep])], int(keep.sum())
        return self.parts[0]


def _statistics(docs: DataFrame, sent: Broadcast, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and by term the documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, df = Scanner(sent), np.zeros(terms + 2, np.int64)
        for _, texts in _texts(batches):
            _, term, _, n = scan(texts)
            df[:terms] += np.bincount(term, minlength=terms)
            df[terms:] += (int((n > 0).sum()), int(n.sum()))
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(df[hit], pa.int64())], ["term", "n"])

    counts = np.zeros(terms + 2, np.int64)
    for r in docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # the terms of a group
        counts[r["term"]] = r["n"]
    return int(counts[terms]), int(counts[terms + 1]), counts[:terms]


def _candidates(docs: DataFrame, group: Group) -> DataFrame | None:
    """``item_id, doc_id, score``: the best of each task; None where no document has a term."""
    context = docs.sparkSession.sparkContext
    number, total, df = _statistics(docs, context.broadcast((group,)), len(group.terms))
    if not df.any():
        return None
    weight = np.array([math.floor(1000 * math.log((2 * number + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    sent = context.broadcast((group, weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weights = sent.value
        scan, best = Scanner(sent), Best(len(held.items))
        step = max(1, CELLS // len(held.items))
        for ids, texts in _texts(batches):
            for at in range(0, len(ids), step):
                row, term, tf, n = scan(texts[at : at + step])
                norm = np.array([100 - B_PERCENT + B_PERCENT * k * number // total for k in n.tolist()], np.int64)
                value = weights[term] * (SCALE * tf // (1000 * tf + 8 * norm[row]))
                some = ids[at : at + step]
                best.add(np.array([i or 0 for i in some], np.int64), np.array([i is None for i in some]), held.scores(row, term, value, len(n)))
        item, doc, absent, points = best.cut()
        names = pa.array(held.items, pa.int64()).take(pa.array(item, pa.int64()))
        yield pa.RecordBatch.from_arrays([names, pa.array(doc, pa.int64(), mask=absent.astype(bool)), pa.array(points, pa.int64())], ["item_id", "doc_id", "score"])

    return docs.mapInArrow(score, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``TOP`` documents of each item with a score above 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = staged(terms_of(items), "item-terms")
    groups = max(1, -(-terms.count() // MOST_PAIRS))
    parts = []
    for g in range(groups):
        held = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()  # MOST_PAIRS, about
        found = _candidates(rows, Group(held)) if held else None
        if found is not None:
            parts.append(staged(found, "candidates"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = reduce(DataFrame.unionByName, parts).withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= TOP)
    return best(best(found, "item_id", "share"), "item_id").select("item_id", "rank", "doc_id", "score")


SQL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
    t AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
    f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, t GROUP BY term),
    s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * n_docs) // n_terms)))))::BIGINT AS score FROM f JOIN w USING (term) JOIN q USING (term), t GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
