"""Scores of a stated set of queries against all items, block by block inside the tasks that hold the items.

Queries go to the tasks in groups of a bounded size; each task keeps the best
items of each query, so what is shuffled is that many rows for a task and a
query, however common a term is and however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries that go to the tasks at once, about; cells of a matrix of scores, or finds, that a task holds beside the best.
GROUP, CELLS = 2048, 1 << 18


def in_groups(queries: DataFrame) -> Iterator[DataFrame]:
    """Parts of a set of queries with about ``GROUP`` rows each."""
    groups = max(1, -(-queries.count() // GROUP))
    for g in range(groups):
        yield queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)


class Best:
    """The best ``n`` items of each query among what was added: by score, ties by item."""

    def __init__(self, n: int, queries: int) -> None:
        self.n, self.floor = n, np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, items: np.ndarray, scores: np.ndarray, live: np.ndarray) -> None:
        """``scores`` has a row for each item and a column for each query; only ``live`` cells count."""
        row, query = np.nonzero(live & (scores >= self.floor))
        self.parts.append((query, items[row], scores[row, query]))
        self._added(len(row))

    def _added(self, n: int) -> None:
        self.held += n
        # As many again as the best, so that a cut drops half of what it sorts.
        if self.held > 2 * self.n * len(self.floor) + CELLS:
            self.cut()

    def some(self, queries: np.ndarray, items: np.ndarray, scores: np.ndarray) -> None:
        """Like :meth:`add`, for the queries of the columns alone."""
        row, column = np.nonzero(scores >= self.floor[queries])
        self.parts.append((queries[column], items[row], scores[row, column]))
        self._added(len(row))

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        query, item, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts = []
        order = np.lexsort((np.unique(item, return_inverse=True)[1], -score, query))
        query, item, score = query[order], item[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.n
        last = place == self.n - 1
        self.floor[query[last]] = score[last]
        self.parts, self.held = [(query[keep], item[keep], score[keep])], int(keep.sum())
        return self.parts[0]

    def batch(self, ids: pa.Array, item_type: pa.DataType, name: str) -> pa.RecordBatch:
        query, item, score = self.cut()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(query, pa.int64())), pa.array(item if item.dtype != object else item.tolist(), item_type), pa.array(score, pa.float64())], ["query_id", name, "score"])


def _ids(queries: DataFrame, rows: list) -> pa.Array:
    return pa.array([r["query_id"] for r in rows], to_arrow_type(queries.schema["query_id"].dataType))


def _kinds(queries: DataFrame, items: DataFrame, item: str) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, {item} {items.schema[item].dataType.simpleString()}, score double"


def dense(queries: DataFrame, items: DataFrame, n: int, item: str) -> Iterator[DataFrame]:
    """``query_id, item, score``: for each task of ``items`` the ``n`` most similar by cosine; vectors of another size meet none."""
    for group in in_groups(queries):
        rows = group.select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector")).collect()  # GROUP rows, about
        if not rows:
            continue
        width = len(rows[0]["vector"] or [])
        rows = [r for r in rows if r["vector"] and len(r["vector"]) == width]
        matrix = np.array([r["vector"] for r in rows])
        sent = items.sparkSession.sparkContext.broadcast((_ids(queries, rows), matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, width=width) -> Iterator[pa.RecordBatch]:
            ids, asked = sent.value
            best, kind = Best(n, len(asked)), None
            step = max(1, CELLS // len(asked))
            for batch in batches:
                kind = batch.column(0).type
                for at in range(0, batch.num_rows, step):
                    some = batch.slice(at, step)
                    v = some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
                    scores = np.round(v @ asked.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300), 6)
                    best.add(some.column(0).to_numpy(zero_copy_only=False), scores, np.ones(scores.shape, bool))
            if kind is not None:
                yield best.batch(ids, kind, item)

        fit = items.filter((F.size("vector") == width) & ~F.exists("vector", lambda x: x.isNull()))
        yield fit.select(item, "vector").mapInArrow(run, _kinds(queries, items, item))


def bm25(queries: DataFrame, items: DataFrame, n: int, item: str, k1: float, b: float, average: float) -> Iterator[DataFrame]:
    """``query_id, item, score`` for each task of ``items``: ``queries`` has distinct ``terms``, ``items`` has ``terms`` as they stand.

    One pass counts in how many items each asked term stands, a second scores.
    """
    total = items.count()
    for group in in_groups(queries):
        rows = group.select("query_id", "terms").collect()  # GROUP rows, about
        terms = sorted({t for r in rows for t in r["terms"]})
        if not terms:
            continue
        number = {t: k for k, t in enumerate(terms)}
        listed = [[] for _ in terms]
        for q, r in enumerate(rows):
            for t in r["terms"]:
                listed[number[t]].append(q)
        counts = np.array([len(x) for x in listed])
        sent = items.sparkSession.sparkContext.broadcast((_ids(queries, rows), pa.array(terms), np.concatenate([np.array(x, np.int64) for x in listed]), np.cumsum(counts) - counts, counts))

        def postings(batch: pa.RecordBatch, asked: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Row, term and frequency of asked terms, and the lengths of all rows."""
            column = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            known = pc.fill_null(pc.index_in(column.flatten(), value_set=asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lengths)), lengths)[known >= 0]
            key, tf = np.unique(row * len(asked) + known[known >= 0], return_counts=True)
            return key // len(asked), key % len(asked), tf, lengths

        def parts(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
            """Batches cut to ``step`` rows and about ``CELLS`` words, one row at least."""
            for batch in batches:
                ends, at = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)), 0
                while at < batch.num_rows:
                    full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right"))
                    to = min(batch.num_rows, at + step, max(at + 1, full))
                    yield batch.slice(at, to - at)
                    at = to

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked = sent.value[1]
            found = np.zeros(len(asked), np.int64)
            for some in parts(batches, GROUP):
                found += np.bincount(postings(some, asked)[1], minlength=len(asked))
            hit = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(found[hit], pa.int64())], ["term", "df"])

        held = items.select(item, "terms")
        df = np.zeros(len(terms))
        for r in held.mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # asked terms
            df[r["term"]] = r["df"]
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))

        def score(batches: Iterator[pa.RecordBatch], sent=sent, idf=idf) -> Iterator[pa.RecordBatch]:
            ids, asked, of_term, begin, many = sent.value
            best, kind = Best(n, len(ids)), None
            for some in parts(batches, max(1, CELLS // len(ids))):
                kind = some.column(0).type
                row, term, tf, lengths = postings(some, asked)
                weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[row] / average))
                scores = np.zeros((some.num_rows, len(ids)))
                # Terms of many queries: as many postings at a time as meet CELLS of them.
                met = np.cumsum(many[term])
                at = 0
                while at < len(row):
                    to = max(at + 1, int(np.searchsorted(met, (met[at - 1] if at else 0) + CELLS, "right")))
                    t, wide = term[at:to], many[term[at:to]]
                    query = of_term[np.repeat(begin[t], wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)]
                    cell = np.repeat(row[at:to], wide) * len(ids) + query
                    scores += np.bincount(cell, np.repeat(weight[at:to], wide), minlength=scores.size).reshape(scores.shape)
                    at = to
                best.add(some.column(0).to_numpy(zero_copy_only=False), np.round(scores, 6), scores > 0)
            if kind is not None:
                yield best.batch(ids, kind, item)

        yield held.mapInArrow(score, _kinds(queries, items, item))
