"""A vector index as files: lists around centroids, of which a query opens the nearest.

Centroids are fitted on a bounded sample in two levels, so that a vector meets
the square root of their number when it is dealt to a list.  Vectors are
written sorted by list in shelves, which a search prunes to the lists it opens.
Further vectors are a further segment under the same centroids.  A list knows
the largest angle between its centroid and a vector, which bounds the
similarity of any of its vectors with a query; an exact search opens, after the
nearest lists, all those whose bound reaches the query's n-th best.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.scoring import CELLS, Best, in_groups
from factloom.plans.staging import staged

#: Lists at most, sample rows for each, numbers in the sample at most, rounds of fitting, shelves.
MOST_LISTS, PER_LIST, SAMPLE_NUMBERS, ROUNDS, SHELVES = 16_384, 64, 1 << 24, 8, 64
#: Queries that the number of probes is set by.
CALIBRATED = 64
#: Room for rounding of similarities to six decimals.
ROOM = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """Centroids by list, the first list of each top centroid, and the folder."""

    spark: SparkSession
    path: str
    top: np.ndarray
    first: np.ndarray
    centroids: np.ndarray

    def segments(self, name: str) -> DataFrame | None:
        context = self.spark.sparkContext
        # A segment is one once its lists are written, after its vectors.
        last = "lists" if name == "vectors" else name
        pattern = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/{last}/_SUCCESS")
        found = pattern.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(pattern) or []
        parts = [self.spark.read.parquet(f"{f.getPath().getParent().getParent().toString()}/{name}") for f in found]
        return reduce(DataFrame.unionByName, parts) if parts else None


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _fitted(points: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``k`` unit centroids at most, and the nearest for each point: spherical k-means from distinct points."""
    rng = np.random.default_rng(seed)
    centers = points[rng.permutation(len(points))[:k]]
    for _ in range(ROUNDS):
        near = (points @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        filled = np.bincount(near, minlength=len(centers)) > 0
        centers = np.where(filled[:, None], _unit(sums), centers)
    return centers, (points @ centers.T).argmax(1)


def fit(items: DataFrame, path: str, lists: int | None = None, seed: int = 7) -> VectorIndex:
    """An empty index whose centroids are fitted on a sample of ``items`` (``vector``), of as many lists as the root of their number.

    The sample is picked by a hash of the vector, in the tasks; it has at most
    ``SAMPLE_NUMBERS`` numbers.
    """
    spark = items.sparkSession
    fit_ = items.filter(F.size("vector") > 0)
    size = fit_.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not size["n"]:
        raise ValueError("nothing to fit centroids on")
    lists = min(MOST_LISTS, lists or max(1, math.isqrt(size["n"])))
    rows = max(1, min(PER_LIST * lists, SAMPLE_NUMBERS // size["width"]))
    picked = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * rows / size["n"])) + 1
    sample = fit_.filter(F.size("vector") == size["width"]).filter(picked).select("vector").limit(rows).collect()
    points = _unit(np.array([r["vector"] for r in sample], float))
    top, near = _fitted(points, max(1, math.isqrt(lists)), seed)
    share = np.maximum(1, np.round(np.bincount(near, minlength=len(top)) * lists / len(points))).astype(int)
    below = [_fitted(points[near == k], int(share[k]), seed + k)[0] if (near == k).any() else top[k : k + 1] for k in range(len(top))]
    first = np.cumsum([0, *map(len, below)])
    return VectorIndex(spark, path, top, first, np.concatenate(below))


def _nearest(index: tuple[np.ndarray, np.ndarray, np.ndarray], v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The list of each unit vector, and its angle to the centroid: among those of the nearest top centroid."""
    top, first, centroids = index
    group, of, angle = (v @ top.T).argmax(1), np.zeros(len(v), np.int64), np.zeros(len(v))
    for k in np.unique(group).tolist():
        some = np.flatnonzero(group == k)
        near = v[some] @ centroids[first[k] : first[k + 1]].T
        of[some] = near.argmax(1) + first[k]
        angle[some] = np.arccos(np.clip(near.max(1), -1, 1))
    return of, angle


def add(index: VectorIndex, items: DataFrame, item: str = "chunk_id") -> None:
    """Deal ``items`` (``item, vector``) to lists and write them as a further segment; vectors of another size are left out."""
    segment = f"s-{uuid.uuid4().hex}"
    sent = index.spark.sparkContext.broadcast((index.top, index.first, index.centroids))
    width = index.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten()
            of, angle = _nearest(sent.value, _unit(flat.to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of, pa.int32()), pa.array(angle)], [item, "vector", "list", "angle"])

    kinds = f"{item} {items.schema[item].dataType.simpleString()}, vector {items.schema['vector'].dataType.simpleString()}, list int, angle double"
    good = items.filter((F.size("vector") == width) & ~F.exists("vector", lambda x: x.isNull()))
    dealt = staged(good.select(item, "vector").mapInArrow(run, kinds).withColumn("shelf", F.pmod(F.col("list"), F.lit(SHELVES))), "dealt")
    stats = dealt.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    # A list that holds a large share of all vectors is dealt to several files.
    files = dealt.drop("angle").repartition("shelf", F.pmod(F.xxhash64(item), F.lit(8))).sortWithinPartitions("shelf", "list", item)
    files.write.partitionBy("shelf").parquet(f"{index.path}/{segment}/vectors")
    stats.write.parquet(f"{index.path}/{segment}/lists")


def remove(index: VectorIndex, ids: DataFrame, item: str = "chunk_id") -> None:
    """Note items as removed; searches leave them out."""
    ids.select(item).distinct().write.parquet(f"{index.path}/r-{uuid.uuid4().hex}/removed")


def _opened(index: VectorIndex, asked: np.ndarray, ids: pa.Array, pairs: np.ndarray, n: int, item: str, kinds: str) -> DataFrame:
    """``query_id, item, score``: the best of each task, of vectors in the lists that a query opens; ``pairs`` has a row for each query and a column for each list."""
    lists = np.flatnonzero(pairs.any(0)).tolist()
    spark = index.spark
    vectors = index.segments("vectors").filter(F.col("shelf").isin(sorted({k % SHELVES for k in lists})) & F.col("list").isin(lists))
    gone = index.segments("removed")
    vectors = vectors if gone is None else vectors.join(gone, item, "left_anti")
    by_list = {k: np.flatnonzero(pairs[:, k]) for k in lists}
    sent = spark.sparkContext.broadcast((ids, asked, by_list))
    width = asked.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, open_ = sent.value
        best, kind = Best(n, len(q)), None
        for batch in batches:
            kind = batch.column(0).type
            of = batch.column(2).to_numpy()
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
            held = batch.column(0).to_numpy(zero_copy_only=False)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            for k in np.unique(of).tolist():
                every, step = np.flatnonzero(of == k), max(1, CELLS // max(1, len(open_[k])))
                for at in range(0, len(every), step):
                    rows = every[at : at + step]
                    best.some(open_[k], held[rows], np.round(v[rows] @ q[open_[k]].T, 6))
        if kind is not None:
            yield best.batch(names, kind, item)

    return vectors.select(item, "vector", "list").mapInArrow(run, kinds)


def search(index: VectorIndex, queries: DataFrame, n: int, probes: int = 8, exact: bool = False, item: str = "chunk_id") -> DataFrame:
    """``query_id, item, score``: candidates among which the ``n`` best of each query are, from its ``probes`` nearest lists, or from all that could hold one of them.

    Queries (``query_id, vector``) come in groups of bounded size; centroids
    and bounds are bounded too, so lists are chosen at the driver.
    """
    from factloom.operators.retrieval import _best  # the rule of ties
    from factloom.operators.scoring import _ids, _kinds

    radius, found = np.full(len(index.centroids), -1.0), []
    for r in index.segments("lists").groupBy("list").agg(F.max("radius").alias("radius")).collect():  # MOST_LISTS rows at most
        radius[r["list"]] = r["radius"]
    kinds = _kinds(queries, index.segments("vectors"), item)
    width = index.centroids.shape[1]
    for group in in_groups(queries):
        rows = group.filter(F.size("vector") == width).select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector")).collect()  # GROUP rows, about
        if not rows:
            continue
        ids, asked = _ids(queries, rows), _unit(np.array([r["vector"] for r in rows]))
        near = np.where(radius >= 0, asked @ index.centroids.T, -2)
        order = np.argsort(-near, axis=1)[:, :probes]
        pairs = np.zeros(near.shape, bool)
        np.put_along_axis(pairs, order, True, 1)
        pairs &= radius >= 0
        some = staged(_opened(index, asked, ids, pairs, n, item, kinds), "probed")
        found.append(some)
        if exact:
            floor = {r["query_id"]: r["score"] for r in _best(some, n, item).filter(F.col("rank") == n - 1).collect()}  # one for each query of the group
            least = np.array([floor.get(i, -2.0) for i in ids.to_pylist()]) - ROOM
            bound = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - radius - 1e-9))
            further = (bound >= least[:, None]) & (radius >= 0) & ~pairs
            if further.any():
                found.append(staged(_opened(index, asked, ids, further, n, item, kinds), "further"))
    none = queries.select("query_id").join(index.segments("vectors").select(item), F.lit(False)).withColumn("score", F.lit(0.0))
    return reduce(DataFrame.unionByName, found) if found else none


def calibrated(index: VectorIndex, queries: DataFrame, n: int, recall: float = 0.95, item: str = "chunk_id") -> int:
    """The number of probes by which ``recall`` of the ``n`` best are found, as exact searches for ``CALIBRATED`` of ``queries`` tell."""
    from factloom.operators.retrieval import _best

    some = staged(queries.filter(F.size("vector") == index.centroids.shape[1]).orderBy(F.xxhash64("query_id")).limit(CALIBRATED), "calibrating")
    best = _best(search(index, some, n, exact=True, item=item), n, item).select("query_id", item)
    lists = best.join(index.segments("vectors").select(item, "list").distinct(), item).select("query_id", "list").collect()  # CALIBRATED * n rows
    asked = {r["query_id"]: r["vector"] for r in some.collect()}
    if not lists:
        return 1
    filled = np.zeros(len(index.centroids), bool)
    filled[[r["list"] for r in index.segments("lists").select("list").distinct().collect()]] = True
    near = np.where(filled, _unit(np.array(list(asked.values()), float)) @ index.centroids.T, -2)
    place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
    row = {q: k for k, q in enumerate(asked)}
    opened = np.sort([place[row[r["query_id"]], r["list"]] for r in lists])
    return int(opened[min(len(opened) - 1, math.ceil(recall * len(opened)) - 1)]) + 1
