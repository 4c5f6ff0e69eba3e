"""Calls that lie inside of calls: depth and parent of each, from the events that open and close them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, StructField, StructType

from factloom.plans.staging import staged

#: Events that a task holds at once.
SPAN = 1 << 18
#: Rows of a part: calls, and what other parts must know of the runs at its edges.
CALL, SUM, OFFER, ASK, CLOSE = range(5)
#: Where a row's run lies in its part: inside, at its begin, or at its end alone.
INSIDE, LEAD, TRAIL = range(3)

_COLUMNS = ["kind", "side", "part", "run_id", "call_id", "name", "level", "parent_id", "opened_at", "closed_at"]


def trace_id(run_id: Column) -> Column:
    """The id of a run's trace, which the run's own id tells."""
    return F.left(F.sha2(run_id, 256), F.lit(32))


def _fresh(run: pa.Array) -> np.ndarray:
    """Where a run begins; nulls are one run."""
    out = np.zeros(len(run), bool)
    a, b = run.slice(1), run.slice(0, len(run) - 1)
    out[1:] = pc.coalesce(pc.not_equal(a, b), pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return out


def _parents(group: np.ndarray, level: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each open the place of the last one before it in its run that opened one level up, and whether there is one."""
    key = group * (np.ptp(level) + 2) + level - level.min() + 1 if len(at) else at
    offers = np.sort(key * n + at)
    place = np.searchsorted(offers, (key - 1) * n + at) - 1
    near = offers[np.maximum(place, 0)]
    return near % n, (place >= 0) & (near // n == key - 1)


def _part(events: pa.RecordBatch, number: int) -> Iterator[pa.RecordBatch]:
    """The calls of neighbouring events, levels of the first run less what is open before, and the edges of the part."""
    run, call, ts = (events.column(c) for c in ("run_id", "call_id", "ts"))
    n = len(run)
    opens = events.column("opens").to_numpy(zero_copy_only=False)
    delta = np.where(opens, 1, -1)
    fresh = _fresh(run)
    group = np.cumsum(fresh)
    last = group[-1]
    total = np.cumsum(delta)
    starts = np.append(0, np.flatnonzero(fresh))
    after = total - (total - delta)[starts][group]
    at = np.flatnonzero(opens)
    level, owner = after[at], group[at]
    parent, near = _parents(owner, level, at, n)
    near &= (owner == 0) | (level > 1)
    where = np.where(owner == 0, LEAD, np.where(owner == last, TRAIL, INSIDE))
    # A close meets its call by id; the least time counts.
    names = call.dictionary_encode()
    codes = np.asarray(names.indices.fill_null(-1))
    wide = len(names.dictionary) + 1
    ids = np.where(codes < 0, -1, group * wide + codes)
    shut = np.flatnonzero(~opens & (codes >= 0))
    least = pa.table({"id": ids[shut], "ts": ts.take(pa.array(shut))}).group_by("id", use_threads=False).aggregate([("ts", "min")]).sort_by("id").combine_chunks()
    closed, times = least["id"].to_numpy(), least["ts_min"]
    place = np.minimum(np.searchsorted(closed, ids[at]), max(len(closed) - 1, 0))
    known = closed[place] == ids[at] if len(closed) else np.zeros(len(at), bool)
    kinds = [pa.int8(), pa.int8(), pa.int64(), run.type, call.type, events.schema.field("name").type, pa.int32(), call.type, ts.type, ts.type]

    def batch(*columns: object) -> pa.RecordBatch:
        arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c, k) if isinstance(c, (list, np.ndarray)) else c for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(arrays, kinds, strict=True)], _COLUMNS)

    some, chosen = len(at), pa.array(at)
    yield batch(np.full(some, CALL), where, np.full(some, number), run.take(chosen), call.take(chosen), events.column("name").take(chosen), level, call.take(pa.array(parent, mask=~near)), ts.take(chosen), times.take(pa.array(place, mask=~known)) if len(closed) else pa.nulls(some, ts.type))

    edges = []
    for side, begin, end in ((LEAD, 0, starts[1] if last else n), (TRAIL, starts[-1], n))[: 1 + (last > 0)]:
        known_run, own = run[int(begin)].as_py(), after[begin:end]
        row = lambda kind, level=None, call=None, time=None: (kind, side, number, known_run, call, None, level, None, None, time)  # noqa: B023, E731
        edges.append(row(SUM, int(own[-1])))
        # What is still open at the end of the part.
        left = np.flatnonzero(opens[begin:end] & (np.minimum.accumulate(own[::-1])[::-1] >= own))
        edges += [row(OFFER, int(own[k]), call[int(begin + k)].as_py()) for k in left]
        if side == LEAD:
            edges += [row(ASK, int(k)) for k in np.unique(level[(owner == 0) & ~near] - 1)]
        far = np.flatnonzero(closed // wide == group[begin])
        far = far[~np.isin(closed[far], ids[at[owner == group[begin]]])]
        edges += [row(CLOSE, None, names.dictionary[int(closed[k] % wide)].as_py(), times[int(k)].as_py()) for k in far]
    yield batch(*map(list, zip(*edges, strict=True)))


def _parts(events: DataFrame) -> DataFrame:
    """Events in the order of runs and numbers, dealt by ranges of it and read once: rows of calls and of edges."""
    size, types = SPAN, {f.name: f.dataType for f in events.schema}
    kinds = [ByteType(), ByteType(), LongType(), types["run_id"], types["call_id"], types["name"], IntegerType(), types["call_id"], types["ts"], types["ts"]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0
        whole = lambda: pa.concat_batches(held)
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, size - rows))
                rows += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if rows == size:
                    yield from _part(whole(), number)
                    number, held, rows = number + 1, [], 0
        if held:
            yield from _part(whole(), number)

    opens = F.coalesce(F.col("what") == "open", F.lit(False))
    lean = events.select("run_id", "seq", "call_id", F.when(opens, F.col("name")).alias("name"), opens.alias("opens"), "ts")
    dealt = lean.repartitionByRange("run_id", "seq").sortWithinPartitions("run_id", "seq").drop("seq")
    return dealt.mapInArrow(read, StructType([StructField(c, k) for c, k in zip(_COLUMNS, kinds, strict=True)]))


def nested(events: DataFrame) -> DataFrame:
    """``run_id, trace_id, call_id, name, depth, parent_id, opened_at, closed_at``: one row for each call.

    ``events``: ``run_id, seq, call_id, name, what`` (open or close) and ``ts``;
    ``seq`` numbers a run's events.  The calls that are open before an event are
    the opens less the closes before it, and a call's parent is the last one
    that opened one level up.  Events are sorted once over all runs and cut into
    parts of ``SPAN``, so no task holds a whole run.  Runs inside of a part are
    done there.  Of the two at its edges, which may go on in other parts, it
    tells the sum, what is left open, the levels where parents are missing and
    the closes without a call, and these are carried from part to part.  A call
    that never closes has a null ``closed_at``.
    """
    rows = staged(_parts(events), "calls")
    edges = staged(rows.filter(F.col("kind") != CALL), "edges")
    upto = lambda *by: Window.partitionBy(*by).orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    base = edges.filter(F.col("kind") == SUM).select("part", "side", F.coalesce(F.sum("level").over(upto("run_id")), F.lit(0)).alias("base"))
    asked = edges.filter(F.col("kind").isin(OFFER, ASK)).join(base, ["part", "side"]).withColumn("depth", F.col("level") + F.col("base"))
    asked = asked.select("kind", "part", "side", (F.col("level") + 1).alias("level"), F.last("call_id", ignorenulls=True).over(upto("run_id", "depth")).alias("carried"))
    carried = asked.filter(F.col("kind") == ASK).drop("kind")
    closes = edges.filter(F.col("kind") == CLOSE).groupBy(F.col("run_id").alias("of"), F.col("call_id").alias("shut")).agg(F.min("closed_at").alias("later"))
    calls = rows.filter(F.col("kind") == CALL)
    split = calls.filter(F.col("side") != INSIDE).join(base, ["part", "side"]).join(carried, ["part", "side", "level"], "left")
    split = split.join(closes, F.col("run_id").eqNullSafe(F.col("of")) & (F.col("call_id") == F.col("shut")), "left")
    depth = F.col("level") + F.col("base")
    split = split.select("run_id", "call_id", "name", depth.cast("int").alias("depth"), F.when(depth > 1, F.coalesce("parent_id", "carried")).alias("parent_id"), "opened_at", F.least("closed_at", "later").alias("closed_at"))
    inside = calls.filter(F.col("side") == INSIDE).select("run_id", "call_id", "name", F.col("level").alias("depth"), "parent_id", "opened_at", "closed_at")
    return inside.unionByName(split).select("run_id", trace_id(F.col("run_id").cast("string")).alias("trace_id"), "call_id", "name", "depth", "parent_id", "opened_at", "closed_at")
