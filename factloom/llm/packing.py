"""Operator 1: best-fit packing by minimum bin slack.

Documents become pieces of at most ``size`` tokens.  How many pieces there are
of each length is all that packing needs: for each bin, a subset-sum dynamic
program over the lengths still available (a bitset in which bit s stands for
the sum s) finds the fullest feasible combination beside the longest remaining
piece.  The combination is removed as often as the counts allow, which repeats
what the program would find again.  The histogram has ``size`` entries and the
plan a few thousand, for any corpus.  Pieces then find their bin and offset
from their rank among the pieces of the same length.

Rows: a null or empty text gives one piece with the end token alone.  Rows that
repeat a ``doc_id`` are packed each.  No rows: no pieces.  Columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import bpe
from factloom.plans.staging import staged

#: Tokens of a sequence.
SEQUENCE = 1024
#: The id that ends each document.
END = 2
#: Pieces that one bucket of the ranking holds, about.
BUCKET_ROWS = 20_000


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """The multiset of available lengths with the largest sum that ``room`` holds.

    ``reached[k]`` is the bitset of sums after the k-th item; long items come
    first, so ties go to few, long pieces.
    """
    mask, sums, items, reached = (1 << room + 1) - 1, 1, [], []
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, group = min(int(counts[length]), room // length), 1
        while left > 0:
            group = min(group, left)
            reached.append(sums)
            items.append((length, group))
            sums |= sums << length * group & mask
            left -= group
            group *= 2
        if sums >> room & 1:
            break
    total, taken = sums.bit_length() - 1, []
    for (length, group), before in zip(reversed(items), reversed(reached), strict=True):
        if not before >> total & 1:
            taken += [length] * group
            total -= length * group
    return taken


def patterns(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """Combinations of lengths and how often each is used, until no piece is left."""
    counts, size, out = counts.copy(), len(counts) - 1, []
    while (left := np.flatnonzero(counts)).size:
        longest = int(left[-1])
        counts[longest] -= 1
        taken = [longest, *fullest(counts, size - longest)]
        counts[longest] += 1
        lengths, uses = np.unique(taken, return_counts=True)
        times = int((counts[lengths] // uses).min())
        counts[lengths] -= uses * times
        out.append((times, taken))
    return out


def places(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The plan as ranges of ranks: a piece of some length with a rank in a range
    goes to bin ``bin + (rank - rank0) % times`` at ``offset + length * ((rank - rank0) // times)``."""
    rows, used, bins = [], np.zeros_like(counts), 0
    for times, taken in patterns(counts):
        offset = 0
        for length in dict.fromkeys(taken):
            n = taken.count(length)
            rows.append((length, int(used[length]), times, bins, offset))
            used[length] += n * times
            offset += n * length
        bins += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "rank0", "times", "bin", "offset"), table.T, strict=True))


def pieces(docs: DataFrame, size: int = SEQUENCE, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids, ids_crc32``; of a longer document the first piece may be shorter."""
    path = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path)
        for ids, texts in bpe.in_batches(batches):
            rows = []
            for i, tokens in zip(ids, encoder.encode(texts), strict=True):
                whole = np.append(tokens, np.uint32(end)).astype("<u4")
                first = (len(whole) - 1) % size + 1
                for k, start in enumerate([0, *range(first, len(whole), size)]):
                    part = whole[start : first if k == 0 else start + size]
                    rows.append((i, k, start, len(part), part.astype(np.int32), zlib.crc32(part.tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids", "ids_crc32"])

    return bpe.narrow(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long")


def placed(cut: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces.

    A length that many pieces share is ranked in buckets: a window ranks each
    bucket, and the buckets' counts, summed in order, give where each begins.
    """
    counts = np.zeros(size + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most ``size`` rows
        counts[row["length"]] = row["count"]
    total = int(counts.sum())
    plan = places(counts)
    buckets = max(64, total // BUCKET_ROWS)
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("bucket", "base")
    kept = cut.columns
    sent = cut.sparkSession.sparkContext.broadcast(plan)  # some thousand ranges, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        key = p["length"] << 44 | p["rank0"]
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            turn = rank - p["rank0"][at]
            times = p["times"][at]
            added = [pa.array(p["bin"][at] + turn % times), pa.array(p["offset"][at] + length * (turn // times))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *added], [*kept, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, size: int = SEQUENCE, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """Pack documents with their token ids: ``doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset``."""
    return placed(staged(pieces(docs, size, end, vocabulary), "pieces"), size)


def pack_digests(docs: DataFrame, size: int = SEQUENCE, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """As :func:`pack`, without the ids themselves."""
    return placed(staged(pieces(docs, size, end, vocabulary).drop("ids"), "pieces"), size)
