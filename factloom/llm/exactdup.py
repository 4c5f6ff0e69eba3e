"""Operator 5: exact deduplication with a two-pass Bloom filter.

Texts are equal when they are identical after each run of white space
``[\\x20\\x09-\\x0D]`` has become one space.  Pass one hashes every row into a
Bloom filter that remembers which slots were hit once and which more often.
Pass two keeps the rows all of whose slots were hit more often: only these may
repeat, and only these are shuffled, as 32-byte hashes.  All other rows pass
straight through.  The filter has ``BITS_PER_ROW`` slots for each row and at most
``MOST_BITS``, a documented parameter: a filter goes to every executor, two
bytes a row each, so with more than some twenty executors a larger one moves
more than shuffling 40 bytes a row does.  Beyond that size more rows are
shuffled needlessly (as hashes, never as texts), and the result stays exact.

Rows: a null text counts as empty.  Very long texts are hashed whole.  Of equal
texts the smallest ``doc_id`` stays, where a null id is the largest; of rows that
repeat text and id, one stays, each row being told from the others by a number.  No rows: no rows.  Further columns are kept by :func:`without_copies`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.bloom import free_names, member_test
from factloom.plans.staging import release, staged

#: Slots of the filter for each row, and their bounds.
BITS_PER_ROW, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
#: Slots that a row hits.
HASHES = 4
#: Slots of a block: blocks are merged apart from each other.
BLOCK = 1 << 20
#: Tasks that first merge a block, each for a share of the partitions.
SHARES = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[ \t-\r]+", " ")


def _slots(digest: np.ndarray, bits: int) -> np.ndarray:
    """The slots of rows, from the first 16 bytes of their SHA-256: a row of ``HASHES`` for each."""
    a, b = digest[:, 0], digest[:, 1] | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(bits) for k in range(HASHES)]).astype(np.int64)


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)


def _packed(once: np.ndarray, more: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(np.concatenate([once, more])).tobytes(), 1)


def _unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unpackbits(np.frombuffer(zlib.decompress(blob), np.uint8)).astype(bool)
    return both[:n], both[n : 2 * n]


def repeated_slots(hashed: DataFrame, rows: int) -> tuple[int, dict[int, bytes]]:
    """Pass one: the filter's size, and by block which slots more than one row hit."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, rows * BITS_PER_ROW):
        bits *= 2
    block = min(BLOCK, bits)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        more: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            slots = _slots(_digests(batch.column(0)), bits)
            # A slot counts a row once, also where two of the row's hashes meet.
            flat = np.sort(slots, 0)
            fresh = np.ones(flat.shape, bool)
            fresh[1:] = flat[1:] != flat[:-1]
            hit, n = np.unique(flat[fresh], return_counts=True)
            for k in np.unique(hit // block).tolist():
                if k not in once:
                    once[k], more[k] = np.zeros(block, bool), np.zeros(block, bool)
                inside = hit // block == k
                at = hit[inside] - k * block
                more[k][at] |= once[k][at] | (n[inside] > 1)
                once[k][at] = True
        share = TaskContext.get().partitionId() % SHARES
        for k in once:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([share], pa.int32()), pa.array([_packed(once[k], more[k])])], ["block", "share", "hits"])

    def merge(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in group:
            for k, blob in zip(batch.column("block").to_pylist(), batch.column("hits"), strict=True):
                a, b = _unpacked(blob.as_py(), block)
                if k in held:
                    once, more = held[k]
                    b |= more | (once & a)
                    a |= once
                held[k] = a, b
        for k, (a, b) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([_packed(a, b)])], ["block", "share", "hits"])

    kinds = "block int, share int, hits binary"
    parts = hashed.select("digest").mapInArrow(fill, kinds)
    parts = parts.repartition("block", "share").mapInArrow(merge, kinds)
    parts = parts.repartition("block").mapInArrow(merge, kinds)
    found = {}
    for row in parts.select("block", "hits").collect():  # at most MOST_BITS slots
        found[row["block"]] = zlib.compress(np.packbits(_unpacked(bytes(row["hits"]), block)[1]).tobytes(), 1)
    return bits, found


def maybe_repeated(hashed: DataFrame) -> Callable[[Column], Column]:
    """Both passes over a written table with a ``digest``: a test whether a digest may repeat there."""
    bits, blocks = repeated_slots(hashed, hashed.count())
    size = min(BLOCK, bits)
    whole = b"".join(zlib.decompress(blocks[k]) if k in blocks else bytes(size // 8) for k in range(bits // size))
    sent = hashed.sparkSession.sparkContext.broadcast(zlib.compress(whole, 1))

    @F.pandas_udf("boolean")
    def test(digests: pd.Series) -> pd.Series:
        if not len(digests):
            return pd.Series([], dtype=bool)
        table = _filter(sent)
        slots = _slots(np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4), bits)
        return pd.Series((table[slots >> 3] >> (7 - (slots & 7)) & 1).all(0))

    return test


def _filter(sent: Broadcast) -> np.ndarray:
    """The filter, unpacked once for each broadcast that a worker holds."""
    if not hasattr(sent, "unpacked"):
        sent.unpacked = np.frombuffer(zlib.decompress(sent.value), np.uint8)
    return sent.unpacked


def _grouped(some: DataFrame) -> DataFrame:
    """``digest, keep, group_size`` of the digests that more than one row has; ``keep`` is the id and number of the row that stays."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row_no")).alias("keep")
    return staged(some.groupBy("digest").agg(first, F.count("*").alias("group_size")).filter("group_size > 1"), "repeats")


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row for each of ``docs``."""
    text = normalised(F.col("text"))
    hashed = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")), "hashes")
    # Rows get numbers that stay, so that one of rows with equal id and text can be told from the others.
    marked = staged(hashed.select("doc_id", "digest", maybe_repeated(hashed)("digest").alias("maybe"), F.monotonically_increasing_id().alias("row_no")), "marked")
    hexed = F.lower(F.hex("digest")).alias("text_sha256")
    one = F.lit(1).cast("long")
    alone = marked.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), hexed)
    some = marked.filter("maybe").select("doc_id", "digest", "row_no")
    joined = some.join(_grouped(some), "digest", "left")
    single = F.col("group_size").isNull()
    judged = joined.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", one).alias("group_size"),
        (single | (F.col("row_no") == F.col("keep.row_no"))).alias("kept"),
        hexed,
    )
    return alone.unionByName(judged)


def _named(doc_id: Column) -> Column:
    """A ``doc_id`` as a string that is never null."""
    return F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    What stays is decided on the staged hashes.  Texts are then hashed once
    more: rows whose hash a filter of repeated ones doesn't know pass straight
    through.  Of the others only those go on whose hash and id are a row's that
    stays, by a second filter; they meet the list of these, and of rows that
    repeat id and text one is taken, which each task does before it shuffles.
    So copies are not shuffled, with ids or without.  The filters have a member
    for each repeated text, not for each copy; with more than some eight
    million of these they take in further rows, at last all, which are then
    shuffled once as a plain join would.  Columns of any name are kept; added
    ones get free names.
    """
    hashed = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")), "hashes")
    some = staged(hashed.filter(maybe_repeated(hashed)("digest")).select("doc_id", "digest", F.lit(0).alias("row_no")), "maybe")
    repeats = _grouped(some)
    kept = staged(repeats.select("digest", _named(F.col("keep.doc_id")).alias("named")), "kept")
    repeated = member_test(kept, "digest")
    # Rows that the filter mistakes for repeated ones stay too.
    mistaken = hashed.filter(repeated(F.col("digest"))).join(kept, "digest", "left_anti").select("digest", _named(F.col("doc_id")).alias("named"))
    stay = staged(kept.unionByName(mistaken).distinct().withColumn("both", F.xxhash64("digest", "named")), "stay")
    stays = member_test(stay, "both")
    release(hashed, some, repeats, kept)
    digest, named = free_names(docs, "digest", "named")
    keyed = docs.withColumn(digest, F.unhex(F.sha2(normalised(F.col("text")), 256))).withColumn(named, _named(F.col("doc_id")))
    straight = keyed.filter(~repeated(F.col(digest))).select(docs.columns)
    again = keyed.filter(repeated(F.col(digest)) & stays(F.xxhash64(digest, named)))
    again = again.join(stay.select(F.col("digest").alias(digest), F.col("named").alias(named)), [digest, named], "left_semi").dropDuplicates([digest, named])
    return straight.unionByName(again.select(docs.columns))
