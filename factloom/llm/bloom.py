"""A Bloom filter of bounded size, to keep rows that no join needs out of a shuffle."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.staging import staged

#: Slots for each member and their bounds: 16 MB at most, however many members there are.
BITS_PER_MEMBER, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
HASHES, BUCKET = 4, 32768


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, upper and lower case being alike."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _slots(value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), value), F.lit(bits)) for k in range(HASHES)]


def member_test(members: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that holds for all values of a written table's column, and for few others."""
    count, bits = members.count(), LEAST_BITS
    while bits < min(MOST_BITS, count * BITS_PER_MEMBER):
        bits *= 2
    slots = members.select(F.explode(F.array(*_slots(F.col(column), bits))).alias("slot"))
    rows = slots.groupBy(F.floor(F.col("slot") / BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % BUCKET).alias("bits")).collect()
    table = np.zeros((bits // BUCKET, BUCKET // 8), np.uint8)
    for row in rows:
        table[row["bucket"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    sent = members.sparkSession.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        if not hasattr(sent, "unpacked"):
            sent.unpacked = np.frombuffer(zlib.decompress(sent.value), np.uint8)
        at = [s.to_numpy() for s in (a, b, c, d)]
        return pd.Series(reduce(np.logical_and, ((sent.unpacked[s >> 3] >> (s & 7) & 1).astype(bool) for s in at)))

    return lambda value: test(*_slots(value, bits))


def rows_that_stay(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id stays by a written table ``doc_id, stays``, without shuffling texts that go.

    A filter of the ids that go lets all other rows pass straight through; of
    those that it takes in, only the few are shuffled whose id stays after all.
    """
    named = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit(""))
    told = verdicts.select(named(F.col("doc_id")).alias("named"), "stays")
    some_go = member_test(staged(told.filter("not stays").select("named"), "go"), "named")
    stay = staged(told.filter("stays").filter(some_go(F.col("named"))).select("named").distinct(), "stay")
    some_stay = member_test(stay, "named")
    (key,) = free_names(docs, "named")
    keyed = docs.withColumn(key, named(F.col("doc_id")))
    straight = keyed.filter(~some_go(F.col(key))).select(docs.columns)
    again = keyed.filter(some_go(F.col(key)) & some_stay(F.col(key))).join(stay.withColumnRenamed("named", key), key, "left_semi")
    return straight.unionByName(again.select(docs.columns))
