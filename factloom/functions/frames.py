"""Helpers on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """Rows dealt by ``keys`` to tasks for all cores, ``least`` at least, where a step computes much from few bytes and Spark would merge small partitions."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, least), *keys)


@contextmanager
def met_as_dealt(spark: SparkSession) -> Iterator[None]:
    """While it holds, tables that were dealt alike by some of the columns of a join meet where they are, without another exchange."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def changed(base: DataFrame, key: str, changes: dict[str, dict[str, Column]]) -> DataFrame:
    """Copies of rows with some fields changed, in one pass; the key begins with the change's name."""
    copies = base.withColumn("__change", F.explode(F.array(*map(F.lit, changes))))

    def field(name: str) -> Column:
        out = F.concat(F.col("__change"), F.lit(":"), F.col(key)) if name == key else F.col(name)
        for change, fields in changes.items():
            if name in fields:
                out = F.when(F.col("__change") == change, fields[name]).otherwise(out)
        return out.alias(name)

    return copies.select(*map(field, base.columns))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once for each row.

    They go through a generator, so the optimizer does not copy them into the
    lambdas that use them, where they would be computed for each element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
