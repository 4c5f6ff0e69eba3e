"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only where the setting is absent on a local master, as in single-machine
    tests, a temporary folder is chosen and set as Spark's checkpoint folder; a
    cluster without the setting is an error, as its executors share no other.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        current = context._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
            current = context._jsc.sc().getCheckpointDir()
        folder = current.get()
    return folder.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table.

    A lost executor then costs a re-read, not a recomputation, and values that
    depend on row order are fixed.  The files go when the driver's JVM ends, or
    earlier with :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(table._staged_path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
