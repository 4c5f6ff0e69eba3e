"""What the queries of this subpackage set on a session that leaves it open; operators themselves set nothing."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of a batch that goes to a Python worker: documents are long, and Spark's ten thousand of them fill a worker.
BATCH_ROWS = 500
_NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let rows go to Python workers ``BATCH_ROWS`` at a time, unless the session has chosen another number than Spark's own."""
    if spark.conf.get(_NAME) == "10000":
        spark.conf.set(_NAME, str(BATCH_ROWS))
