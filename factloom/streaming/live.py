"""Streams of trace events and job states, by the same operators as over tables.

The reference has no streaming engine; its trace log and job states are the
only data that arrive in order of time.  These are offered beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.events import windowed

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
STATE = "job_id long, status string, n_events int"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """Events from Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and type; rows later than the watermark are dropped with the state."""
    return windowed(stream, width, late).select("w.start", "event_type", "n", "total")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, keep_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    status, n = state.get if state.exists else ("", 0)
    for batch in batches:
        for row in batch.sort_values(["ts", "event_id"]).itertuples():
            if status != "succeeded":  # nothing follows success
                status, n = row.status, n + 1
    state.update((status, n))
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(row.ts.timestamp() * 1000)) + keep_ms)
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "n_events": [n]})


def job_states(stream: DataFrame, late: str = "1 hour", keep_hours: float = 168) -> DataFrame:
    """The state of each job after each batch of its events ``job_id, event_id, ts, status``; one small record a job is kept.

    Events later than ``late`` are dropped.  A job's record goes when the
    watermark is ``keep_hours`` past its last event, so the state has the jobs
    of that time only; an event that comes later still begins a new record.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _advance(key, batches, state, int(keep_hours * 3_600_000))

    return stream.withWatermark("ts", late).groupBy("job_id").applyInPandasWithState(advance, STATE, "status string, n int", "update", GroupStateTimeout.EventTimeTimeout)


def to_parquet(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to Parquet, once for all that has arrived."""
    return result.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(updates: DataFrame) -> DataFrame:
    """Of a job's updates the last one."""
    return updates.groupBy("job_id").agg(F.max_by("status", "n_events").alias("status"), F.max("n_events").alias("n_events"))
