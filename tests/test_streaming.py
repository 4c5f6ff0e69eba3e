"""Streams end with what the same operators give over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.streaming import live
from tests.conftest import SMALL


def test_windows_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    live.to_parquet(live.windowed_counts(live.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.event_type): r.n for r in live.windowed_counts(events).collect()}
    assert got and all(want[k] == n for k, n in got.items())
    # Only windows that the watermark has not yet closed are missing.
    last = max(k[0] for k in want)
    assert all(k in got for k in want if (last - k[0]).total_seconds() > 7200)


def test_job_states_of_a_stream(spark, tmp_path):
    rows = [(1, 1, 1, "queued"), (1, 2, 2, "succeeded"), (1, 3, 3, "failed"), (2, 4, 1, "queued"), (2, 5, 2, "failed"), (2, 6, 3, "queued")]
    schema = "job_id long, event_id long, t long, status string"
    jobs = spark.createDataFrame(rows, schema).select("job_id", "event_id", F.timestamp_seconds("t").alias("ts"), "status")
    jobs.write.parquet(str(tmp_path / "in"))
    stream = live.event_stream(spark, str(tmp_path / "in"), "job_id long, event_id long, ts timestamp, status string")
    query = live.job_states(stream).writeStream.format("memory").queryName("job_updates").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.job_id, r.status, r.n_events) for r in live.latest(spark.table("job_updates")).collect()} == {(1, "succeeded", 2), (2, "queued", 3)}


def test_states_of_old_jobs_go(spark, tmp_path):
    """A job's record is dropped once the watermark is far past its last event; a later event begins anew."""
    schema = "job_id long, event_id long, ts timestamp, status string"
    day = 86_400

    def arrives(rows):
        df = spark.createDataFrame(rows, "job_id long, event_id long, t long, status string")
        df.select("job_id", "event_id", F.timestamp_seconds("t").alias("ts"), "status").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.job_states(live.event_stream(spark, str(tmp_path / "in"), schema), keep_hours=24)
        query = stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]

    assert arrives([(1, 1, day, "queued"), (2, 2, day, "queued")]) == 2
    assert arrives([(3, 3, 5 * day, "queued")]) <= 3
    assert arrives([(4, 4, 5 * day + 10, "queued")]) == 2  # jobs 1 and 2 have gone
