"""Traces, calls and jobs: event rows, their order, and the state they lead to."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.staging import staged

# Fixed value: parts of names that must not be traced; longest value that may be.
HIDDEN = ("credential", "token", "embedding", "prompt", "chain_of_thought", "api_key")
VALUE_CHARS = 2000
TERMINAL = ("succeeded", "failed")


def safe_details(details: Column) -> Column:
    """A trace's details without secrets and without what is too long."""
    hidden = lambda k: F.exists(F.array(*map(F.lit, HIDDEN)), lambda h: F.contains(F.lower(k), h))
    return F.map_filter(details, lambda k, v: ~hidden(k) & (F.length(F.coalesce(v, F.lit(""))) <= VALUE_CHARS))


def durations(events: DataFrame, key: str = "run_id") -> DataFrame:
    """Seconds from a run's first event to its last."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.groupBy(key).agg(F.count("*").alias("n_events"), F.round((F.max(at) - F.min(at)) / 1e6, 3).alias("seconds"))


def values_at(values: DataFrame, group: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact values of a group in sorted order, at places from 0 that are told by how many there are: ``group, n`` and a column for each.

    Distinct values are counted and dealt by ranges of equal numbers of them,
    whatever their distribution, so a group is as many shares as its size asks
    for.  Only shares that hold a place are then sorted, each by itself.
    """
    same = lambda a, b: reduce(and_, [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in group])
    counted = values.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("value")).agg(F.count("*").alias("m"))
    dealt = staged(counted.repartitionByRange(*group, "value").withColumn("share", F.spark_partition_id()), "values")
    shares = dealt.groupBy(*group, "share").agg(F.sum("m").alias("k"))
    upto, all_ = F.sum("k").over(Window.partitionBy(*group).orderBy("share")), F.sum("k").over(Window.partitionBy(*group))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("place")) for name, place in places.items()]))
    held = shares.withColumn("before", upto - F.col("k")).withColumn("n", all_).select(*group, "share", "k", "before", "n", wanted.alias("w")).filter("w.place >= before and w.place < before + k")
    met = dealt.alias("p").join(held.select(*group, "share", "before", "n", "w.*").alias("s"), same("p", "s") & (F.col("p.share") == F.col("s.share")))
    met = met.select(*[F.col(f"p.{g}").alias(g) for g in group], "p.value", "s.n", "p.m", "s.before", "s.name", "s.place")
    reached = F.col("before") + F.sum("m").over(Window.partitionBy(*group, "name").orderBy("value"))
    hits = met.withColumn("reached", reached).filter("reached > place")
    return hits.groupBy(*group).agg(F.first("n").alias("n"), *[F.min(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in places])


def nearest_rank(values: DataFrame, group: list[str], value: str, share: float = 0.95) -> DataFrame:
    """The sorted value at index ``max(0, round(share * n) - 1)``, halves rounded to even; an exact value of the data."""
    return values_at(values, group, value, {"p": lambda n: F.greatest(F.lit(0), F.bround(n * share, 0).cast("long") - 1)}).select(*group, "p", "n")


def median(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """``group, n, median``: the middle value, or the mean of the two in the middle."""
    middle = values_at(values, group, value, {"a": lambda n: F.floor((n - 1) / 2), "b": lambda n: F.floor(n / 2)})
    return middle.select(*group, "n", ((F.col("a") + F.col("b")) / 2).alias("median"))


def latest_state(jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """The state of each job after its events in order: nothing follows success; after failure only a retry, which queues it."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    ended = F.max((F.col("status") == "succeeded").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    live = jobs.withColumn("done", F.coalesce(ended, F.lit(0))).filter("done = 0")
    return live.groupBy(key).agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count_if(F.col("status") == "queued").alias("n_queued"), F.max("ts").alias("ts"))


def retry_delay(attempt: Column) -> Column:
    """Seconds before a retry: 15 doubled each time, 300 at most."""
    return F.least(F.lit(300), (15 * F.pow(F.lit(2), attempt)).cast("int"))


def tool_budget(calls: DataFrame, limit: int, key: str = "run_id") -> DataFrame:
    """Calls of a run in order; those beyond the limit are flagged, and cost nothing."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id"))
    out = calls.withColumn("turn", turn)
    return out.withColumn("limit_exceeded", F.col("turn") > limit)


def run_status(events: DataFrame, endings: dict[str, str], key: str = "run_id") -> DataFrame:
    """How a run ended, by its last event with an ending; ``endings`` tells which events end a run, and how."""
    table = F.create_map(*[F.lit(x) for kv in endings.items() for x in kv])
    kind = table[F.col("event_type")]
    return events.withColumn("kind", kind).groupBy(key).agg(F.coalesce(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("ts", "event_id"))), F.lit("running")).alias("status"))


def refusal_reason(refused: Column, invalid: Column, artifact_failed: Column) -> Column:
    """Why a completed run refused: its citations, its artifact, or too little evidence."""
    return F.when(refused & invalid, "citation_validation_failed").when(refused & artifact_failed, "artifact_generation_failed").when(refused, "insufficient_evidence")


def allowed_details(details: Column, names: tuple[str, ...]) -> Column:
    """Details under allowed names alone, and of those what is safe."""
    return F.map_filter(safe_details(details), lambda k, v: k.isin(*names))


def provider_error(message: Column) -> Column:
    """The class of a provider's failure, from its message."""
    low = F.lower(message)
    return F.when(low.rlike("429|quota|rate limit|resource_exhausted"), "PROVIDER_RATE_LIMITED").when(low.rlike("timeout|timed out|deadline"), "PROVIDER_TIMEOUT").when(low.rlike("401|403|api key|permission"), "PROVIDER_AUTH").when(low.rlike("500|502|503|504|unavailable|overloaded"), "PROVIDER_UNAVAILABLE").otherwise("PROVIDER_ERROR")


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Beyond the reference: counts by tumbling window and type; a watermark bounds the state of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Beyond the reference: a user's bursts of events, parted by gaps."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
