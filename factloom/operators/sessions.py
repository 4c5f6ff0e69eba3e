"""Sessions, their messages and what is remembered of them, as keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import default_title

KEPT_TURNS, PRUNE_OVER, PRUNE_KEEP, CONTEXT_MESSAGES, CONTEXT_CHARS = 8, 24, 8, 8, 1200


def list_recent(sessions: DataFrame, messages: DataFrame, limit: int = 20) -> DataFrame:
    """The latest top-level sessions that have messages, with how many; counted before they are joined."""
    counts = messages.groupBy("session_id").agg(F.count("*").alias("n_messages"))
    return sessions.filter("parent_id is null").join(counts, "session_id").orderBy(F.desc("updated_at"), "session_id").limit(limit)


def titled(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their own title, else one from the first thing a user said."""
    said = messages.filter("role = 'user'").groupBy("session_id").agg(F.min_by("text", "turn").alias("said"))
    return sessions.join(said, "session_id", "left").withColumn("title", F.coalesce("title", default_title(F.col("said")))).drop("said")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and of ``old`` those whose key ``new`` lacks."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def stale(sessions: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return sessions.filter(F.col("updated_at") < now - F.expr(f"INTERVAL {days} DAYS"))


def last_turns(messages: DataFrame, keep: int = KEPT_TURNS) -> DataFrame:
    """The latest messages of each session, whole sessions never sorted beyond what is kept."""
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    return messages.withColumn("back", turn).filter(F.col("back") <= keep)


def pruned(messages: DataFrame, over: int = PRUNE_OVER, keep: int = PRUNE_KEEP) -> DataFrame:
    """Messages that stay, and for each session how many a summary stands for."""
    n = F.count("*").over(Window.partitionBy("session_id"))
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    marked = messages.withColumn("n", n).withColumn("stays", (F.col("n") <= over) | (back <= keep))
    return marked.groupBy("session_id").agg(F.count_if("stays").alias("n_kept"), F.count_if(~F.col("stays")).alias("n_summarised"))


def context_window(messages: DataFrame, keep: int = CONTEXT_MESSAGES, chars: int = CONTEXT_CHARS) -> DataFrame:
    """What a model would be shown of each session: the last messages in order, each cut."""
    cut = last_turns(messages, keep).select("session_id", F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.left("text", F.lit(chars))).alias("line")).alias("m"))
    return cut.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["line"]), "\n").alias("context"))


def age_bucket(at: Column, now: Column) -> Column:
    days = F.datediff(now, at)
    return F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days < 7, "Previous 7 days").when(days < 30, "Previous 30 days").otherwise("Older")


def status(messages: DataFrame) -> DataFrame:
    """For each session its answered turns and whether any compares."""
    compares = F.col("role").eqNullSafe("user") & F.lower("text").rlike(r"\b(?:compare|versus|vs|than|between)\b")
    return messages.groupBy("session_id").agg(F.count_if(F.col("role") == "assistant").alias("n_answers"), F.bool_or(F.coalesce(compares, F.lit(False))).alias("any_comparison"))
