"""State folded from events: circuit breakers, topic queues, merged histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def breaker(events: DataFrame, threshold: int = 3) -> DataFrame:
    """``events(key, seq, ok)`` -> the breaker of each key: failures in a row, totals, and whether it is open.

    Failures since the last success need no fold in order: they are the failures after it.
    """
    last = F.max(F.when(F.col("ok"), F.col("seq")))
    totals = events.groupBy("key").agg(last.alias("last_ok"), F.count_if(~F.col("ok")).alias("total_fails"), F.count_if("ok").alias("total_ok"))
    since = events.join(totals.select("key", "last_ok"), "key").where(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("seq") > F.col("last_ok"))))
    row = since.groupBy("key").agg(F.count("*").alias("consecutive_fails"))
    out = totals.join(row, "key", "left").withColumn("consecutive_fails", F.coalesce("consecutive_fails", F.lit(0).cast("long")))
    return out.select("key", "consecutive_fails", "total_fails", "total_ok", (F.col("consecutive_fails") >= threshold).alias("open"))


def merge_histories(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows ``(key, fails, total, deadline)`` of both sides: totals added, fails the greater, deadline the later."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, F.col("o.key") == F.col("n.key"), "full_outer").select(
        F.coalesce("o.key", "n.key").alias("key"), F.greatest("o.fails", "n.fails").alias("fails"),
        (F.coalesce("o.total", F.lit(0)) + F.coalesce("n.total", F.lit(0))).alias("total"), F.greatest("o.deadline", "n.deadline").alias("deadline"),
    )


def next_topic(topics: DataFrame, days: DataFrame, attempts: int = 3) -> DataFrame:
    """The first topic by ``seq`` that isn't done, blocked, under way, or given up after its attempts."""
    taken = days.where(F.col("status").isin("done", "in_progress", "blocked") | (F.col("status") == "failed") & (F.col("attempts") >= attempts))
    return topics.join(taken.select("topic_id"), topics["id"] == taken["topic_id"], "left_anti").orderBy("seq").limit(1)
