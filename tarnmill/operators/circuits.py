"""Tables of circuits by composite key: which sources may run, what a run made of them, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def composite(source: Column, domain: Column) -> Column:
    """``source:domain``, or the source alone."""
    return F.concat_ws(":", source, F.nullif(domain, F.lit("")))


def base(key: Column) -> Column:
    """The source of a composite key."""
    return F.split_part(key, F.lit(":"), F.lit(1))


def available(keys: DataFrame, circuits: DataFrame, now: Column) -> DataFrame:
    """``keys(key, ...)`` without those whose circuit ``(key, open_until)`` is open now."""
    return keys.join(circuits.where(F.col("open_until") > now).select("key"), "key", "left_anti")


def first_available(keys: DataFrame, circuits: DataFrame, now: Column) -> DataFrame:
    """``keys(key, seq)`` -> for each source its first key, in the order of the registry, whose circuit isn't open."""
    free = available(keys, circuits, now).select(base(F.col("key")).alias("source"), "seq", "key")
    return free.groupBy("source").agg(F.min(F.struct("seq", "key"))["key"].alias("key"))


def pruned(circuits: DataFrame, known: DataFrame) -> DataFrame:
    """The circuits of known sources ``(source)``; composite keys go by their source."""
    return circuits.join(known.select(F.col("source").alias("_source")), base(F.col("key")) == F.col("_source"), "left_semi")


def summary(circuits: DataFrame, now: Column) -> DataFrame:
    """One row: how many circuits there are and are open, and all failures and successes."""
    return circuits.agg(F.count("*").alias("circuits"), F.count_if(F.col("open_until") > now).alias("open"), F.coalesce(F.sum("total_fails"), F.lit(0)).alias("fails"), F.coalesce(F.sum("total_ok"), F.lit(0)).alias("ok"))


def reset(circuits: DataFrame) -> DataFrame:
    """All circuits closed, with their totals as they are."""
    return circuits.withColumn("open_until", F.lit(None).cast(circuits.schema["open_until"].dataType)).withColumn("consecutive_fails", F.lit(0).cast("long"))


def run_verdicts(attempts: DataFrame) -> DataFrame:
    """``attempts(source, seq, outcome)`` of one run -> ``source, verdict``: ok if any attempt was, else the outcome of the last. A null outcome is a failure."""
    outcome = F.coalesce("outcome", F.lit("failed"))
    return attempts.groupBy("source").agg(F.when(F.bool_or(outcome == "ok"), "ok").otherwise(F.max_by(outcome, "seq")).alias("verdict"))
