"""Gate chains: every row gets the first gate that it fails, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_failure(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate whose predicate isn't true (null counts as not true); null if all pass."""
    return F.coalesce(*(F.when(~F.coalesce(passes, F.lit(False)), F.lit(name)) for name, passes in gates))


def apply_gates(rows: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``gate`` and ``accepted``."""
    return rows.withColumn("gate", first_failure(gates)).withColumn("accepted", F.col("gate").isNull())


def cap_per_source(rows: DataFrame, n: int) -> DataFrame:
    """The first n accepted rows of each source."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("seq"))).where(F.col("_n") <= n).drop("_n")


def classify_location(location: Column, title: Column) -> Column:
    """remote, hybrid, onsite or unknown."""
    low = F.lower(F.concat_ws(" ", location, title))
    return (
        F.when(low.contains("hybrid"), "hybrid")
        .when(low.rlike(r"\b(?:remote|worldwide|anywhere)\b"), "remote")
        .when(F.trim(F.coalesce(location, F.lit(""))) == "", "unknown")
        .otherwise("onsite")
    )


def score_profile(title: Column, rejects: list[str], tiers: list[tuple[str, int]], bonus: Column, fallback: int = 0) -> Column:
    """A decision list: a reject scores 0, else the first tier that the title matches, with a bonus up to 100."""
    low = F.lower(title)
    score = F.lit(fallback)
    for pattern, points in reversed(tiers):
        score = F.when(low.rlike(pattern), F.least(F.lit(points) + bonus, F.lit(100))).otherwise(score)
    for pattern in rejects:
        score = F.when(low.rlike(pattern), 0).otherwise(score)
    return score
