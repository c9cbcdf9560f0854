"""Weekly digests: counts with ties by first appearance, and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(rows: DataFrame, columns: list[str], seq: str = "seq") -> DataFrame:
    """``dimension, value, n, first_seq``: all columns counted in one scan by grouping sets."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(seq, pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"))


def most_common(rows: DataFrame, column: str, n: int, seq: str = "seq") -> DataFrame:
    """The n commonest values; ties by first appearance."""
    return rows.groupBy(column).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq")).orderBy(F.desc("n"), "first_seq").limit(n)
