"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Links ``(a, b)`` of any orderable type -> ``(node, root)``: the least node of each component.

    Large-star hangs a node's greater neighbours on its least one, small-star the lesser ones; both
    only aggregate and join on the node, and a node's degree shrinks by itself, so that no step holds
    a component in one task. Every step is a written table. Self-links and repeats do no harm; nodes
    without links don't appear; an empty table gives an empty result.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.save(edges, f"{name}-0")
    step = 0
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{name}-{step}-l")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        small = scratch.save(small, f"{name}-{step + 1}")
        same = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()
        if same == small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect():
            break
        scratch.drop(f"{name}-{step}", f"{name}-{step}-l")
        edges, step = small, step + 1
    scratch.drop(f"{name}-{step}", f"{name}-{step}-l")
    return small.select(F.col("u").alias("node"), F.col("v").alias("root")).union(small.select(F.col("v"), F.col("v")).distinct())
