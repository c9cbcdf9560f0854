"""Structured Streaming forms of the keyed state: deduplication with a time to live, daily counts, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.sources.tables import new_path


def ttl_dedup(stream: DataFrame, key: str, ts: str, ttl: str = "30 days") -> DataFrame:
    """The first row of each key; its state goes when the watermark has passed the time to live."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, ts: str, by: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), by, "n")


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Runs of a key's rows with less than the gap between them: ``key, start, end, n``; the end is the last row's time plus the gap."""
    window = F.session_window(ts, gap).alias("w")
    return stream.withWatermark(ts, late).groupBy(key, window).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs what is there to its end and rereads what it wrote: each batch is a folder of its own, so that one that is run again replaces itself."""
    spark = stream.sparkSession
    out = new_path(spark, name)
    last = {"batch": -1}

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/table/batch={batch}")
        last["batch"] = batch

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if last["batch"] < 0:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(f"{_ddl(stream)}, batch long").parquet(f"{out}/table")
    return (rows.where(F.col("batch") == last["batch"]) if mode == "complete" else rows).drop("batch")


def _ddl(stream: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
