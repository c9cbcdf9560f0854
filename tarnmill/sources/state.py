"""State tables and files: JSON with quarantine, daily partitions, merge-by-id sinks, plug-in sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SOURCES: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register(name: str):
    """Decorator: a source is a function of the session that returns rows."""

    def add(f):
        SOURCES[name] = f
        return f

    return add


def read_sources(spark: SparkSession, names: list[str]) -> DataFrame:
    """The union of the named sources; an unknown name is a ValueError."""
    missing = [n for n in names if n not in SOURCES]
    if missing or not names:
        raise ValueError(f"unknown sources: {missing}")
    frames = [SOURCES[n](spark) for n in names]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_json_quarantine(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the text of those that don't parse."""
    fields = schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " ")
    rows = spark.read.text(path)
    parsed = rows.select("value", F.from_json("value", f"{fields}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt"), parsed.where(bad).select(F.col("value").alias("text"))


def read_last_days(spark: SparkSession, path: str, today: str, days: int = 7) -> DataFrame:
    """Rows of a table partitioned by ``dt``, of the last days; older partitions aren't read."""
    return spark.read.parquet(path).where((F.col("dt") > F.date_sub(F.lit(today).cast("date"), days)) & (F.col("dt") <= F.lit(today).cast("date")))


def merge_into_day(spark: SparkSession, new: DataFrame, path: str, day: str, key: str = "id") -> None:
    """Adds rows with new keys to a day's partition; keys already there stay as they are."""
    target = f"{path}/dt={day}"
    try:
        old = spark.read.parquet(target)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new.dropDuplicates([key]).write.parquet(target)
        return
    new.join(old.select(key), key, "left_anti").dropDuplicates([key]).write.mode("append").parquet(target)


def append_rejects(rejects: DataFrame, path: str) -> None:
    rejects.select("source", F.substring("title", 1, 120).alias("title"), "gate").write.mode("append").json(path)
