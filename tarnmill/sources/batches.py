"""Merge-by-id tables of finished batches: each batch is a folder that counts once Spark has committed it.

A batch adds rows with new keys. Spark's committer writes ``_SUCCESS`` last, and readers take only folders that
have it: what a lost task or a killed job left behind is never read. A batch that is finished isn't run again, so that
a repeated call changes nothing; one that broke off is written anew. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnmill.operators.dedup import first_wins

BOM = "﻿"


def finished(spark: SparkSession, path: str) -> list[str]:
    """The names of the finished batches of a table, in order; a table that isn't there has none."""
    jvm = spark.sparkContext._jvm
    marks = jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(s.getPath().getParent().getName().removeprefix("batch=") for s in found or [])


def read(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet") -> DataFrame:
    """All rows of the finished batches, without the batch's name."""
    names = finished(spark, path)
    if not names:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/batch={n}" for n in names]
    if kind == "csv":
        marked = StructType.fromJson(schema.jsonValue())
        marked.fields[0].name = marked.names[0] = BOM + schema.names[0]
        return spark.read.schema(marked).csv(folders, header=True, multiLine=True, escape='"', encoding="UTF-8", enforceSchema=True).toDF(*schema.names).na.fill("")
    return spark.read.schema(schema).format(kind).load(folders)


def merge(new: DataFrame, path: str, batch: str, key: str, order: list[str], kind: str = "parquet") -> DataFrame:
    """Adds the rows whose key no finished batch has, the first of each key by ``order``, and returns the whole table.

    The columns of ``order`` that start with ``_`` aren't stored. Rows without a key stay out. In a CSV table each file
    begins with a byte order mark, and null is the empty text.
    """
    spark = new.sparkSession
    kept = [c for c in new.columns if not c.startswith("_")]
    schema = new.select(*kept).schema
    if batch not in finished(spark, path):
        fresh = first_wins(new.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")), key, order)
        old = read(spark, path, schema, kind).select(key)
        rows = fresh.join(old, key, "left_anti").select(*kept)
        if kind == "csv":
            rows = rows.withColumnRenamed(kept[0], BOM + kept[0])
            rows.write.mode("overwrite").csv(f"{path}/batch={batch}", header=True, escape='"', encoding="UTF-8")
        else:
            rows.write.mode("overwrite").format(kind).save(f"{path}/batch={batch}")
    return read(spark, path, schema, kind)
