import tempfile

from pyspark.sql import functions as F

from tarnmill.operators import ledger
from tarnmill.streaming.breaker import breaker_stream

SF = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_breaker_stream_equals_the_fold(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        batch = spark.read.parquet(f"{SF}/events.parquet")
        events = lambda rows: rows.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_id").cast("double").alias("at"), (F.col("event_type") != "click").alias("ok"))
        stream = events(spark.readStream.schema(batch.schema).parquet(f"{SF}/events.parquet*"))
        root = tempfile.mkdtemp()
        q = breaker_stream(stream).writeStream.format("memory").queryName("breaker_now").outputMode("update").option("checkpointLocation", root).trigger(availableNow=True).start()
        q.awaitTermination(90)
        q.stop()
        got = {(int(r.key), r.consecutive_fails, r.total_fails, r.total_ok) for r in spark.table("breaker_now").collect()}
        want = {(r.key, r.consecutive_fails, r.total_fails, r.total_ok) for r in ledger.breaker(events(batch)).collect()}
        assert got == want and want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
