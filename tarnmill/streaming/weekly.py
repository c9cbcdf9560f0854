"""The weekly ledger of deliveries as keyed state: which channels have confirmed, until all have."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Weekly(StatefulProcessor):
    """Holds a key's newest week and the channels that confirmed in it. What a row does is the same in any order and when it is repeated."""

    def __init__(self, channels: list[str]):
        self.channels = channels

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.week = handle.getValueState("week", "week string")
        self.confirmed = handle.getMapState("confirmed", "channel string", "ok boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        week = self.week.get()[0] if self.week.exists() else None
        for frame in rows:
            newest = frame["week"].dropna().max() if frame["week"].notna().any() else None
            if newest is not None and (week is None or newest > week):
                week = newest
                self.week.update((week,))
                self.confirmed.clear()
            for channel in frame.loc[(frame["week"] == week) & frame["ok"].eq(True), "channel"].dropna().unique():
                self.confirmed.updateValue((channel,), (True,))
        missing = [c for c in self.channels if not self.confirmed.containsKey((c,))]
        yield pd.DataFrame({"key": [key[0]], "week": [week], "missing": [",".join(missing)]})

    def close(self) -> None:
        pass


def confirmations(stream: DataFrame, channels: list[str]) -> DataFrame:
    """``stream(key, week, channel, ok)`` -> ``key, week, missing`` of each key with new rows after every batch.

    ``missing`` names the channels that are still to be sent to in the key's newest week, in the given order and joined by
    commas; empty once all have confirmed. A failed attempt confirms nothing, so it is due again. Weeks before the newest are
    forgotten, and rows of them change nothing; nor do channels that aren't asked for, nulls, or a batch that is
    run again. Needs the RocksDB state store, which is set for the session where it names none.
    """
    spark = stream.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, ROCKS)
    rows = stream.selectExpr("cast(key as string) key", "week", "channel", "ok")
    return rows.groupBy("key").transformWithStateInPandas(_Weekly(channels), "key string, week string, missing string", "Update", "None")
