"""The circuit breaker as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STATE = "fails long, total_fails long, total_ok long, open_until double"
_OUT = "key string, consecutive_fails long, total_fails long, total_ok long, open_until double, skipped long"


class _Fold:
    """One key's circuit: what an attempt does to it."""

    def __init__(self, threshold: int, reset_s: float, gated: bool, fails: int = 0, total_fails: int = 0, total_ok: int = 0, until: float = 0.0):
        self.threshold, self.reset_s, self.gated = threshold, reset_s, gated
        self.fails, self.total_fails, self.total_ok, self.until, self.skipped = fails, total_fails, total_ok, until, 0

    def step(self, at: float, ok: bool) -> None:
        if self.gated and at < self.until:
            self.skipped += 1
        elif ok:
            self.fails, self.total_ok, self.until = 0, self.total_ok + 1, 0.0
        else:
            self.fails, self.total_fails = self.fails + 1, self.total_fails + 1
            if self.fails >= self.threshold:
                self.until = at + self.reset_s

    def row(self) -> tuple:
        return int(self.fails), int(self.total_fails), int(self.total_ok), float(self.until), int(self.skipped)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])


class _Breaker(StatefulProcessor):
    """Failures in a row open the circuit for a while; a success closes it and begins anew.

    With ``gated`` set, attempts before the deadline are skipped. A deadline that has passed leaves
    the failures as they are, so that the next failure opens the circuit again at once.
    """

    def __init__(self, threshold: int, reset_s: float, gated: bool):
        self.threshold, self.reset_s, self.gated = threshold, reset_s, gated

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fold = _Fold(self.threshold, self.reset_s, self.gated, *(self.state.get() if self.state.exists() else ()))
        # A batch's rows come in parts of any order; of a row only time, number and outcome are held, 17 bytes.
        parts = [(f["at"].to_numpy(float), f["seq"].to_numpy(np.int64), f["ok"].to_numpy(bool)) for f in rows]
        times, numbers, outcomes = (np.concatenate(x) for x in zip(*parts, strict=True))
        for i in np.lexsort((numbers, times)):
            fold.step(times[i], outcomes[i])
        self.state.update(fold.row()[:4])
        yield _frame([(key[0], *fold.row())])

    def close(self) -> None:
        pass


def breaker_stream(events: DataFrame, threshold: int = 3, reset_s: float = 3600.0, gated: bool = False) -> DataFrame:
    """``events(key, seq, at, ok)``, ``at`` in seconds -> the state of each key after every batch.

    A key's rows of one batch are sorted in one task, so bound a batch (``maxFilesPerTrigger`` or the like) where one key may hold most rows.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = events.selectExpr("cast(key as string) key", "seq", "cast(at as double) at", "ok")
    return rows.groupBy("key").transformWithStateInPandas(_Breaker(threshold, reset_s, gated), _OUT, "Update", "None")


def breaker_table(events: DataFrame, threshold: int = 3, reset_s: float = 3600.0, gated: bool = True) -> DataFrame:
    """``breaker_stream`` over a whole table, with one row per key.

    Spark sorts the rows by key and time and spills; a task folds them in that order and holds one key's counts
    and one batch of rows, however many rows a key has. Whether an attempt is skipped depends on all before it, so a
    key's rows are read by one task. A null key is a key.
    """
    rows = events.selectExpr("cast(key as string) key", "cast(at as double) at", "seq", "ok").repartition("key").sortWithinPartitions("key", "at", "seq")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[str | None, _Fold] | None = None
        for frame in frames:
            done = []
            for key, at, ok in zip(frame["key"], frame["at"].to_numpy(float), frame["ok"], strict=True):
                if last is None or key != last[0]:
                    done += [(last[0], *last[1].row())] if last else []
                    last = key, _Fold(threshold, reset_s, gated)
                last[1].step(float(at), bool(ok))
            yield _frame(done)
        if last:
            yield _frame([(last[0], *last[1].row())])

    return rows.mapInPandas(fold, _OUT)
