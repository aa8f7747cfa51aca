"""Buffers that are emptied by size or age, per key: state of a stream, with timers of processing time."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Executors need no copy of this module on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST, SECONDS = 10_000, 900
#: The store that such state needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Buffer(StatefulProcessor):
    """Keeps a key's rows until there are `most` of them or the oldest has waited for so many seconds; what is full leaves at once,
    so that a key never has more than `most` rows in state."""

    def __init__(self, most: int, seconds: float):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "body string")
        self.about = handle.getValueState("about", "n long, flushes long, due long")

    def _out(self, key, flush: int, reason: str, bodies: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"key": str(key[0]), "flush": flush, "reason": reason, "size": len(bodies), "body": bodies})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, flushes, due = self.about.get() if self.about.exists() else (0, 0, 0)
        fresh: list[str] = []
        kept = n
        for part in rows:
            fresh += part["body"].tolist()
            at = 0
            while kept + len(fresh) - at >= self.most:
                since, at = at, at + self.most - kept
                yield self._out(key, flushes, "full", [*self._stored(kept), *fresh[since:at]])
                kept, flushes = 0, flushes + 1
            fresh = fresh[at:]
        if kept == 0 and n:
            self.rows.clear()
        if kept == 0:  # what waits now began to wait now
            if n:
                self.handle.deleteTimer(due)
            if fresh:
                due = timerValues.getCurrentProcessingTimeInMs() + int(self.seconds * 1000)
                self.handle.registerTimer(due)
        if fresh:
            self.rows.appendList([(b,) for b in fresh])
        self.about.update((kept + len(fresh), flushes, due))

    def _stored(self, n: int) -> list[str]:
        return [r[0] for r in self.rows.get()] if n else []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, flushes, due = self.about.get()
        if n and expiredTimerInfo.getExpiryTimeInMs() == due:
            yield self._out(key, flushes, "age", self._stored(n))
            self.rows.clear()
            self.about.update((0, flushes + 1, due))

    def close(self) -> None:
        pass


def buffered(rows: DataFrame, key: str, most: int = MOST, seconds: float = SECONDS) -> DataFrame:
    """key, flush, reason, size, body of a stream: each row as JSON when its key's buffer leaves, full (`most` rows) or by age.

    A flush's rows have its key, number and size. Days are to be taken from the rows, not from when they left. The session
    must use STORE when the stream starts; rows without a key share a buffer.
    """
    body = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.to_json(F.struct("*")).alias("body"))
    return body.groupBy("key").transformWithStateInPandas(Buffer(most, seconds), "key string, flush long, reason string, size long, body string", "Append", "ProcessingTime")


class store:
    """Within it streams start with STORE."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(STORE[0], None)
        self.spark.conf.set(*STORE)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(STORE[0])
        else:
            self.spark.conf.set(STORE[0], self.before)
