"""When each source is due again, as a stream of fetches with a timer for each source.

State is two numbers a source. A fetch that failed doubles the wait, one that went well resets it. A source that isn't
fetched for TTL after it was due is forgotten, by a second timer, so sources that are gone leave nothing behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from ..operators.ingest import MOST_BACKOFF

TTL = timedelta(days=365)
_ZERO = datetime(1970, 1, 1)
OUT = StructType([StructField("source_id", LongType()), StructField("due_at", TimestampType()), StructField("failures", LongType())])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state where timers can be."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def wait_us(minutes: int, failures: int) -> int:
    """Microseconds until a source is due after so many failures in a row."""
    return int(minutes * 60_000_000 * min(2**failures, MOST_BACKOFF))


class BackOff(StatefulProcessor):
    """Fetches (source_id, at, seq, failed, minutes) in; (source_id, due_at, failures) out, once for each moment at which a
    source became due before it was fetched again. Moments are microseconds, timers milliseconds rounded up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.source = handle.getValueState("source", "failures long, due long")

    def _rows(self, key: tuple, due: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        if due:
            yield pd.DataFrame({"source_id": [key[0]] * len(due), "due_at": [_ZERO + timedelta(microseconds=d) for d, _ in due], "failures": [f for _, f in due]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        """Each call of the handle is a message to Spark, so a source without state, which has no timer, asks for none, and a
        timer whose moment is known isn't looked up."""
        known = self.source.get()
        failures, due = known or (0, -1)
        old = [] if known is None else [-(-due // 1000)] if due >= 0 else list(self.handle.listTimers())
        passed = []
        cols = [np.concatenate(c) for c in zip(*([f[c].to_numpy() for c in ("us", "seq", "failed", "minutes")] for f in rows), strict=True)]
        order = np.lexsort((cols[1], cols[0]))
        for us, _, failed, minutes in zip(*(c[order].tolist() for c in cols), strict=True):
            if 0 <= due <= us:
                passed.append((due, failures))
            failures = failures + 1 if failed else 0
            due = us + wait_us(minutes, failures)
        for t in old:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(-(-due // 1000))
        self.source.update((failures, due))
        yield from self._rows(key, passed)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        failures, due = self.source.get()
        if due < 0:
            self.source.clear()
            return
        self.source.update((failures, -1))
        self.handle.registerTimer(-(-due // 1000) + int(TTL.total_seconds() * 1000))
        yield from self._rows(key, [(due, failures)])

    def close(self) -> None:
        pass


def due_moments(fetches: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """(source_id, due_at, failures) of a stream of fetches: source_id, at, seq, failed, minutes. Fetches come in the order
    of their times but for ``lateness``; those of one moment go by ``seq``. A query over it has to be started inside ``timers``."""
    timed = fetches.selectExpr("CAST(source_id AS LONG) AS source_id", "CAST(at AS TIMESTAMP) AS at", "CAST(seq AS LONG) AS seq", "CAST(failed AS BOOLEAN) AS failed", "CAST(minutes AS LONG) AS minutes", "unix_micros(CAST(at AS TIMESTAMP)) AS us")
    kept = timed.withWatermark("at", lateness)
    return kept.groupBy("source_id").transformWithStateInPandas(BackOff(), OUT, "Append", "EventTime")
