"""URLs seen before, kept as state per URL with an expiry, so that no batch reads what earlier ones stored."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pressline.streaming.intake import SALTS

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_with_timers(spark: SparkSession) -> Iterator[None]:
    """State variables and timers need this state store; a query keeps the one it was first started with."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def _millis(at: dt.datetime) -> int:
    """Rows hold instants as local times of the worker."""
    return round(at.timestamp() * 1000)


class FirstSight(StatefulProcessor):
    """Lets the first row of a key through and remembers its instant until the watermark is ``span`` past it."""

    def __init__(self, ts: str, span_ms: int) -> None:
        self.ts = ts
        self.span = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at BIGINT")

    def _remember(self, at: int) -> None:
        self.seen.update((at,))
        self.handle.registerTimer(at + self.span)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self._remember(_millis(initialState[self.ts]))

    def handleInputRows(self, key: Any, rows: Iterable[Row], timerValues: Any) -> Iterator[Row]:
        if self.seen.exists():
            at = self.seen.get()[0]
            # Timers fire after the rows of a batch: a URL whose time is up is new again already.
            if at + self.span > timerValues.getCurrentWatermarkInMs():
                return
            self.handle.deleteTimer(at + self.span)
        first = _smallest(rows, self.ts)
        self._remember(_millis(first[self.ts]))
        yield first

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


class Smallest(StatefulProcessor):
    """The smallest row of a key in each batch; keeps nothing."""

    def __init__(self, ts: str, columns: list[str]) -> None:
        self.ts = ts
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterable[Row], timerValues: Any) -> Iterator[Row]:
        first = _smallest(rows, self.ts)
        yield Row(**{c: first[c] for c in self.columns})

    def close(self) -> None:
        pass


def _smallest(rows: Iterable[Row], ts: str) -> Row:
    """The earliest row, of equally early ones the smallest by its columns, null last."""
    return min(rows, key=lambda r: (r[ts], *((v is None, v) for v in r)))


def stream_unseen(
    df: DataFrame, ts: str, span: dt.timedelta, delay: str, key: str = "url", stored: DataFrame | None = None, salts: int = SALTS
) -> DataFrame:
    """The first row of each key; it counts as new again once the watermark is ``span`` past its row.

    ``delay`` is the watermark of ``ts``: rows behind that of the batch before are dropped, so ``ts`` decides, not the clock. ``stored(key, ts)``, one row a key,
    are keys to count as seen from the start; they are read once, by the first batch. State is one instant per key. Copies of
    a frequent key in one batch are reduced to one per salt before they meet in one task. Rows without key or instant are left
    out. Start the query inside ``state_with_timers``.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    few = rows.withColumn("_salt", salt).groupBy(key, "_salt").transformWithState(
        statefulProcessor=Smallest(ts, df.columns), outputStructType=df.schema, outputMode="Append", timeMode="EventTime",
        eventTimeColumnName=ts,
    )
    initial = None if stored is None else stored.select(key, ts).groupBy(key)
    return few.groupBy(key).transformWithState(
        statefulProcessor=FirstSight(ts, span // dt.timedelta(milliseconds=1)), outputStructType=df.schema,
        outputMode="Append", timeMode="EventTime", initialState=initial,
    )
