"""Tumbling means that also tell which readings came too late.

A watermarked aggregation drops late readings without a word. Here a window per key is a keyed state
with a timer at the window's end: readings add to it until the timer fires, and a reading whose window
the watermark has passed becomes a row of the second output. Emitted, late and still open readings
add up to the feed.

A reading is late if its window had ended when its batch began: at or before the watermark, which is the
latest time of all earlier batches less `delay`. That is one instant per batch for all keys and tasks, so
neither the order within a batch nor the partitioning changes what is late.

A window of a busy key is spread over `spread` states, whose sums are added when the table is read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from brackish.functions.nulls import safe_divide

#: Keyed state with timers needs this store.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside of the block keep their state in the store that timers need."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def _row(kind: str, key: tuple, end: int, sums: tuple, reading: tuple = (None, None)) -> tuple:
    return (kind, *key[:-3], key[-3], pd.Timestamp(end, unit="ms", tz="UTC"), *sums, *reading)


class _Windows(StatefulProcessor):
    """State of one (keys, start, end, share): sum of values, values, rows."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "s double, n long, n_rows long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end = key[-2]
        late = end <= timerValues.getCurrentWatermarkInMs()
        s, n, n_rows = (self.sums.get() if not late and self.sums.exists() else None) or (0.0, 0, 0)
        for batch in rows:
            times, values = batch.iloc[:, -2], batch.iloc[:, -1]
            if late:
                # the reading itself, as it came
                yield pd.DataFrame(
                    [_row("late", key, end, (None, None, 1), reading) for reading in zip(times, values)], columns=self.columns
                )
            else:
                s, n, n_rows = s + float(values.sum()), n + int(values.count()), n_rows + len(batch)
        if not late:
            if not self.sums.exists():
                self.handle.registerTimer(end)
            self.sums.update((s, n, n_rows))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, n, n_rows = self.sums.get()
        self.sums.clear()
        yield pd.DataFrame([_row("window", key, key[-2], (s, n, n_rows))], columns=self.columns)

    def close(self) -> None:
        pass


def windows_and_late_rows(
    feed: DataFrame, keys: Sequence[str], time: str, value: str, window: str = "1 hour", delay: str = "1 hour", spread: int = 8
) -> DataFrame:
    """Stream of closed windows (kind `window`: parts of them) and of late readings (kind `late`).

    Columns: kind, keys, start, end, s, n, n_rows, at, value. `closed_windows` and `late_rows` read the
    table that it is written to. Rows without a time are in no window and are left out.
    """
    keys = list(keys)
    bounds = F.window(time, window)
    rows = (
        feed.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, delay)
        .select(
            *keys,
            # plain columns: marked as event time, late rows would be dropped before they are seen
            bounds["start"].cast("double").cast("timestamp").alias("start"),
            F.unix_millis(bounds["end"]).alias("_end"),
            F.pmod(F.xxhash64(time, value), F.lit(spread)).alias("_share"),
            F.timestamp_micros(F.unix_micros(time)).alias("_at"),
            F.col(value).cast("double").alias("_v"),
        )
    )
    types = {f.name: f.dataType for f in rows.schema}
    schema = StructType(
        [StructField("kind", StringType()), *[StructField(k, types[k]) for k in keys]]
        + [StructField(c, TimestampType()) for c in ("start", "end")]
        + [StructField("s", DoubleType()), StructField("n", LongType()), StructField("n_rows", LongType())]
        + [StructField("at", TimestampType()), StructField("value", DoubleType())]
    )
    return rows.groupBy(*keys, "start", "_end", "_share").transformWithStateInPandas(
        _Windows(schema.names), schema, "Append", "eventTime"
    )


def _naive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def closed_windows(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, end, mean, n (values), n_rows of the windows that were emitted."""
    parts = _naive(written.where("kind = 'window'"), "start", "end")
    sums = parts.groupBy(*keys, "start", "end").agg(*[F.sum(c).alias(c) for c in ("s", "n", "n_rows")])
    return sums.select(*keys, "start", "end", safe_divide(F.col("s"), F.col("n")).alias("mean"), "n", "n_rows")


def late_rows(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, end, at, value of every reading that came after its window."""
    return _naive(written.where("kind = 'late'"), "start", "end", "at").select(*keys, "start", "end", "at", "value")
