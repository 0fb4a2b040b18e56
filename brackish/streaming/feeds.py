"""Stream forms of the hourly mean, sliding mean and table enrichment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brackish.functions.nulls import safe_divide
from brackish.operators.keys import join_on
from brackish.session import scratch_path


def _event_time(feed: DataFrame, time: str, delay: str) -> DataFrame:
    """Watermarks need zoned time; the session runs in UTC, so the wall clock is kept."""
    return feed.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def _bounds() -> list[Column]:
    return [F.col(f"window.{end}").cast("timestamp_ntz").alias(end) for end in ("start", "end")]


def open_feed(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options) -> DataFrame:
    """A file pattern of logger files as a stream."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def tumbling_mean(
    feed: DataFrame, keys: Sequence[str], time: str, value: str, window: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Mean per key and window; a window is emitted once when the watermark has passed it."""
    return (
        _event_time(feed, time, delay)
        .groupBy(*keys, F.window(time, window))
        .agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
        .select(*keys, *_bounds(), "mean", "n")
    )


def sliding_mean(
    feed: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    window: str = "60 minutes",
    slide: str = "1 minute",
    delay: str = "1 hour",
) -> DataFrame:
    """Mean of the last `window`, every `slide`, per key.

    Readings are first summed per slide; the overlapping windows are built from those sums,
    so a reading is not copied once per window it belongs to.
    """
    parts = (
        _event_time(feed, time, delay)
        .groupBy(*keys, F.window(time, slide).alias("_slide"))
        .agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    )
    at = F.window_time("_slide").alias("_at")
    return (
        parts.select(*keys, at, "_s", "_n")
        .groupBy(*keys, F.window("_at", window, slide))
        .agg(safe_divide(F.sum("_s"), F.sum("_n")).alias("mean"), F.sum("_n").alias("n"))
        .select(*keys, *_bounds(), "mean", "n")
    )


def enrich(feed: DataFrame, table: DataFrame, keys: Sequence[str], unit: str, time: str) -> DataFrame:
    """Left join of a stream with a static table keyed by rounded-down time."""
    keyed = feed.withColumn("_at", F.date_trunc(unit, time).cast("timestamp_ntz"))
    static = table.withColumnRenamed(time, "_at")
    return keyed.join(static, ["_at", *keys], "left").drop("_at")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available, write it to the shared scratch area, and read it back.

    Output and progress live in the cluster's checkpoint folder, so a lost executor or a
    restart continues from the last finished batch.
    """
    spark = stream.sparkSession
    return run_again(stream, scratch_path(spark, f"{name}-rows"), scratch_path(spark, f"{name}-progress"))


def run_again(stream: DataFrame, out: str, progress: str) -> DataFrame:
    """Process what has come since the last run with the same `progress`; all that was written so far."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def with_open_windows(
    emitted: DataFrame, rows: DataFrame, keys: Sequence[str], time: str, open_for: str, build: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The emitted windows of a feed that has ended, and those its watermark never closed.

    `open_for` is the window's length and the delay together: windows that were not emitted hold
    only rows of that last stretch, which `build`, the stream's own form, aggregates as a batch.
    """
    last = rows.select(F.max(time).cast("timestamp_ntz")).scalar()
    late = rows.where(F.col(time).cast("timestamp_ntz") >= last - F.expr(f"INTERVAL {open_for}"))
    missing = join_on(build(late), emitted.select(*keys, "start"), [*keys, "start"], "left_anti")
    return emitted.unionByName(missing)
