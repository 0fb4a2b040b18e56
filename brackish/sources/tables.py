"""Literal tables, stored grids, and result sinks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackish.operators.spatial import nearest_cell


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table written in code; its size is known to the planner, which may broadcast it."""
    return spark.createDataFrame(list(rows), schema)


def sampling_times(spark: SparkSession, times: Sequence[str], labels: Sequence[str], label: str = "sample_type") -> DataFrame:
    rows = [(datetime.fromisoformat(t), v) for t, v in zip(times, labels, strict=True)]
    return literal_table(spark, rows, f"datetime timestamp_ntz, {label} string")


def grid_slice(
    grid: DataFrame,
    time: str,
    start: str,
    stop: str,
    lat: str,
    lon: str,
    at: tuple[float, float],
    hours_from_utc: int = 0,
) -> DataFrame:
    """A time span of a stored grid at the cell nearest to ``(lat, lon)``, in local time.

    The time bounds are compared with the stored column, so they reach the scan.
    """
    moved = F.expr(f"INTERVAL {int(hours_from_utc)} HOURS")
    span = grid.where(F.col(time).between(F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz")))
    return nearest_cell(span, lat, lon, at).withColumn(time, F.col(time) + moved)


def write_results(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Write a result; `partition_by` becomes folders that later reads can skip.

    Rows are left where they are: each task writes its own files, so one large site is not
    gathered into one task.
    """
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str], fmt: str = "parquet") -> None:
    """Write a run's partitions over those of an earlier run and leave all others as they are.

    A second run replaces its rows and never doubles them. Files are staged beside the result and
    move to their places when all tasks have ended, so a run that fails half-way changes nothing.
    `df` must not read from `path`.
    """
    if not partition_by:
        raise ValueError("without partitions there is nothing to keep: use write_results")
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.partitionBy(*partition_by).save(path)


def through_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write and read back: a stage boundary that later jobs start from."""
    write_results(df, path, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)
