"""Instrument and service files that are not plain delimited tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackish.functions.nulls import null_if


def read_tides(spark: SparkSession, path: str, **tags: str) -> DataFrame:
    """Tide predictions: tab-separated ``date, weekday, time, height`` after a preamble.

    Data lines are recognised by their leading date, so preamble length, ragged headers and
    trailing tabs do not matter; cells that are missing or no number are NULL. `tags` become constant columns.
    """
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\d{4}/\d{2}/\d{2}\t"))
    return rows.select(
        F.try_to_timestamp(F.concat_ws(" ", F.get(parts, 0), F.get(parts, 2)), F.lit("yyyy/MM/dd HH:mm"))
        .cast("timestamp_ntz")
        .alias("date"),
        F.trim(F.get(parts, 3)).try_cast("double").alias("tideheight"),
        *[F.lit(v).alias(k) for k, v in tags.items()],
    )


def read_columns(spark: SparkSession, path: str, wanted: Mapping[str, int], sentinel: float | None = None) -> DataFrame:
    """Numbers from a headerless whitespace-separated file, by 0-based position.

    Only the named positions are typed; `sentinel` marks missing values.
    """
    fields = F.split(F.trim("value"), r"\s+")
    columns = {n: F.try_element_at(fields, F.lit(i + 1)).try_cast("double") for n, i in wanted.items()}
    if sentinel is not None:
        columns = {n: null_if(c, sentinel) for n, c in columns.items()}
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Outer rings of the polygon placemarks in KML files: ``name, ring`` (array of lon, lat).

    A corner that is no number has NULL in its place; inner rings are not read.
    """
    schema = (
        "name string, Polygon struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>"
    )
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    text = F.col("Polygon.outerBoundaryIs.LinearRing.coordinates")
    corners = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")

    def corner(c):
        xy = F.split(c, ",")
        return F.struct(F.get(xy, 0).try_cast("double").alias("lon"), F.get(xy, 1).try_cast("double").alias("lat"))

    return marks.where(text.isNotNull()).select("name", F.transform(corners, corner).alias("ring"))


def polygon_vertices(polygons: DataFrame) -> DataFrame:
    """One row per corner, in ring order."""
    return polygons.select("name", F.posexplode("ring").alias("corner", "p")).select("name", "corner", "p.lon", "p.lat")
