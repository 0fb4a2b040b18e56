"""Polygons and grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.operators.keys import join_on

Ring = Sequence[tuple[float, float]]


def ring_column(ring: Ring) -> Column:
    """A polygon ring as a literal array column."""
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ring])


def inside_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test: an odd number of ring edges lies to the right of the point.

    `ring` is an array of ``struct<lon, lat>``; it need not be closed. The count runs in the
    row's own expression, so there is no join with the edges.
    """
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = F.arrays_zip(ring.alias("a"), following.alias("b"))

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straddles = (a["lat"] > y) != (b["lat"] > y)
        at = a["lon"] + F.try_divide(y - a["lat"], b["lat"] - a["lat"]) * (b["lon"] - a["lon"])
        return straddles & (x < at)

    return F.size(F.filter(edges, crossed)) % 2 == 1


def inside_box(x: Column, y: Column, ring: Ring) -> Column:
    """Bounding-box test that reaches the scan as a plain range filter."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))


def polygon_grid(spark, ring: Ring, pixels: int) -> DataFrame:
    """Cell centres of a `pixels` x `pixels` grid over the ring's box that fall inside it."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    dx, dy = (max(xs) - min(xs)) / pixels, (max(ys) - min(ys)) / pixels
    cells = spark.range(pixels * pixels).select(
        (F.col("id") % pixels).cast("int").alias("ix"), F.floor(F.col("id") / pixels).cast("int").alias("iy")
    )
    located = cells.withColumns(
        {"x": min(xs) + (F.col("ix") + 0.5) * dx, "y": min(ys) + (F.col("iy") + 0.5) * dy}
    )
    return located.where(inside_polygon(F.col("x"), F.col("y"), ring_column(ring)))


def nearest_cell(df: DataFrame, x: str, y: str, at: tuple[float, float], keys: Sequence[str] = ()) -> DataFrame:
    """Rows of a stored grid at the cell nearest to one position."""
    distance = F.pow(F.col(x) - at[0], 2) + F.pow(F.col(y) - at[1], 2)
    chosen = df.groupBy(*keys).agg(F.min_by(F.struct(x, y), F.struct(distance, x, y)).alias("_c")).select(*keys, "_c.*")
    return join_on(df, chosen, [*keys, x, y], "left_semi")
