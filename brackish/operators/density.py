"""Gaussian kernel density on a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.operators.keys import attach
from brackish.operators.ordered import exact_quantiles
from brackish.session import settle

_NORMAL = 0.3989422804014327  # 1 / sqrt(2 pi)


def rule_of_thumb_bandwidth(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """0.9 * min(sd, IQR / 1.34) * n^(-1/5) per key."""
    quartiles = exact_quantiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75})
    stats = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd")
    )
    width = F.least(F.col("_sd"), (F.col("_q3") - F.col("_q1")) / 1.34)
    joined = attach(stats, quartiles, keys)
    return joined.select(*keys, (0.9 * width * F.pow(F.col("_n"), F.lit(-0.2))).alias("bandwidth"))


#: Beyond so many bandwidths the kernel is zero in double precision.
_REACH = 40.0


def _bin_linear(df: DataFrame, keys: Sequence[str], value: str, low: float, step: float) -> DataFrame:
    """Weight of each grid cell, every value shared between its two neighbours.

    Cells go on below and above the grid, so that rows outside of it count as well.
    """
    position = (F.col(value) - low) / step
    cell, share = F.floor(position), position - F.floor(position)
    halves = F.array(
        F.struct(cell.alias("cell"), (1 - share).alias("weight")),
        F.struct((cell + 1).alias("cell"), share.alias("weight")),
    )
    return (
        df.where(F.col(value).isNotNull())
        .select(*keys, F.inline(halves))
        .where(F.col("weight") > 0)
        .groupBy(*keys, "cell")
        .agg(F.sum("weight").alias("weight"))
    )


def _window(df: DataFrame, value: str, low: float | None, high: float | None) -> tuple[float, float]:
    """The given window, completed by the column's own smallest and largest value."""
    if low is None or high is None:
        least, most = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
        low, high = (least or 0.0) if low is None else low, (most or 0.0) if high is None else high
    return float(low), float(high) if high > low else float(low) + 1.0


def density_curve(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    bandwidth: float | DataFrame,
    low: float | None = None,
    high: float | None = None,
    points: int = 512,
) -> DataFrame:
    """Density of `value` at `points` grid positions from `low` to `high`, by default its range.

    All rows count, whether or not they lie between the ends. Rows are first summed into grid
    cells map-side; a cell spreads over the grid only where its kernel is not zero.
    """
    low, high = _window(df, value, low, high)
    step = (high - low) / (points - 1)
    cells = settle(_bin_linear(df, keys, value, low, step), "cells")
    total = cells.groupBy(*keys).agg(F.sum("weight").alias("_n"))
    cells = attach(cells, total, keys)
    if isinstance(bandwidth, DataFrame):
        cells = attach(cells, bandwidth, keys)
    else:
        cells = cells.withColumn("bandwidth", F.lit(float(bandwidth)))
    reach = _REACH * F.col("bandwidth") / step + 1
    cells = cells.where(F.col("cell").between(-reach, points + reach))
    z = (F.col("point") - F.col("cell")) * step / F.col("bandwidth")
    return (
        cells.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy(*keys, "point")
        .agg(
            F.sum(
                F.col("weight") * _NORMAL * F.exp(-0.5 * z * z) / (F.col("bandwidth") * F.col("_n"))
            ).alias("density"),
            F.max("_n").alias("n"),
        )
        .withColumn(value, low + F.col("point") * step)
        .select(*keys, "point", value, "density", "n")
    )


def share_of_total(curves: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Each key's part of the summed counts at a grid point (a filled density plot)."""
    at = [*by, "point"]
    weighted = curves.withColumn("_count", F.col("density") * F.col("n"))
    totals = weighted.groupBy(*at).agg(F.sum("_count").alias("_all"))
    return (
        attach(weighted, totals, at)
        .withColumn("share", F.try_divide(F.col("_count"), F.col("_all")))
        .drop("_count", "_all")
    )


def density_surface(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    bandwidth: tuple[float, float],
    x_range: tuple[float, float],
    y_range: tuple[float, float],
    points: int = 25,
) -> DataFrame:
    """Two-dimensional density with a product kernel, at the window's grid but over all rows.

    Cells are summed first; the kernel is applied along x, then along y.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    steps = {x: (x_range[1] - x_range[0]) / (points - 1), y: (y_range[1] - y_range[0]) / (points - 1)}
    cells = known.groupBy(
        *keys,
        F.round((F.col(x) - x_range[0]) / steps[x]).alias("_cx"),
        F.round((F.col(y) - y_range[0]) / steps[y]).alias("_cy"),
    ).agg(F.count(F.lit(1)).alias("_w"))
    cells = settle(cells, "cells")
    total = cells.groupBy(*keys).agg(F.sum("_w").alias("_n"))
    for cell, step, h in (("_cx", steps[x], bandwidth[0]), ("_cy", steps[y], bandwidth[1])):
        cells = cells.where(F.col(cell).between(-_REACH * h / step - 1, points + _REACH * h / step + 1))
    spread = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))

    def kernel(point: str, cell: str, step: float, h: float):
        z = (F.col(point) - F.col(cell)) * step / h
        return _NORMAL * F.exp(-0.5 * z * z) / h

    along_x = (
        cells.withColumn("ix", spread)
        .groupBy(*keys, "ix", "_cy")
        .agg(F.sum(F.col("_w") * kernel("ix", "_cx", steps[x], bandwidth[0])).alias("_w"))
    )
    along_y = (
        along_x.withColumn("iy", spread)
        .groupBy(*keys, "ix", "iy")
        .agg(F.sum(F.col("_w") * kernel("iy", "_cy", steps[y], bandwidth[1])).alias("_d"))
    )
    return attach(along_y, total, keys).select(
        *keys,
        (x_range[0] + F.col("ix") * steps[x]).alias(x),
        (y_range[0] + F.col("iy") * steps[y]).alias(y),
        (F.col("_d") / F.col("_n")).alias("density"),
    )
