"""Variograms over all pairs of a group's points, and the model fitted to them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackish.operators.keys import attach, join_on
from brackish.session import settle

#: Cells per side of the first lattice, as bits; bits of each finer one; point pairs of two cells
#: that are looked at one by one.
FIRST_BITS, MORE_BITS = 3, 2
EXACT_PAIRS = 1 << 16
#: Ranges that a fit tries, evenly spaced up to the furthest class.
RANGES = 64

_SUMS = ("n", "s", "q", "sx", "sy", "sr", "x0", "x1", "y0", "y1")


def variogram(df: DataFrame, keys: Sequence[str], x: str, y: str, z: str, lags: int = 3, depth: int = 5) -> DataFrame:
    """Per key and distance class: pairs, distance, gamma (half the mean squared difference).

    The classes divide the diagonal of a group's own extent. Points are summed per cell of a lattice
    over that extent. Two cells whose pairs must all fall into one class, by the boxes around their
    points, add their sums; of the others, those with few pairs are taken point by point, and the
    rest are split into cells of the next finer lattice. So near pairs are exact and far pairs cost
    one row per pair of cells. Only pairs of cells of the last lattice (`depth` of them) that still
    hold many points and straddle a class limit are put into the class of their mean positions,
    which are then off by less than the diagonal divided by 2 ** (2 * depth + 1).

    `distance` is the root mean square of the distances of the class's pairs, because sums over
    cells give that exactly. Rows with a NULL are left out; a group of one point has no rows.
    """
    named = list(keys) or ["_all"]
    plain = df.dropna(subset=[x, y, z]).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(z).alias("_z"))
    if not keys:
        plain = plain.withColumn("_all", F.lit(0))
    wide, high = F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y")
    spans = plain.groupBy(*named).agg(
        F.min("_x").alias("_x0"), F.min("_y").alias("_y0"), F.avg("_z").alias("_z0"), F.hypot(wide, high).alias("_far")
    )
    finest = FIRST_BITS + MORE_BITS * (depth - 1)

    def place(at: str) -> Column:
        cell = F.floor(F.try_divide(F.col(at) * (1 << finest), F.col("_far")))
        return F.least(F.coalesce(cell, F.lit(0)), F.lit((1 << finest) - 1))

    # positions and values count from the group's corner and mean, so that no sum loses digits
    moved = attach(plain, spans, named).select(
        *named, "_far", *[(F.col(c) - F.col(f"{c}0")).alias(c) for c in ("_x", "_y", "_z")]
    )
    points = settle(moved.withColumns({"_ix": place("_x"), "_iy": place("_y")}), "points")

    def classed(distance: Column) -> Column:
        return F.least(F.coalesce(F.floor(F.try_divide(distance * lags, F.col("_far"))), F.lit(0)), F.lit(lags - 1)).cast("int")

    def at_level(level: int) -> dict[str, Column]:
        shift = MORE_BITS * (depth - 1 - level)
        return {"cx": F.shiftright("_ix", shift), "cy": F.shiftright("_iy", shift)}

    def cells(level: int) -> DataFrame:
        cell = at_level(level)
        return points.groupBy(*named, "_far", *[c.alias(n) for n, c in cell.items()]).agg(
            F.count("*").alias("n"), F.sum("_z").alias("s"), F.sum(F.col("_z") * F.col("_z")).alias("q"),
            F.sum("_x").alias("sx"), F.sum("_y").alias("sy"), F.sum(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")).alias("sr"),
            F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"),
        )

    def side(df: DataFrame, end: str) -> DataFrame:
        return df.withColumnsRenamed({c: c + end for c in ("cx", "cy", *_SUMS, "px", "py") if c in df.columns})

    ordered = F.struct("cx_a", "cy_a") <= F.struct("cx_b", "cy_b")
    first = cells(0)
    met = join_on(side(first, "_a"), side(first, "_b").drop("_far"), named, "inner").where(ordered)
    parts = []
    for level in range(depth):
        met = settle(_judged(met, classed), "cell-pairs")
        whole = met.where(F.col("least") == F.col("most"))
        split = met.where(F.col("least") != F.col("most"))
        few = F.col("n_a") * F.col("n_b") <= EXACT_PAIRS
        parts.append(_cell_sums(whole, named, F.col("least")))
        parts.append(_point_sums(split.where(few), points.withColumns(at_level(level)), named, classed))
        split = split.where(~few)
        if split.isEmpty():
            break
        if level == depth - 1:
            apart = [F.col(f"s{c}_a") / F.col("n_a") - F.col(f"s{c}_b") / F.col("n_b") for c in ("x", "y")]
            parts.append(_cell_sums(split, named, classed(F.hypot(*apart))))
            break
        finer = settle(cells(level + 1), "cells").withColumns(
            {"px": F.shiftright("cx", MORE_BITS), "py": F.shiftright("cy", MORE_BITS)}
        )
        open_ = split.select(*named, "_far", *[F.col(f"c{c}_{e}").alias(f"p{c}_{e}") for e in "ab" for c in "xy"])
        left = join_on(open_, side(finer, "_a").drop("_far"), [*named, "px_a", "py_a"], "inner")
        both = join_on(left, side(finer, "_b").drop("_far"), [*named, "px_b", "py_b"], "inner")
        same = (F.col("px_a") == F.col("px_b")) & (F.col("py_a") == F.col("py_b"))
        met = both.where(~same | ordered).drop("px_a", "py_a", "px_b", "py_b")
    sums = reduce(DataFrame.unionByName, parts).groupBy(*named, "lag").agg(*[F.sum(c).alias(c) for c in ("pairs", "d2", "squares")])
    return sums.where("pairs > 0").select(
        *keys,
        "lag",
        F.round("pairs").cast("bigint").alias("pairs"),
        F.sqrt(F.greatest(F.col("d2"), F.lit(0.0)) / F.col("pairs")).alias("distance"),
        (F.greatest(F.col("squares"), F.lit(0.0)) / F.col("pairs") / 2).alias("gamma"),
    )


def _same() -> Column:
    return (F.col("cx_a") == F.col("cx_b")) & (F.col("cy_a") == F.col("cy_b"))


def _judged(met: DataFrame, classed) -> DataFrame:
    """The classes of the nearest and of the furthest points that two boxes can hold."""

    def gap(c: str) -> Column:
        return F.greatest(F.col(f"{c}0_b") - F.col(f"{c}1_a"), F.col(f"{c}0_a") - F.col(f"{c}1_b"), F.lit(0.0))

    def span(c: str) -> Column:
        return F.greatest(F.col(f"{c}1_b"), F.col(f"{c}1_a")) - F.least(F.col(f"{c}0_b"), F.col(f"{c}0_a"))

    near, far = F.hypot(gap("x"), gap("y")), F.hypot(span("x"), span("y"))
    return met.withColumns({"least": classed(near), "most": classed(far)})


def _cell_sums(met: DataFrame, keys: Sequence[str], lag: Column) -> DataFrame:
    """Sums over all pairs of points of two cells; within one cell each pair counts once."""

    def both(square: str, *sums: str) -> Column:
        crossed = reduce(lambda a, b: a + b, [F.col(f"{c}_a") * F.col(f"{c}_b") for c in sums])
        return F.col("n_a") * F.col(f"{square}_b") + F.col("n_b") * F.col(f"{square}_a") - 2 * crossed

    half = F.when(_same(), 0.5).otherwise(1.0)
    own = F.when(_same(), F.col("n_a")).otherwise(0)
    return met.select(
        *keys,
        lag.alias("lag"),
        (half * (F.col("n_a") * F.col("n_b") - own)).alias("pairs"),
        (half * both("sr", "sx", "sy")).alias("d2"),
        (half * both("q", "s")).alias("squares"),
    )


def _point_sums(met: DataFrame, points: DataFrame, keys: Sequence[str], classed) -> DataFrame:
    """The same, pair by pair. A point's pair with itself has no distance and is taken off."""
    named = met.select(*keys, "_far", "cx_a", "cy_a", "cx_b", "cy_b")
    for end in "ab":
        here = points.select(*keys, *[F.col(c).alias(f"{c}_{end}") for c in ("cx", "cy", "_x", "_y", "_z")])
        named = join_on(named, here, [*keys, f"cx_{end}", f"cy_{end}"], "inner")
    dx, dy, dz = (F.col(f"{c}_a") - F.col(f"{c}_b") for c in ("_x", "_y", "_z"))
    half = F.when(_same(), 0.5).otherwise(1.0)
    seen = named.select(
        *keys,
        classed(F.hypot(dx, dy)).alias("lag"),
        half.alias("pairs"),
        (half * (dx * dx + dy * dy)).alias("d2"),
        (half * dz * dz).alias("squares"),
    )
    alone = met.where(_same()).select(
        *keys, F.lit(0).alias("lag"), (F.col("n_a") * -0.5).alias("pairs"), F.lit(0.0).alias("d2"), F.lit(0.0).alias("squares")
    )
    return seen.unionByName(alone)


def fit_spherical(lags: DataFrame, keys: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """Per key nugget, range and sill: the spherical model with the least squared misfit to the
    classes, each weighted by its pairs.

    For a given range the model is linear, so its nugget (not below 0) and sill are solved; the
    range is the best of `ranges` steps up to the furthest class, the shortest of equally good ones.
    A model whose sill is not above its nugget has no spatial structure. Without two classes at
    different heights of the model there is no row.
    """
    of_key = Window.partitionBy(*keys)  # a row per class
    tried = lags.withColumn("_far", F.max("distance").over(of_key)).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(ranges))))
    h = F.least(F.coalesce(F.try_divide(F.col("distance") * ranges, F.col("_far") * F.col("_k")), F.lit(0.0)), F.lit(1.0))
    w, g = F.col("pairs"), F.col("gamma")
    f = F.col("_f")
    sums = (
        tried.withColumn("_f", 1.5 * h - 0.5 * h * h * h)
        .groupBy(*keys, "_k", "_far")
        .agg(*[F.sum(c).alias(n) for n, c in {"w": w, "wf": w * f, "wg": w * g, "wff": w * f * f, "wfg": w * f * g, "wgg": w * g * g}.items()])
    )
    c = {n: F.col(n) for n in ("w", "wf", "wg", "wff", "wfg", "wgg")}
    spread = c["w"] * c["wff"] - c["wf"] * c["wf"]
    solved = (
        sums.where(spread > 1e-9 * c["w"] * c["wff"])
        .withColumn("_c1", (c["w"] * c["wfg"] - c["wf"] * c["wg"]) / spread)
        .withColumn("_c0", (c["wg"] - F.col("_c1") * c["wf"]) / c["w"])
    )
    low = F.col("_c0") < 0
    solved = solved.select(
        *keys, "_k", "_far", *c, F.greatest("_c0", F.lit(0.0)).alias("_c0"), F.when(low, c["wfg"] / c["wff"]).otherwise(F.col("_c1")).alias("_c1")
    )
    c0, c1 = F.col("_c0"), F.col("_c1")
    misfit = c["wgg"] - 2 * c0 * c["wg"] - 2 * c1 * c["wfg"] + c0 * c0 * c["w"] + 2 * c0 * c1 * c["wf"] + c1 * c1 * c["wff"]
    rank = F.struct(F.round(F.try_divide(misfit, c["wgg"]), 9), "_k")
    model = F.struct(c0.alias("nugget"), (F.col("_far") * F.col("_k") / ranges).alias("range"), (c0 + c1).alias("sill"))
    return solved.groupBy(*keys).agg(F.min_by(model, rank).alias("_m")).select(*keys, "_m.*")
