"""Ordinary kriging in tiles.

Points are averaged per lattice cell. A tile is a square of lattice cells; it is solved with the
cells of its own and those in a halo around it, so every system has at most (tile + 2 * halo) ** 2
points, however large a group is. The halo is the range of the group's variogram, up to HALO cells:
cells further away than the range do not weigh on a prediction but through the mean.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.operators.keys import attach, join_on
from brackish.operators.spatial import Ring
from brackish.session import settle

#: Lattice cells per side of a tile, and in its halo at most.
TILE = 8
HALO = 8

_WEIGHTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("w", pa.float64())]))
_MODEL = ("nugget", "range", "sill")


@dataclass
class Kriging:
    """``groups``: keys, model, status, points (lattice cells), level (their mean). ``systems``: for
    each tile of an ``ok`` group keys, tx, ty, mean, weights; ``mean`` is NULL where it cannot be
    solved, and its predictions are the group's level."""

    keys: list[str]
    cells: DataFrame
    groups: DataFrame
    systems: DataFrame
    cell: float
    tile: int

    def predict(self, lines: DataFrame) -> DataFrame:
        """`lines` have the keys, an array `xs` of positions within one tile, and y; each keeps its
        columns and gets an array `predictions`."""
        keys = [*self.keys, "tx", "ty"]
        placed = lines.withColumns({"tx": self._tile(F.col("xs")[0]), "ty": self._tile(F.col("y"))})
        known = join_on(placed, self.groups.where("status = 'ok'").select(*self.keys, *_MODEL, "level"), self.keys, "inner")
        solved = join_on(known, self.systems.select(*keys, "mean", "weights"), keys, "left")
        kept = lines.columns
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema] + ["predictions array<double>"])

        def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = []
                columns = ("xs", "y", *_MODEL, "level", "mean", "weights")
                for xs, y, nugget, reach, sill, level, mean, points in zip(*(batch.column(c).to_pylist() for c in columns)):
                    if mean is None:
                        values.append([level] * len(xs))
                        continue
                    p = np.array([[q["x"], q["y"], q["w"]] for q in points])
                    gap = np.hypot(np.array(xs)[:, None] - p[None, :, 0], y - p[None, :, 1])
                    values.append((mean + spherical(gap, nugget, reach, sill) @ p[:, 2]).tolist())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in kept], pa.array(values, pa.list_(pa.float64()))], [*kept, "predictions"]
                )

        return solved.mapInArrow(evaluate, schema)

    def _tile(self, at: Column) -> Column:
        return F.floor(F.floor(at / self.cell) / self.tile)

    def at_cells(self) -> DataFrame:
        """Predictions at the points themselves: keys, cx, cy, prediction."""
        lines = self.cells.select(*self.keys, "cx", "cy", F.array("px").alias("xs"), F.col("py").alias("y"))
        return self.predict(lines).select(*self.keys, "cx", "cy", F.col("predictions")[0].alias("prediction"))

    def surface(self, ring: Ring, pixels: int) -> DataFrame:
        """Predictions at the `pixels` x `pixels` cell centres of the ring's box that lie inside of it:
        keys, ix, iy, x, y, prediction. A scan line of a tile is one row until it is evaluated."""
        lines = self.groups.where("status = 'ok'").select(*self.keys, F.explode(F.sequence(F.lit(0), F.lit(pixels - 1))).alias("iy"))
        kinds = [f"`{k}` {lines.schema[k].dataType.simpleString()}" for k in self.keys]
        schema = ", ".join([*kinds, "iy int, y double, ix array<int>, xs array<double>"])
        cut = partial(_scan_lines, keys=self.keys, ring=ring, pixels=pixels, size=self.cell, tile=self.tile)
        # lines are few bytes and much work: a number of its own keeps them from being put together again
        tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lines = lines.repartition(tasks, *self.keys, "iy").mapInArrow(cut, schema)
        zipped = F.inline(F.arrays_zip("ix", F.col("xs").alias("x"), F.col("predictions").alias("prediction")))
        return self.predict(lines).select(*self.keys, "iy", "y", zipped).select(*self.keys, "ix", "iy", "x", "y", "prediction")


def _scan_lines(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], ring: Ring, pixels: int, size: float, tile: int
) -> Iterator[pa.RecordBatch]:
    """The pixels of each scan line inside of the ring, cut at the tiles' limits."""
    a = np.array(ring, float)
    b = np.roll(a, -1, axis=0)
    (x0, y0), (dx, dy) = a.min(0), np.ptp(a, axis=0) / pixels
    xs = x0 + (np.arange(pixels) + 0.5) * dx
    home = np.floor(np.floor(xs / size) / tile)
    for batch in batches:
        rows, tops, places = [], [], []
        for r, iy in enumerate(batch.column("iy").to_pylist()):
            y = y0 + (iy + 0.5) * dy
            crossed = (a[:, 1] > y) != (b[:, 1] > y)
            p, q = a[crossed], b[crossed]
            at = p[:, 0] + (y - p[:, 1]) / (q[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0])
            inside = np.flatnonzero((xs[:, None] < at).sum(1) % 2 == 1)
            for part in np.split(inside, np.flatnonzero(np.diff(home[inside])) + 1):
                if len(part):
                    rows.append(r)
                    tops.append(y)
                    places.append(part)
        index = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(k).take(index) for k in keys],
                batch.column("iy").take(index),
                pa.array(tops, pa.float64()),
                pa.array(places, pa.list_(pa.int32())),
                pa.array([xs[p] for p in places], pa.list_(pa.float64())),
            ],
            [*keys, "iy", "y", "ix", "xs"],
        )


def spherical(d: np.ndarray, nugget: float, reach: float, sill: float) -> np.ndarray:
    h = np.minimum(d / reach, 1.0)
    return np.where(d > 0, nugget + (sill - nugget) * (1.5 * h - 0.5 * h**3), 0.0)


def _solve(points: list[dict], nugget: float, reach: float, sill: float) -> tuple[float | None, list[dict]]:
    """Mean and weights in dual form; None where the system is singular or has under 3 points."""
    if len(points) < 3:
        return None, []
    xyz = np.array([[p["px"], p["py"], p["pz"]] for p in points])
    n = len(xyz)
    gap = np.hypot(xyz[:, None, 0] - xyz[None, :, 0], xyz[:, None, 1] - xyz[None, :, 1])
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = spherical(gap, nugget, reach, sill)
    system[n, n] = 0.0
    try:
        solved = np.linalg.solve(system, np.append(xyz[:, 2], 0.0))
    except np.linalg.LinAlgError:
        return None, []
    return float(solved[n]), [{"x": a, "y": b, "w": w} for (a, b, _), w in zip(xyz.tolist(), solved[:n].tolist())]


def krige(
    df: DataFrame,
    models: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    z: str,
    cell: float,
    tile: int = TILE,
    halo: int = HALO,
) -> Kriging:
    """Solved tiles per key. A group that cannot be mapped keeps a row with a ``status`` saying why."""
    keys = list(keys)
    cells = settle(
        df.dropna(subset=[x, y, z])
        .groupBy(*keys, F.floor(F.col(x) / cell).alias("cx"), F.floor(F.col(y) / cell).alias("cy"))
        .agg(F.avg(x).alias("px"), F.avg(y).alias("py"), F.avg(z).alias("pz")),
        "lattice",
    )
    sizes = cells.groupBy(*keys).agg(F.count("*").alias("points"), F.avg("pz").alias("level"))
    structured = (F.col("range") > 0) & (F.col("sill") > F.col("nugget"))
    status = (
        F.when(F.col("points") < 3, "too few points")
        .when(F.coalesce(structured, F.lit(False)), "ok")
        .otherwise("no spatial structure")
    )
    groups = settle(attach(sizes, models, keys).withColumn("status", status), "groups")
    reach = F.least(F.ceil(F.col("range") / cell), F.lit(halo)).cast("long")

    def homes(at: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(at) - reach) / tile), F.floor((F.col(at) + reach) / tile)))

    ok = groups.where("status = 'ok'").select(*keys, *_MODEL)
    shared = (
        join_on(cells, ok, keys, "inner")
        .withColumn("tx", homes("cx"))
        .withColumn("ty", homes("cy"))
        .groupBy(*keys, "tx", "ty", *_MODEL)
        .agg(F.array_sort(F.collect_list(F.struct("px", "py", "pz"))).alias("cells"))
    )
    names = [*keys, "tx", "ty"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("cells", *_MODEL))
            solved = [_solve(*r) for r in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array([mean for mean, _ in solved], pa.float64()),
                    pa.array([weights for _, weights in solved], _WEIGHTS),
                ],
                [*names, "mean", "weights"],
            )

    kinds = [f"`{k}` {shared.schema[k].dataType.simpleString()}" for k in names]
    schema = ", ".join([*kinds, "mean double, weights array<struct<x: double, y: double, w: double>>"])
    return Kriging(keys, cells, groups, settle(shared.mapInArrow(solve, schema), "tiles"), cell, tile)
