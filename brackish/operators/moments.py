"""Means and covariances of many columns per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups a task keeps at once; it hands their moments on when there are more.
HELD = 4096


def pairs(size: int) -> list[tuple[int, int]]:
    """Upper triangle of a symmetric matrix, row by row."""
    return [(i, j) for i in range(size) for j in range(i, size)]


def cross_moments(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    weight: str | None = None,
    wanted: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """Per key: ``n``, ``total`` (weights, or n), ``mean`` and population ``cov`` over complete rows.

    ``cov`` holds the `wanted` column pairs, by default the whole upper triangle.

    One pass: a task turns the rows of a group in each batch into one matrix of central moments
    and merges it with what it has; a row per task and group is shuffled, and those are merged in
    turn. Central moments merge exactly however far groups lie from each other or from zero, and a
    hot key costs one small row per task. Sums over columns are matrix products, so many columns
    cost no wide generated code. Without rows there is no row.
    """
    wanted = pairs(len(columns)) if wanted is None else list(wanted)
    values = F.array(*[F.col(c).cast("double") for c in columns]).alias("_values")
    weights = [F.col(weight).cast("double").alias("_weight")] if weight else []
    # one array column: many columns that may not be NULL would each be a constraint to the optimizer
    full = df.select(*keys, values, *weights).where(F.forall("_values", lambda v: v.isNotNull()))
    full = full.dropna(subset=["_weight"]) if weight else full
    kinds = [f"`{k}` {full.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, "n bigint, total double, mean array<double>, cov array<double>"])
    rule = dict(keys=list(keys), wanted=wanted, most=HELD)
    parts = full.mapInArrow(partial(_of_rows, weighted=weight is not None, **rule), schema)
    if not keys:
        return parts.repartition(1).mapInArrow(partial(_merged, **rule), schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(partial(_merged, **rule), schema)


def _merge(total: np.ndarray, mean: np.ndarray, cross: np.ndarray, wanted: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Moments of several sets of rows together. `cross` holds sums of products around each mean."""
    weight = total.sum()
    centre = (total[:, None] * mean).sum(0) / weight if weight else mean.mean(0)
    away = mean - centre
    return weight, centre, cross.sum(0) + (total[:, None] * away[:, wanted[:, 0]] * away[:, wanted[:, 1]]).sum(0)


class _Groups:
    """Moments by key, in the order in which the keys were last met."""

    def __init__(self, wanted: Sequence[tuple[int, int]]):
        self.wanted = np.array(wanted, int).reshape(-1, 2)
        self.held: dict[tuple, list] = {}

    def add(self, key: tuple, n: int, total: np.ndarray, mean: np.ndarray, cross: np.ndarray) -> None:
        """Add sets of rows, one per entry of the arrays. NaN is one key."""
        name = tuple("NaN" if v != v else v for v in key)
        old = self.held.pop(name, None)  # comes last again
        if old is not None:
            n += old[1]
            total, mean, cross = (np.concatenate((a[None], b)) for a, b in zip(old[2:], (total, mean, cross)))
        if len(total) > 1:
            merged = _merge(total, mean, cross, self.wanted)
        else:
            merged = total[0], mean[0], cross[0]
        self.held[name] = [key, n, np.float64(merged[0]), merged[1], merged[2]]

    def take(self, kinds: Sequence[pa.Field], last: int = 0) -> pa.RecordBatch:
        """All groups but the `last` ones, as rows whose ``cov`` are sums of products."""
        names = list(self.held)[: len(self.held) - last]
        rows = [self.held.pop(name) for name in names]
        arrays = [pa.array([r[0][i] for r in rows], f.type) for i, f in enumerate(kinds)]
        arrays += [pa.array([r[1] for r in rows], pa.int64()), pa.array([float(r[2]) for r in rows], pa.float64())]
        arrays += [pa.array([r[k].tolist() for r in rows], pa.list_(pa.float64())) for k in (3, 4)]
        return pa.RecordBatch.from_arrays(arrays, [*[f.name for f in kinds], "n", "total", "mean", "cov"])


def _runs(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each key starts in it."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        own = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    return order, np.flatnonzero(np.diff(code[order], prepend=-1))


def _of_rows(
    batches: Iterator[pa.RecordBatch],
    keys: list[str],
    weighted: bool,
    wanted: list[tuple[int, int]],
    most: int,
) -> Iterator[pa.RecordBatch]:
    """A row of partial moments per key of the task."""
    groups, kinds = _Groups(wanted), []
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds = [batch.schema.field(k) for k in keys]
        order, starts = _runs(batch, keys)
        table = batch.column("_values").flatten().to_numpy().reshape(batch.num_rows, -1)[order]
        w = batch.column("_weight").to_numpy()[order] if weighted else None
        names = batch.select(keys).take(pa.array(order[starts])).to_pylist() if keys else [{}]
        at = groups.wanted
        for name, low, high in zip(names, starts, [*starts[1:], batch.num_rows]):
            x = table[low:high]
            own = w[low:high] if weighted else None
            total = float(own.sum()) if weighted else float(high - low)
            mean = (own @ x) / total if weighted and total else x.mean(0)
            away = x - mean
            cross = ((away * own[:, None]).T if weighted else away.T) @ away
            groups.add(tuple(name.values()), int(high - low), np.array([total]), mean[None], cross[at[:, 0], at[:, 1]][None])
        if len(groups.held) > most:
            yield groups.take(kinds)
    if groups.held:
        yield groups.take(kinds)


def _merged(
    batches: Iterator[pa.RecordBatch], keys: list[str], wanted: list[tuple[int, int]], most: int
) -> Iterator[pa.RecordBatch]:
    """Partial moments in order of the keys become one row per key."""
    groups, kinds = _Groups(wanted), []

    def out(last: int) -> pa.RecordBatch:
        done = groups.take(kinds, last)
        sums = done.column("cov").flatten().to_numpy().reshape(done.num_rows, -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = sums / done.column("total").to_numpy()[:, None]
        return done.set_column(len(keys) + 3, "cov", pa.array(cov.tolist(), pa.list_(pa.float64())))

    for batch in batches:
        if not batch.num_rows:
            continue
        kinds = [batch.schema.field(k) for k in keys]
        order, starts = _runs(batch, keys)
        batch = batch.take(pa.array(order))
        names = batch.select(keys).take(pa.array(starts)).to_pylist() if keys else [{}]
        n, total = (batch.column(c).to_numpy() for c in ("n", "total"))
        mean, cross = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("mean", "cov"))
        for name, low, high in zip(names, starts, [*starts[1:], batch.num_rows]):
            groups.add(tuple(name.values()), int(n[low:high].sum()), total[low:high], mean[low:high], cross[low:high])
        if len(groups.held) > max(most, len(starts)):
            # any of this batch's keys may be the one that goes on in the next
            yield out(len(starts))
    if groups.held:
        yield out(0)


def squares(values: Sequence[Sequence[float]], size: int, at: Sequence[tuple[int, int]] | None = None) -> np.ndarray:
    """Full symmetric matrices from their listed entries, one per row of `values`."""
    out = np.full((len(values), size, size), np.nan)
    if len(values):
        table = np.array(values, dtype=float)
        for k, (i, j) in enumerate(pairs(size) if at is None else at):
            out[:, i, j] = out[:, j, i] = table[:, k]
    return out
