"""Principal components per group, from one aggregation of the rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.operators.keys import attach
from brackish.operators.moments import cross_moments, squares
from brackish.operators.reshape import relabel

_PCA_DDL = "n bigint, center array<double>, scale array<double>, sdev array<double>, rotation array<array<double>>"


def fit_pca(df: DataFrame, keys: Sequence[str], columns: Sequence[str], scaled: bool = True) -> DataFrame:
    """One row per key: centre, scale, component standard deviations, rotation (component major).

    Uses complete rows. A component's sign is set so that its largest loading is positive.
    """
    internal = [f"_x{i}" for i in range(len(columns))]
    rows = df.select(*keys, *[F.col(c).cast("double").alias(i) for c, i in zip(columns, internal)])
    moments = cross_moments(rows, keys, internal).where(F.col("n") > 1)
    key_list, size = list(keys), len(columns)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = pa.list_(pa.float64())
        for batch in batches:
            n = np.array(batch.column("n").to_pylist(), dtype=float)
            matrix = squares(batch.column("cov").to_pylist(), size) * (n / (n - 1.0))[:, None, None]
            sd = np.sqrt(matrix[:, range(size), range(size)])
            scale = np.where(sd > 0, sd, 1.0) if scaled else np.ones_like(sd)
            values, vectors = np.linalg.eigh(matrix / (scale[:, :, None] * scale[:, None, :]))
            components = vectors.transpose(0, 2, 1)[:, ::-1]
            largest = np.abs(components).round(9).argmax(axis=2)
            signs = np.sign(np.take_along_axis(components, largest[:, :, None], axis=2))
            sdev = np.sqrt(np.maximum(values[:, ::-1], 0.0))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k) for k in key_list],
                    batch.column("n"),
                    batch.column("mean"),
                    pa.array(scale.tolist(), vector),
                    pa.array(sdev.tolist(), vector),
                    pa.array((components * signs).tolist(), pa.list_(vector)),
                ],
                names=[*key_list, "n", "center", "scale", "sdev", "rotation"],
            )

    ddl = ", ".join([f"`{k}` {moments.schema[k].dataType.simpleString()}" for k in key_list] + [_PCA_DDL])
    return moments.mapInArrow(solve, ddl)


def percent_explained(model: DataFrame, keys: Sequence[str], digits: int = 1) -> DataFrame:
    """Share of each component in the sum of standard deviations (not variances), in percent."""
    total = F.aggregate("sdev", F.lit(0.0), lambda a, b: a + b)
    return model.select(*keys, F.posexplode("sdev").alias("_i", "sdev"), total.alias("_t")).select(
        *keys,
        (F.col("_i") + 1).alias("component"),
        "sdev",
        F.round(100 * F.col("sdev") / F.col("_t"), digits).alias("percent"),
    )


def loadings(
    model: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    components: int = 2,
    groups: Mapping[str, str] | None = None,
    nice_names: Mapping[str, str] | None = None,
) -> DataFrame:
    """``label, PC1, PC2, ...`` per key, with an optional group and display name per label."""
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"),
                *[F.col("rotation")[k][i].alias(f"PC{k + 1}") for k in range(components)],
            )
            for i, c in enumerate(columns)
        ]
    )
    table = model.select(*keys, F.inline(entries))
    if groups is not None:
        table = table.withColumn("label_group", relabel(F.col("label"), groups, F.lit(None).cast("string")))
    if nice_names is not None:
        table = table.withColumn("nice_name", relabel(F.col("label"), nice_names))
    return table


def scores(df: DataFrame, model: DataFrame, keys: Sequence[str], columns: Sequence[str], components: int = 2) -> DataFrame:
    """Component scores on every complete row, beside the row's own columns."""
    full = attach(df.dropna(subset=list(columns)), model.select(*keys, "center", "scale", "rotation"), keys)
    away = F.transform(F.array(*[F.col(c).cast("double") for c in columns]), lambda v, i: (v - F.col("center")[i]) / F.col("scale")[i])
    named = {}
    for k in range(components):
        shares = F.zip_with("_away", F.col("rotation")[k], lambda v, r: v * r)
        named[f"PC{k + 1}"] = F.aggregate(shares, F.lit(0.0), lambda total, v: total + v)
    return full.withColumn("_away", away).withColumns(named).drop("center", "scale", "rotation", "_away")
