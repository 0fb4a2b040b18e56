"""Effect curves: what a fitted model says along one variable, with bounds."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.operators.keys import attach
from brackish.operators.regression import Factors, Model, _fits


def effect_curves(
    df: DataFrame,
    fitted: DataFrame,
    keys: Sequence[str],
    model: Model,
    x: str,
    by: str | None = None,
    factors: Factors | None = None,
    points: int = 200,
    confidence: float = 0.95,
) -> DataFrame:
    """Per key and slice: ``slice, point, x, estimate, std_error, lower, upper`` on an even grid over
    the key's own range of `x`.

    `by` names a variable that takes several values: a number is held at its mean less one standard
    deviation, its mean, and its mean plus one; a factor at each of its levels. Other numbers are at
    their mean, other factors at their first level. The bounds come from the covariance of the
    coefficients; a coefficient that was left out as aliased counts as zero and certain. Means and
    ranges are those of the complete rows, in one aggregation; a curve is expanded from one row.
    """
    factors = factors or {}
    variables = list(dict.fromkeys(v for term in model.terms for v in term.split(":")))
    if x not in variables or x in factors:
        raise ValueError(f"{x} is not a numeric variable of the model")
    numbers = [v for v in variables if v not in factors and v != x]
    full = df.dropna(subset=[*variables, model.response])
    settings = full.groupBy(*keys).agg(
        F.min(F.col(x).cast("double")).alias("_low"),
        F.max(F.col(x).cast("double")).alias("_high"),
        *[F.avg(v).alias(f"_mean_{v}") for v in numbers],
        *([F.stddev_samp(by).alias("_spread")] if by in numbers else []),
    )
    mine = _fits(fitted).where(F.col("dependent") == model.response)
    mine = mine.select(*keys, F.col("terms.estimate").alias("_b"), F.col("vcov").alias("_v"))
    rows = attach(mine, settings, keys)

    def at_slice(name: str, value: Column | None, level: str | None) -> Column:
        """Each coefficient's column of the design, as a line ``fixed + slope * x``."""
        fixed, slopes = [F.lit(1.0)], [F.lit(0.0)]
        for term in model.terms:
            parts = term.split(":")
            for levels in itertools.product(*[factors[v][1:] if v in factors else (None,) for v in parts]):
                product = F.lit(1.0)
                for v, wanted in zip(parts, levels):
                    if v in factors:
                        held = level if v == by else factors[v][0]
                        product = product * F.lit(float(held == wanted))
                    elif v != x:
                        product = product * (value if v == by and value is not None else F.col(f"_mean_{v}"))
                fixed.append(F.lit(0.0) if x in parts else product)
                slopes.append(product if x in parts else F.lit(0.0))
        return F.struct(F.lit(name).alias("slice"), F.array(*fixed).alias("_fixed"), F.array(*slopes).alias("_slopes"))

    if by is None:
        slices = [at_slice("mean", None, None)]
    elif by in factors:
        slices = [at_slice(level, None, level) for level in factors[by]]
    else:
        mean, spread = F.col(f"_mean_{by}"), F.col("_spread")
        slices = [at_slice(n, mean + k * spread, None) for n, k in (("mean-sd", -1), ("mean", 0), ("mean+sd", 1))]

    def dot(a: Column, b: Column) -> Column:
        terms = F.zip_with(a, b, lambda u, v: u * F.coalesce(v, F.lit(0.0)))
        return F.aggregate(terms, F.lit(0.0), lambda total, v: total + v)

    size = F.size("_b")
    place = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("point") / (points - 1)
    sliced = rows.select(*keys, "_low", "_high", "_b", "_v", F.inline(F.array(*slices)))
    grid = (
        sliced.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("_x", place)
        .withColumn("_line", F.zip_with("_fixed", "_slopes", lambda a, b: a + b * F.col("_x")))
        .withColumn("_left", F.transform("_line", lambda v, i: v * dot(F.col("_line"), F.slice("_v", i * size + 1, size))))
        .withColumn("estimate", dot(F.col("_line"), F.col("_b")))
        .withColumn("std_error", F.sqrt(F.greatest(F.aggregate("_left", F.lit(0.0), lambda a, b: a + b), F.lit(0.0))))
    )
    reach = NormalDist().inv_cdf(0.5 + confidence / 2) * F.col("std_error")
    return grid.select(
        *keys,
        "slice",
        "point",
        F.col("_x").alias(x),
        "estimate",
        "std_error",
        (F.col("estimate") - reach).alias("lower"),
        (F.col("estimate") + reach).alias("upper"),
    )
