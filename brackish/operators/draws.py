"""Summaries over draws of a model's parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brackish.operators.keys import attach
from brackish.operators.ordered import CHUNK_ROWS, exact_quantiles, quantiles_of_counts, value_counts
from brackish.operators.scaling import unstandardise
from brackish.session import settle


def shortest_interval(df: DataFrame, keys: Sequence[str], value: str, mass: float = 0.95) -> DataFrame:
    """Median and the narrowest interval holding `mass` of the draws, per key.

    Candidates pair sorted draw i with draw i + floor(n * mass). Of equal draws only the first
    can begin the narrowest interval, so there is one candidate per distinct value; its partner is
    looked up by position, in chunks of positions. ``sig`` says whether both ends share a sign.
    """
    counts = settle(value_counts(df, keys, value), "counts")
    sizes = settle(counts.groupBy(*keys).agg(F.sum("count").alias("n")))
    ranked = attach(counts, sizes, keys).withColumn("_k", F.floor(F.col("n") * F.lit(mass)))
    first, target = F.col("before"), F.col("before") + F.col("_k")
    # a value stands at its first position in every chunk that its draws reach
    homes = F.sequence(F.floor(first / CHUNK_ROWS), F.floor((first + F.col("count") - 1) / CHUNK_ROWS))
    stands = ranked.select(*keys, value, "before", F.explode(homes).alias("_chunk")).select(
        *keys, "_chunk", F.greatest("before", F.col("_chunk") * CHUNK_ROWS).alias("_at"), F.col(value).alias("upper"), F.lit(None).cast(df.schema[value].dataType).alias("lower")
    )
    sought = ranked.where(target < F.col("n")).select(
        *keys, F.floor(target / CHUNK_ROWS).alias("_chunk"), target.alias("_at"), F.lit(None).cast(df.schema[value].dataType).alias("upper"), F.col(value).alias("lower")
    )
    # at equal positions the value comes before the candidates that look for it
    order = Window.partitionBy(*keys, "_chunk").orderBy("_at", F.col("upper").isNull())
    met = stands.unionByName(sought).withColumn("upper", F.last("upper", ignorenulls=True).over(order)).where("lower IS NOT NULL")
    best = met.groupBy(*keys).agg(
        F.min_by(F.struct("lower", "upper"), F.struct(F.col("upper") - F.col("lower"), F.col("lower"))).alias("_best")
    )
    median = quantiles_of_counts(counts, keys, value, {"median": 0.5})
    out = attach(attach(sizes, median, keys), best.select(*keys, "_best.*"), keys)
    same = F.signum("lower") == F.signum("upper")
    return out.withColumn("sig", F.when(same, "yes").when(same.isNotNull(), "no"))


def residual_summary(
    df: DataFrame, draws: DataFrame, response: str, predictors: Mapping[str, str], intercept: str
) -> DataFrame:
    """Mean and deviation, over all draws, of each row's residual.

    A residual is linear in the drawn coefficients, so its mean and variance follow from
    the draws' mean vector and covariance matrix: one aggregation of the draws instead of
    a row for every (row, draw) pair. `predictors` maps a draw column to a data column.
    """
    names = [intercept, *predictors]
    order = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    moments = draws.dropna(subset=names).agg(
        *[F.avg(a).alias(f"_m_{a}") for a in names],
        *[F.covar_samp(a, b).alias(f"_c_{a}_{b}") for a, b in order],
    )
    at = {intercept: F.lit(1.0), **{d: F.col(c) for d, c in predictors.items()}}
    fitted = sum((F.col(f"_m_{a}") * at[a] for a in names), F.lit(0.0))
    variance = sum(
        (F.col(f"_c_{a}_{b}") * at[a] * at[b] * (1 if a == b else 2) for a, b in order), F.lit(0.0)
    )
    return (
        attach(df, moments, [])
        .withColumns(
            {"resid": F.col(response) - fitted, "resid_sd": F.sqrt(F.greatest(variance, F.lit(0.0)))}
        )
        .drop(*moments.columns)
    )


def expected_band(
    draws: DataFrame,
    intercept: str,
    axes: Mapping[str, tuple[str, Sequence[float]]],
    by: str,
    probabilities: Mapping[str, float],
) -> DataFrame:
    """Quantiles of the expected value over draws along the axis `by`, pooled over the others.

    `axes` maps an axis name to its draw column and grid values. Each draw is expanded by
    the literal grid in place; the quantiles are taken on range-sorted rows.
    """
    grid = draws.dropna(subset=[intercept, *[c for c, _ in axes.values()]])
    for name, (_, values) in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    mean = sum((F.col(c) * F.col(n) for n, (c, _) in axes.items()), F.col(intercept))
    return exact_quantiles(grid.select(by, mean.alias("expected")), [by], "expected", probabilities)


def effect_curve(
    lines: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    stats: DataFrame | None = None,
    x: str = "x",
    y: str = "y",
    points: int = 200,
) -> DataFrame:
    """Fitted line on an even grid over each key's own range, in original units if `stats` is given.

    `lines` holds ``intercept, slope``; `spans` holds ``low, high`` of the predictor.
    """
    step = F.col("_i") / (points - 1)
    curve = (
        attach(lines.select(*keys, "intercept", "slope"), spans, keys)
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn(x, F.col("low") + (F.col("high") - F.col("low")) * step)
        .withColumn(y, F.col("intercept") + F.col("slope") * F.col(x))
        .select(*keys, F.col("_i").alias("point"), x, y)
    )
    if stats is None:
        return curve
    return unstandardise(curve, {x: x, y: y}, stats, suffix="").select(*keys, "point", x, y)
