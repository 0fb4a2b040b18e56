"""Grouped summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from brackish.functions.nulls import strict
from brackish.functions.summary import range_label
from brackish.functions.times import floor_time
from brackish.operators.keys import attach, join_on
from brackish.operators.ordered import exact_quantiles
from brackish.session import settle

Aggregate = Callable[[Column], Column]


def summarise(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    functions: Mapping[str, Aggregate],
    strict_nulls: bool = False,
) -> DataFrame:
    """Every function on every column, named ``column_function``."""
    apply = (lambda f, c: strict(f, c)) if strict_nulls else (lambda f, c: f(c))
    return df.groupBy(*keys).agg(
        *[apply(f, F.col(c)).alias(f"{c}_{n}") for c in columns for n, f in functions.items()]
    )


def time_mean(
    df: DataFrame, keys: Sequence[str], time: str, value: str, unit: str = "hour", name: str = "mean"
) -> DataFrame:
    """Mean per key and calendar unit."""
    return df.groupBy(*keys, floor_time(F.col(time), unit).alias(time)).agg(F.avg(value).alias(name))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in exclude]


def sum_numeric(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of every numeric column per key."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numeric_columns(df, keys)])


def row_shares(df: DataFrame, columns: Sequence[str], total: str = "total") -> DataFrame:
    """Row total over `columns`, and each column as percent of it."""
    with_total = df.withColumn(total, reduce(add, [F.col(c) for c in columns]))
    return with_total.withColumns({c: F.try_divide(F.col(c), F.col(total)) * 100 for c in columns})


def range_table(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], units: Mapping[str, str] | None = None
) -> DataFrame:
    """Long table of rounded minimum and maximum with a ``[min - max unit]`` label.

    Aggregates the wide rows and reshapes the small result, so the data is not unpivoted.
    """
    units = units or {}
    low_high = df.groupBy(*keys).agg(
        *[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in columns]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("name"),
                F.round(F.col(c)["low"], 2).alias("min"),
                F.round(F.col(c)["high"], 2).alias("max"),
                F.lit(units.get(c, "")).alias("unit"),
            )
            for c in columns
        ]
    )
    return (
        low_high.select(*keys, F.inline(entries))
        .where(F.col("min").isNotNull())
        .withColumn("range", range_label(F.col("min"), F.col("max"), F.col("unit")))
    )


def at_latest(df: DataFrame, time: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows at the table's (or each key's) latest time."""
    if not keys:
        return df.where(F.col(time) == df.select(F.max(time)).scalar())
    newest = df.groupBy(*keys).agg(F.max(time).alias(time))
    return join_on(df, settle(newest), [*keys, time], "left_semi")


def box_stats(df: DataFrame, keys: Sequence[str], value: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends (furthest value within `whisker` spans of the box), outlier count.

    The quartiles are selected, not sorted; the rest is one more aggregation that combines map-side.
    """
    known = df.select(*keys, value).where(F.col(value).isNotNull())
    quartiles = exact_quantiles(known, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    v, reach = F.col(value), whisker * (F.col("q3") - F.col("q1"))
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        attach(known, quartiles, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(inside, v)).alias("lower"),
            F.first("q1").alias("q1"),
            F.first("median").alias("median"),
            F.first("q3").alias("q3"),
            F.max(F.when(inside, v)).alias("upper"),
            F.count_if(~inside).alias("outliers"),
        )
    )
