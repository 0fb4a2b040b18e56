"""Stacking, long/wide, nesting, regular time grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.functions.times import epoch_micros
from brackish.operators.keys import join_on

# Rows of one key's time grid made by one task.
GRID_BLOCK = 10_000


def stack(*tables: DataFrame) -> DataFrame:
    """Append tables; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def to_long(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], names_to: str = "name", values_to: str = "value"
) -> DataFrame:
    return df.unpivot(list(keys), list(columns), names_to, values_to)


def to_wide(
    df: DataFrame, keys: Sequence[str], names_from: str, values_from: str, names: Sequence, agg=F.first
) -> DataFrame:
    """One column per name in `names`; naming them saves a pass to discover them."""
    return df.groupBy(*keys).pivot(names_from, list(names)).agg(agg(values_from))


def to_wide_many(
    df: DataFrame, keys: Sequence[str], names_from: str, values_from: Sequence[str], names: Sequence, agg=F.first
) -> DataFrame:
    """Several value columns at once, named ``{value}_{name}``."""
    wide = df.groupBy(*keys).pivot(names_from, list(names)).agg(*[agg(v).alias(v) for v in values_from])
    if len(values_from) == 1:
        return wide.withColumnsRenamed({str(n): f"{values_from[0]}_{n}" for n in names})
    return wide.withColumnsRenamed({f"{n}_{v}": f"{v}_{n}" for n in names for v in values_from})


def hours_to_rows(df: DataFrame, day: str, values_to: str, time: str = "date") -> DataFrame:
    """Day x hour matrix (``00h`` ... ``23h``) to one row per hour."""
    hours = [f"{h:02d}h" for h in range(24)]
    long = df.select(day, *[F.col(h).cast("string").alias(h) for h in hours]).unpivot(
        [day], hours, "_hour", "_text"
    )
    moment = F.try_to_timestamp(F.concat_ws(" ", day, "_hour"), F.lit("dd.MM.yyyy HH'h'"))
    return long.select(
        moment.cast("timestamp_ntz").alias(time), F.trim("_text").try_cast("double").alias(values_to)
    )


def nest(
    df: DataFrame, keys: Sequence[str], within: Sequence[str], name: str = "data", **measures: Column
) -> DataFrame:
    """One row per key holding an array of summarised rows, one per `within` value.

    The rows are aggregated first: the array grows with the number of distinct `within`
    values (hours, terms, parameters), not with the data.
    """
    rows = df.groupBy(*keys, *within).agg(*[c.alias(n) for n, c in measures.items()])
    entry = F.struct(*within, *measures)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias(name))


def unnest(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], F.inline(name))


def split_name(df: DataFrame, column: str, into: Sequence[str], sep: str = "_") -> DataFrame:
    """Split a label into named parts; missing parts are NULL."""
    parts = F.split(F.col(column), sep)
    return df.withColumns({n: F.try_element_at(parts, F.lit(i + 1)) for i, n in enumerate(into)}).drop(column)


def rank_levels(df: DataFrame, column: str, levels: Sequence[str], name: str) -> DataFrame:
    """Ordinal of a category in a declared order; values outside it are NULL."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column)).cast("int")
    return df.withColumn(name, F.when(position > 0, position))


def relabel(column: Column, labels: Mapping[str, str], default: Column | None = None) -> Column:
    """Replace values by a literal label table; the table travels in the plan, so no join."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    found = F.try_element_at(table, column)
    return F.coalesce(found, column if default is None else default)


def time_grid(df: DataFrame, keys: Sequence[str], time: str, step_seconds: int | Mapping[str, int]) -> DataFrame:
    """Every step from each key's first to last time.

    `step_seconds` is one step, or steps by the value of the last key column. Long
    series are cut into blocks that are spread over tasks before they are expanded.
    """
    if isinstance(step_seconds, Mapping):
        step = relabel(
            F.col(keys[-1]), {k: str(v) for k, v in step_seconds.items()}, F.lit(None).cast("string")
        ).cast("bigint")
    else:
        step = F.lit(step_seconds).cast("bigint")
    spans = df.groupBy(*keys).agg(
        epoch_micros(F.min(time)).alias("_start"), epoch_micros(F.max(time)).alias("_stop")
    )
    blocks = (
        spans.withColumn("_step", step * 1_000_000)
        .withColumn("_steps", F.floor((F.col("_stop") - F.col("_start")) / F.col("_step")))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor(F.col("_steps") / GRID_BLOCK))))
        .repartition(*keys, "_block")
    )
    first = F.col("_block") * GRID_BLOCK
    last = F.least(first + GRID_BLOCK - 1, F.col("_steps"))
    return blocks.withColumn("_i", F.explode(F.sequence(first, last))).select(
        *keys,
        F.timestamp_micros(F.col("_start") + F.col("_i") * F.col("_step")).cast("timestamp_ntz").alias(time),
    )


def fill_grid(df: DataFrame, keys: Sequence[str], time: str, step_seconds: int | Mapping[str, int]) -> DataFrame:
    """Put a series on a regular grid: missing steps become NULL rows, rows off the grid stay."""
    return join_on(time_grid(df, keys, time, step_seconds), df, [*keys, time], "full")
