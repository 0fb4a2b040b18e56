"""Key helpers shared by joins and grouped operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.session import settle


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns both sides have, in the left side's order."""
    names = set(right.columns)
    return [c for c in left.columns if c in names]


def join_on(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Equi-join in which NULL keys match each other; one copy of each key is kept.

    Other columns that both sides have get the `suffixes`.

    No side is broadcast by hint: the planner broadcasts a side whose known size is under
    the session's threshold and otherwise sorts, splitting hot keys at run time.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("a join needs at least one key")
    if how not in ("left_semi", "left_anti"):
        both = [c for c in right.columns if c in left.columns and c not in keys]
        left, right = (df.withColumnsRenamed({c: c + end for c in both}) for df, end in zip((left, right), suffixes))
    marked = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(marked, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("right", "right_outer"):
        kept = {k: F.col(f"_r_{k}").alias(k) for k in keys}
    elif how in ("full", "outer", "full_outer"):
        kept = {k: F.coalesce(k, f"_r_{k}").alias(k) for k in keys}
    else:
        kept = {k: F.col(k) for k in keys}
    extra = [c for c in right.columns if c not in keys]
    return joined.select(*[kept.get(c, F.col(c)) for c in left.columns], *extra)


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring one-row-per-group statistics back to the detail rows.

    The statistics are settled first, so their size is known when the join is planned. Without
    keys `stats` has one row, read as a scalar subquery instead of a join.
    """
    if keys:
        return join_on(df, settle(stats), keys, "left")
    names = stats.columns
    one = stats.select(F.struct(*names).alias("_s")).scalar()
    return df.withColumn("_s", one).select(*df.columns, *[F.col("_s")[n].alias(n) for n in names])
