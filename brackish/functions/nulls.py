"""Missing-value rules: strict and tolerant forms of casts, clamps and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict(agg: Callable[[Column], Column], col: Column) -> Column:
    """Aggregate that is NULL as soon as the group holds one NULL."""
    return F.when(F.count(col) == F.count(F.lit(1)), agg(col))


def to_number(col: Column) -> Column:
    """Text to double; anything that is not a number becomes NULL."""
    return F.trim(col.cast("string")).try_cast("double")


def null_if(col: Column, sentinel) -> Column:
    return F.nullif(col, F.lit(sentinel))


def clamp_below(col: Column, floor: float = 0.0) -> Column:
    """Raise values under `floor` to it; NULL stays NULL (``greatest`` would drop it)."""
    return F.when(col < floor, F.lit(floor)).otherwise(col)


def safe_divide(num: Column, den: Column) -> Column:
    """NULL on a zero denominator, also in ANSI mode."""
    return F.try_divide(num, den)


def log_offset(col: Column, offset: float = 0.0) -> Column:
    """Natural log after adding `offset`; NULL where the argument is not positive."""
    return F.ln(col + F.lit(offset)) if offset else F.ln(col)
