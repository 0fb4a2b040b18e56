"""Aggregate columns for use inside ``groupBy().agg``; all combine map-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brackish.functions.nulls import safe_divide


def spread(col: Column) -> Column:
    """max - min."""
    return F.max(col) - F.min(col)


def cv(col: Column) -> Column:
    """Standard deviation over mean."""
    return safe_divide(F.stddev_samp(col), F.avg(col))


def var_over_mean(col: Column) -> Column:
    return safe_divide(F.var_samp(col), F.avg(col))


def std_error(col: Column) -> Column:
    return safe_divide(F.stddev_samp(col), F.sqrt(F.count(col)))


def weighted_mean(value: Column, weight: Column) -> Column:
    both = value.isNotNull() & weight.isNotNull()
    return safe_divide(F.sum(F.when(both, value * weight)), F.sum(F.when(both, weight)))


def range_label(low: Column, high: Column, unit: Column | str = "") -> Column:
    """``[1.20 - 3.45 psu]``."""
    unit = F.lit(unit) if isinstance(unit, str) else unit
    return F.concat(
        F.lit("["), F.format_string("%.2f", low), F.lit(" - "), F.format_string("%.2f", high), unit, F.lit("]")
    )
