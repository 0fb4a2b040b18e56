"""Column selection, moving, renaming, and the same expression over many columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from `first` to `last` in schema order."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def relocate(df: DataFrame, columns: Sequence[str], before: str | None = None, after: str | None = None) -> DataFrame:
    """Move columns before or after another one (to the front by default)."""
    rest = [c for c in df.columns if c not in columns]
    at = rest.index(before) if before else rest.index(after) + 1 if after else 0
    return df.select(*rest[:at], *columns, *rest[at:])


def add_suffix(df: DataFrame, columns: Sequence[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in columns})


def across(df: DataFrame, columns: Sequence[str], function: Callable[[Column], Column], suffix: str = "") -> DataFrame:
    """Apply one function to many columns, replacing them or adding suffixed ones."""
    return df.withColumns({f"{c}{suffix}": function(F.col(c)) for c in columns})


def bin_by_edges(column: Column, edges: Sequence[float], labels: Sequence[str], right_closed: bool = True) -> Column:
    """Label of the interval a number falls in; `labels` has one entry more than `edges`."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one label more than edges")
    out = F.when(column.isNotNull(), labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        below = column <= edge if right_closed else column < edge
        out = F.when(below, label).otherwise(out)
    return out
