"""Joins: natural, full-outer chains, anti, nearest time, aggregate-and-return."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackish.functions.times import epoch_micros
from brackish.operators.keys import attach, join_on, shared_columns
from brackish.session import settle


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on every column both tables have; NULL keys match."""
    return join_on(left, right, shared_columns(left, right), how)


def natural_left_chain(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Left joins in turn. With the same keys throughout, `first` is shuffled once."""
    return reduce(natural_join, others, first)


def natural_full_chain(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Full outer joins in turn, keys coalesced."""
    return reduce(lambda a, b: natural_join(a, b, "full"), others, first)


def align_outer(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer alignment of tables that each hold a key at most once.

    Same rows as `natural_full_chain` on `keys`, but one shuffle for any number of
    tables: the rows are stacked and merged per key, combined map-side.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])


def drop_listed(df: DataFrame, bad: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anti join on a key, NULLs matching; rows of `bad` are reduced to their keys first."""
    return join_on(df, settle(bad.select(*keys).distinct()), keys, "left_anti")


def keep_matches(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join whose unmatched rows are dropped, as one inner join."""
    return join_on(left, right, keys, "inner")


def join_rounded(left: DataFrame, right: DataFrame, rounded: Column, key: str, how: str = "left") -> DataFrame:
    """Equi-join after deriving the left key from a rounding expression."""
    return join_on(left.withColumn(key, rounded), right, [key], how)


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Group statistics on every detail row: aggregate, then join back.

    Unlike a window, the aggregate combines map-side and the join can split a hot key.
    """
    table = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return attach(df, table, keys)


def self_reference(
    df: DataFrame, where: Column, keys: Sequence[str], columns: Mapping[str, str], how: str = "left"
) -> DataFrame:
    """Give each row the values of the reference rows sharing its keys (`columns`: new name -> source)."""
    reference = df.where(where).select(*keys, *[F.col(old).alias(new) for new, old in columns.items()])
    return join_on(df, reference, keys, how)


def offset_join(
    left: DataFrame, right: DataFrame, time: str, offset: str, keys: Sequence[str] = (), how: str = "left"
) -> DataFrame:
    """Join two loggers whose clocks differ by a constant interval, e.g. ``"3 minutes"``."""
    moved = right.withColumn(time, F.col(time) + F.expr(f"INTERVAL {offset}"))
    return join_on(left, moved, [*keys, time], how)


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    time: str,
    tolerance_seconds: float,
    keys: Sequence[str] = (),
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Give each left row the right row nearest in time within a tolerance, per key.

    Adds the right side's other columns and ``time_gap`` (right minus left, seconds). Of
    two equally near rows the earlier wins; of right rows at one instant the first by
    `tie_break`, so name columns that tell them apart.

    The match depends on (keys, time) only, so it is found once per distinct instant and
    joined back: repeated stamps, however many, are one row in the search. Instants and right
    rows are merged in ranges of (key, time) that Spark balances by count, so a busy hour is
    spread over tasks; each range gets the last right row before it and the first one after
    it from a table of one row per range and key. It never forms pairs.
    """
    keys = list(keys)
    tolerance = int(tolerance_seconds * 1e6)
    payload = [c for c in right.columns if c not in (*keys, time)]

    probes = left.select(*keys, time).where(F.col(time).isNotNull()).distinct()
    order = F.struct(*tie_break) if tie_break else F.struct(*payload)
    targets = (
        right.where(F.col(time).isNotNull())
        .groupBy(*keys, F.col(time).alias("_rt"))
        .agg(F.min_by(F.struct(*payload), order).alias("_row"))
        .withColumn("_t", epoch_micros(F.col("_rt")))
        .drop("_rt")
    )
    merged = merge_ranges(probes.withColumn("_t", epoch_micros(F.col(time))), targets, keys, "_t")
    gap_back, gap_ahead = F.col("_t") - F.col("_back._t"), F.col("_ahead._t") - F.col("_t")
    best = F.when(
        gap_back.isNotNull() & (gap_back <= tolerance) & (gap_ahead.isNull() | (gap_back <= gap_ahead)),
        F.col("_back"),
    ).when(gap_ahead <= tolerance, F.col("_ahead"))
    matches = (
        merged.withColumn("_m", best)
        .where(F.col("_m").isNotNull())
        .select(
            *keys,
            time,
            *[F.col("_m._row")[c].alias(c) for c in payload],
            ((F.col("_m._t") - F.col("_t")) / 1e6).alias("time_gap"),
        )
    )
    return join_on(left, matches, [*keys, time], "left")


def stacked_ranges(probes: DataFrame, targets: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Both tables, written once, in ranges of (key, `at`) of about equal size numbered ``_split``."""
    stacked = probes.withColumn("_probe", F.lit(True)).unionByName(
        targets.withColumn("_probe", F.lit(False)), allowMissingColumns=True
    )
    return settle(stacked.repartitionByRange(*keys, at).withColumn("_split", F.spark_partition_id()), "ranges")


def merge_ranges(probes: DataFrame, targets: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Each probe with the target ``(at, _row)`` at or before it (``_back``) and at or after it (``_ahead``).

    Both tables hold a (key, `at`) at most once; `targets` has the columns keys, `at`, ``_row``.
    """
    placed = stacked_ranges(probes, targets, keys, at)
    target = F.when(~F.col("_probe"), F.struct(at, "_row"))
    order = Window.partitionBy(*keys).orderBy("_split")
    splits = (
        placed.where(~F.col("_probe"))
        .groupBy(*keys, "_split")
        .agg(F.min_by(target, at).alias("_first"), F.max_by(target, at).alias("_last"))
    )
    # ranges without a target still need their neighbours
    ranges = join_on(placed.select(*keys, "_split").distinct(), settle(splits), [*keys, "_split"], "left")
    carried = ranges.select(
        *keys,
        "_split",
        F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    within = Window.partitionBy(*keys, "_split")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    back = F.last(target, ignorenulls=True).over(within.orderBy(at).rangeBetween(*so_far))
    ahead = F.last(target, ignorenulls=True).over(within.orderBy(F.desc(at)).rangeBetween(*so_far))
    found = placed.withColumns({"_back": back, "_ahead": ahead}).where("_probe")
    met = join_on(found, settle(carried), [*keys, "_split"], "inner")
    return met.select(
        *probes.columns, F.coalesce("_back", "_before").alias("_back"), F.coalesce("_ahead", "_after").alias("_ahead")
    )


def bind_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns side by side, matched by row key instead of by position."""
    return join_on(left, right, keys, "inner")


def value_grid(spark, **axes: tuple[float, float, float]) -> DataFrame:
    """Every combination of evenly spaced values, ``name=(start, stop, step)``.

    One id range decoded by division: no join, and split over tasks by Spark.
    """
    sizes = {n: int(round((stop - start) / step)) + 1 for n, (start, stop, step) in axes.items()}
    total = reduce(lambda a, b: a * b, sizes.values(), 1)
    columns, stride = [], total
    for name, (start, _, step) in axes.items():
        stride //= sizes[name]
        index = F.floor(F.col("id") / stride) % sizes[name]
        columns.append((F.lit(float(start)) + index * F.lit(float(step))).alias(name))
    return spark.range(total).select(*columns)
