"""Ordered operators that hold when one series is a third of the table.

A plain window over a series sorts that whole series in one task. The operators here
range-partition the table on (keys, order), so a long series spreads over many tasks,
number the rows, and give every window a bounded chunk plus the few neighbouring rows
it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from brackish.operators.keys import attach, join_on
from brackish.session import cut_lineage, settle

CHUNK_ROWS = 100_000


def with_row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "row_index"
) -> DataFrame:
    """0-based position of each row within its key, in a total `order`.

    The range-sorted rows are checkpointed once, because the positions are only
    meaningful for one fixed split; the per-split counts that turn local positions into
    global ones are a table of about one row per task and key.
    """
    keys = list(keys)
    placed = cut_lineage(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumns({"_split": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()})
    )
    earlier = Window.partitionBy(*keys).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        placed.groupBy(*keys, "_split")
        .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    return (
        join_on(placed, settle(splits), [*keys, "_split"], "inner")
        .withColumn(name, F.col("_before") + F.col("_pos") - F.col("_first"))
        .drop("_split", "_pos", "_first", "_before")
    )


def over_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    before: int,
    after: int,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Window columns that look at most `before` rows back and `after` rows ahead.

    `columns` gets an ordered window spec (one chunk of one series, with its halo) and
    returns the columns to add. Results equal the same window over the whole series.
    """
    chunk_rows = max(chunk_rows, before + after + 1)
    indexed = with_row_index(df, keys, order, "_i")
    i = F.col("_i")
    lowest = F.greatest(i - after, F.lit(0))
    homes = F.sequence(F.floor(lowest / chunk_rows), F.floor((i + before) / chunk_rows))
    spec = Window.partitionBy(*keys, "_chunk").orderBy("_i")
    return (
        indexed.withColumn("_chunk", F.explode(homes))
        .withColumns(dict(columns(spec)))
        .where(F.col("_chunk") == F.floor(i / chunk_rows))
        .drop("_i", "_chunk")
    )


def rolling_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: Mapping[str, str], size: int
) -> DataFrame:
    """Centred mean of `size` rows; NULL at the ends and where the window holds a NULL.

    `values` maps a new column to its source. An even window reaches one row further ahead
    than back.
    """
    back, ahead = (size - 1) // 2, size // 2

    def columns(spec: WindowSpec) -> dict[str, Column]:
        frame = spec.rowsBetween(-back, ahead)
        return {
            new: F.when(F.count(old).over(frame) == size, F.avg(old).over(frame)) for new, old in values.items()
        }

    return over_series(df, keys, order, back, ahead, columns)


def direction(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    value: str,
    name: str = "rise_fall",
    labels: tuple[str, str] = ("Rising", "Falling"),
) -> DataFrame:
    """Label each row by comparing it with the row before; the first row is NULL."""

    def columns(spec: WindowSpec) -> dict[str, Column]:
        previous = F.lag(value).over(spec)
        known = F.col(value).isNotNull() & previous.isNotNull()
        return {name: F.when(F.col(value) > previous, labels[0]).when(known, labels[1])}

    return over_series(df, keys, order, 1, 0, columns)


def quantile_bin(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, bins: int, name: str
) -> DataFrame:
    """Near-equal bins 1..`bins` within each key; larger bins first; NULL values stay unbinned."""
    filled = with_row_index(df.where(F.col(value).isNotNull()), keys, [value, *order], "_i")
    sizes = filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    i, n = F.col("_i"), F.col("_n")
    small, extra = F.floor(n / bins), n % bins
    in_large = extra * (small + 1)
    binned = attach(filled, sizes, keys).withColumn(
        name,
        F.when(i < in_large, F.floor(i / (small + 1)) + 1)
        .otherwise(extra + F.floor(F.try_divide(i - in_large, small)) + 1)
        .cast("int"),
    )
    empty = df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("int"))
    return binned.drop("_i", "_n").unionByName(empty)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per key in order: ``count`` rows hold it, ``before`` rows hold a smaller one.

    Equal values are combined map-side before anything is sorted, so one value that most rows
    share is one row here, and the sort is spread evenly over tasks.
    """
    keys = list(keys)
    known = df.select(*keys, value).where(F.col(value).isNotNull())
    return _with_before(known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("count")), keys, value)


def _with_before(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds ``before``, the number of rows that precede each row of a table with ``count``."""
    placed = settle(
        counts.repartitionByRange(*keys, value)
        .withColumn("_split", F.spark_partition_id())
        .withColumn("_within", F.sum("count").over(Window.partitionBy(*keys, "_split").orderBy(value)) - F.col("count")),
        "counts",
    )
    earlier = Window.partitionBy(*keys).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        placed.groupBy(*keys, "_split")
        .agg(F.sum("count").alias("_rows"))
        .withColumn("_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    joined = join_on(placed, settle(splits), [*keys, "_split"], "inner")
    return joined.select(*counts.columns, (F.col("_first") + F.col("_within")).alias("before"))


#: A sketch's rank error is a row in this many; up to so many groups get intervals of their own.
SKETCH_ACCURACY = 10_000
SELECTED_GROUPS = 100_000


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles, one row per key, by selection: `df` is read twice, hardly sorted.

    A mergeable sketch gives a narrow interval of values per key and probability. The second pass
    counts the distinct values inside of the intervals (a few rows in `SKETCH_ACCURACY`) and, as one
    row per stretch, the rows between them; only these counts are shuffled and sorted. A key whose
    rank falls between its intervals, against the sketch's bound, is sorted in full, and so is a
    table of more than `SELECTED_GROUPS` keys, whose groups are small.
    """
    keys = list(keys)
    known = df.select(*keys, value).where(F.col(value).isNotNull())
    intervals = settle(_intervals(known, keys, value, list(probabilities.values())), "intervals")
    if intervals.count() > SELECTED_GROUPS:
        return quantiles_of_counts(settle(value_counts(df, keys, value)), keys, value, probabilities)
    counts = _with_before(_selected_counts(known, keys, value, intervals, list(probabilities.values())), keys, value)
    sizes = intervals.select(*keys, "_n")
    ranked = join_on(counts, sizes, keys) if keys else attach(counts, sizes, keys)
    stretch = F.col("_top") != F.col(value)
    picked = settle(_picked(ranked, keys, value, probabilities, _missed=F.bool_or(stretch & _holds_a_rank(probabilities))), "picked")
    missed = picked.where("_missed")
    if missed.isEmpty():
        return _interpolated(picked, keys, probabilities)
    rest = known
    if keys:
        rest = join_on(known, settle(missed.select(*keys)), keys, "left_semi")
    again = quantiles_of_counts(settle(value_counts(rest, keys, value)), keys, value, probabilities)
    return _interpolated(picked.where("NOT _missed"), keys, probabilities).unionByName(again)


def _intervals(known: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Per key arrays ``_low`` and ``_high`` of values, a pair per probability, twice the sketch's error wide each way; rows ``_n``."""
    slack = 2.0 / SKETCH_ACCURACY

    def sketch(shift: float) -> Column:
        at = F.array(*[F.lit(min(max(p + shift, 0.0), 1.0)) for p in probabilities])
        return F.percentile_approx(value, at, SKETCH_ACCURACY)

    return known.groupBy(*keys).agg(
        sketch(-slack).alias("_low"), sketch(slack).alias("_high"), F.count(F.lit(1)).alias("_n")
    )


def _selected_counts(
    known: DataFrame, keys: Sequence[str], value: str, intervals: DataFrame, probabilities: Sequence[float]
) -> DataFrame:
    """Distinct values inside of the intervals with their counts; a stretch between two is one row from its least value to ``_top``."""
    v = F.col(value)
    low, high = ([F.col(f"{end}_{i}") for i in range(len(probabilities))] for end in ("_low", "_high"))
    bounds = intervals.select(*keys, *[F.col(end)[i].alias(f"{end}_{i}") for end in ("_low", "_high") for i in range(len(probabilities))])
    inside = reduce(or_, [(v >= least) & (v <= most) for least, most in zip(low, high)])
    passed = sum((F.when(v > most, 1).otherwise(0) for most in high), F.lit(0))
    marked = (join_on(known, bounds, keys) if keys else attach(known, bounds, keys)).select(
        *keys, v, F.when(inside, v).alias("_value"), F.when(~inside, passed).alias("_stretch")
    )
    counts = marked.groupBy(*keys, "_value", "_stretch").agg(
        F.count(F.lit(1)).alias("count"), F.min(v).alias(value), F.max(v).alias("_top")
    )
    return counts.select(*keys, value, "count", "_top")


def _rank(p: float) -> Column:
    return (F.col("_n") - 1) * F.lit(float(p))


def _holds_a_rank(probabilities: Mapping[str, float]) -> Column:
    """Whether a row of a table of counts stands at a rank that a quantile needs."""
    first, end = F.col("before"), F.col("before") + F.col("count")
    ranks = [around(_rank(p)) for p in probabilities.values() for around in (F.floor, F.ceil)]
    return reduce(or_, [(first <= rank) & (rank < end) for rank in ranks])


def _picked(ranked: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float], **more: Column) -> DataFrame:
    """Per key the values at the ranks below and above each probability, from counts with ``before`` and ``_n``."""
    v, first, end = F.col(value), F.col("before"), F.col("before") + F.col("count")

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position < end), v))

    low = {f"_lo_{n}": at(F.floor(_rank(p))) for n, p in probabilities.items()}
    high = {f"_hi_{n}": at(F.ceil(_rank(p))) for n, p in probabilities.items()}
    return ranked.groupBy(*keys).agg(
        F.max("_n").alias("_n"), *[c.alias(n) for n, c in {**low, **high, **more}.items()]
    )


def _interpolated(picked: DataFrame, keys: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    def between(name: str, p: float) -> Column:
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return low + (high - low) * (_rank(p) - F.floor(_rank(p)))

    return picked.select(*keys, *[between(n, p).alias(n) for n, p in probabilities.items()])


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """`exact_quantiles` from a settled `value_counts` table."""
    sizes = counts.groupBy(*keys).agg(F.sum("count").alias("_n"))
    return _interpolated(_picked(attach(counts, sizes, keys), keys, value, probabilities), keys, probabilities)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int = 1) -> DataFrame:
    """The first `k` rows of each key. Spark limits each map task to `k` rows before the shuffle."""
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(spec)).where(F.col("_rank") <= k).drop("_rank")
