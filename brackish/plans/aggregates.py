"""Grouped summaries on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.functions.nulls import null_if
from brackish.functions.summary import cv, spread, std_error, var_over_mean, weighted_mean
from brackish.functions.times import floor_time
from brackish.operators.aggregate import at_latest, box_stats, range_table, row_shares, sum_numeric, summarise, time_mean
from brackish.operators.keys import join_on
from brackish.operators.ordered import first_rows
from brackish.operators.project import across
from brackish.plans.catalog import Tables, query

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a1_hourly_mean",
    """
    SELECT user_id, event_type, date_trunc('hour', ts) AS ts, round(avg(value), 6) AS mean
    FROM events GROUP BY 1, 2, 3
    """,
)
def a1_hourly_mean(t: Tables) -> DataFrame:
    return across(time_mean(t.events, ["user_id", "event_type"], "ts", "value"), ["mean"], lambda c: F.round(c, 6))


def _stats_sql(column: str) -> str:
    return (
        f"round(avg({column}), 6) AS {column}_mean, max({column}) AS {column}_max, "
        f"min({column}) AS {column}_min, round(var_samp({column}), 4) AS {column}_var"
    )


@query(
    "a2_multi_stat_summary",
    f"SELECT l_returnflag, l_linestatus, {', '.join(map(_stats_sql, MEASURES[:2]))} FROM lineitem GROUP BY 1, 2",
)
def a2_multi_stat_summary(t: Tables) -> DataFrame:
    functions = {
        "mean": lambda c: F.round(F.avg(c), 6), "max": F.max, "min": F.min, "var": lambda c: F.round(F.var_samp(c), 4),
    }
    return summarise(t.lineitem, ["l_returnflag", "l_linestatus"], MEASURES[:2], functions)


@query(
    "a2_strict_summary",
    """
    WITH s AS (SELECT l_orderkey, nullif(l_discount, 0.0) AS d, l_quantity AS q FROM lineitem)
    SELECT l_orderkey, CASE WHEN count(d) = count(*) THEN round(avg(d), 6) END AS d_mean,
           CASE WHEN count(d) = count(*) THEN max(d) END AS d_max, round(avg(q), 6) AS q_mean, max(q) AS q_max
    FROM s GROUP BY 1
    """,
)
def a2_strict_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", null_if(F.col("l_discount"), 0.0).alias("d"), F.col("l_quantity").alias("q"))
    functions = {"mean": lambda c: F.round(F.avg(c), 6), "max": F.max}
    return summarise(rows, ["l_orderkey"], ["d", "q"], functions, strict_nulls=True)


@query(
    "a3_mean_skipping_nulls",
    "SELECT l_suppkey, l_linestatus, round(avg(nullif(l_discount, 0)), 8) AS mean_discount FROM lineitem GROUP BY 1, 2",
)
def a3_mean_skipping_nulls(t: Tables) -> DataFrame:
    mean = F.avg(null_if(F.col("l_discount"), 0.0))
    return t.lineitem.groupBy("l_suppkey", "l_linestatus").agg(F.round(mean, 8).alias("mean_discount"))


@query(
    "a4_range",
    """
    SELECT l_partkey, max(l_quantity) - min(l_quantity) AS l_quantity,
           round(max(l_extendedprice) - min(l_extendedprice), 4) AS l_extendedprice
    FROM lineitem GROUP BY 1
    """,
)
def a4_range(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(
        spread(F.col("l_quantity")).alias("l_quantity"), F.round(spread(F.col("l_extendedprice")), 4).alias("l_extendedprice")
    )


@query(
    "a5_coefficient_of_variation",
    "SELECT l_suppkey, round(stddev_samp(l_quantity) / avg(l_quantity), 8) AS cv FROM lineitem GROUP BY 1",
)
def a5_coefficient_of_variation(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.round(cv(F.col("l_quantity")), 8).alias("cv"))


@query(
    "a6_variance_over_mean",
    "SELECT l_suppkey, round(var_samp(l_quantity) / avg(l_quantity), 8) AS ratio FROM lineitem GROUP BY 1",
)
def a6_variance_over_mean(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.round(var_over_mean(F.col("l_quantity")), 8).alias("ratio"))


@query(
    "a7_sum_numeric",
    """
    SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber, round(sum(l_quantity), 4) AS l_quantity,
           round(sum(l_discount), 4) AS l_discount, round(sum(l_tax), 4) AS l_tax
    FROM lineitem GROUP BY 1
    """,
)
def a7_sum_numeric(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return across(sum_numeric(rows, ["l_returnflag"]), ["l_quantity", "l_discount", "l_tax"], lambda c: F.round(c, 4))


@query(
    "a8_row_shares",
    """
    WITH s AS (SELECT l_suppkey, sum(l_quantity) AS a, sum(l_discount) AS b, sum(l_tax) AS c FROM lineitem GROUP BY 1)
    SELECT l_suppkey, round(a + b + c, 4) AS total, round(a / (a + b + c) * 100, 6) AS a,
           round(b / (a + b + c) * 100, 6) AS b, round(c / (a + b + c) * 100, 6) AS c
    FROM s
    """,
)
def a8_row_shares(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("a"), F.sum("l_discount").alias("b"), F.sum("l_tax").alias("c")
    )
    shares = row_shares(sums, ["a", "b", "c"])
    return across(shares, ["a", "b", "c"], lambda c: F.round(c, 6)).withColumn("total", F.round("total", 4))


@query(
    "a9_range_labels",
    """
    WITH long AS (
        SELECT l_returnflag, 'l_quantity' AS name, l_quantity AS v, ' psu' AS unit FROM lineitem
        UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice, ' ratio' FROM lineitem
        UNION ALL SELECT l_returnflag, 'l_tax', l_tax, '' FROM lineitem
    )
    SELECT l_returnflag, name, round(min(v), 2) AS min, round(max(v), 2) AS max, unit,
           printf('[%.2f - %.2f%s]', min(v), max(v), unit) AS range
    FROM long GROUP BY l_returnflag, name, unit
    """,
)
def a9_range_labels(t: Tables) -> DataFrame:
    units = {"l_quantity": " psu", "l_extendedprice": " ratio"}
    return range_table(t.lineitem, ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_tax"], units)


@query(
    "a10_minimum_across_columns",
    "SELECT l_orderkey, min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice, min(l_tax) AS l_tax FROM lineitem GROUP BY 1",
)
def a10_minimum_across_columns(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(*[F.min(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_tax")])


@query(
    "a11_mean_and_standard_error",
    """
    SELECT l_shipdate, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 8) AS se
    FROM lineitem GROUP BY 1
    """,
)
def a11_mean_and_standard_error(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_shipdate").agg(F.round(F.avg(q), 6).alias("mean"), F.round(std_error(q), 8).alias("se"))


@query(
    "a12_distinct_count",
    "SELECT l_returnflag, count(DISTINCT l_shipdate) AS days, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
)
def a12_distinct_count(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_shipdate").alias("days"), F.count_distinct("l_suppkey").alias("suppliers")
    )


@query(
    "a13_weighted_by_join_mean",
    """
    SELECT p_brand, round(avg(p_retailprice), 6) AS mean_depth
    FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1
    """,
)
def a13_weighted_by_join_mean(t: Tables) -> DataFrame:
    """The mean weighted by matching samples, from counts per part: the detail join is not built."""
    samples = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("w"))
    parts = join_on(t.part.select("p_partkey", "p_brand", "p_retailprice"), samples, ["p_partkey"])
    weight = F.coalesce(F.col("w"), F.lit(1))
    return parts.groupBy("p_brand").agg(F.round(weighted_mean(F.col("p_retailprice"), weight), 6).alias("mean_depth"))


@query(
    "a14_end_members",
    """
    SELECT l_returnflag, max(l_quantity) AS salinity_high, min(nullif(l_discount, 0)) AS silicate_high
    FROM lineitem WHERE l_linestatus = 'F' AND l_discount <> 0 GROUP BY 1
    """,
)
def a14_end_members(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("silicate", null_if(F.col("l_discount"), 0.0)).where(F.col("l_linestatus") == "F")
    return (
        rows.dropna(subset=["silicate"])
        .groupBy("l_returnflag")
        .agg(F.max("l_quantity").alias("salinity_high"), F.min("silicate").alias("silicate_high"))
    )


@query(
    "a15_first_row_per_group",
    """
    SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1
    """,
)
def a15_first_row_per_group(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return first_rows(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "a16_rows_at_latest_time",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)",
)
def a16_rows_at_latest_time(t: Tables) -> DataFrame:
    return at_latest(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate")


@query(
    "a16_rows_at_latest_time_per_key",
    """
    SELECT o_orderkey, o_custkey, o_orderdate FROM orders o
    WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders p WHERE p.o_custkey = o.o_custkey)
    """,
)
def a16_rows_at_latest_time_per_key(t: Tables) -> DataFrame:
    return at_latest(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", ["o_custkey"])


@query(
    "a17_mixed_summary",
    """
    SELECT l_suppkey, l_linestatus, round(avg(l_discount), 8) AS mean_d, round(sum(l_tax), 6) AS sum_t,
           max(l_quantity) AS max_q, round(avg(l_quantity), 6) AS mean_q
    FROM lineitem GROUP BY 1, 2
    """,
)
def a17_mixed_summary(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey", "l_linestatus").agg(
        F.round(F.avg("l_discount"), 8).alias("mean_d"),
        F.round(F.sum("l_tax"), 6).alias("sum_t"),
        F.max("l_quantity").alias("max_q"),
        F.round(F.avg("l_quantity"), 6).alias("mean_q"),
    )


@query(
    "a18_box_statistics",
    """
    WITH q AS (
        SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
               quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1
    )
    SELECT event_type, count(*) AS n,
           min(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS lower,
           round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
           max(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS upper,
           count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
    FROM events JOIN q USING (event_type) GROUP BY event_type
    """,
)
def a18_box_statistics(t: Tables) -> DataFrame:
    return across(box_stats(t.events, ["event_type"], "value"), ["q1", "median", "q3"], lambda c: F.round(c, 6))
