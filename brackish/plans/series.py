"""Ordered operators and reshaping on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.functions.nulls import null_if
from brackish.functions.times import floor_time
from brackish.operators.keys import join_on
from brackish.operators.ordered import direction, first_rows, quantile_bin, rolling_mean
from brackish.operators.project import across
from brackish.operators.reshape import (
    fill_grid,
    hours_to_rows,
    nest,
    split_name,
    stack,
    to_long,
    to_wide,
    to_wide_many,
    unnest,
)
from brackish.operators.scaling import below_group_max, scale_stats, standardise, unstandardise
from brackish.plans.catalog import Tables, query

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
KEY = ["l_orderkey", "l_partkey", "l_suppkey"]


@query(
    "w1_below_daily_max",
    """
    WITH s AS (SELECT event_id, date_trunc('day', ts) AS date, nullif(value, 0.05) AS value FROM events),
    m AS (SELECT date, CASE WHEN count(value) = count(*) THEN max(value) END AS top FROM s GROUP BY 1)
    SELECT event_id, date, value, round(value - top, 6) AS normalised FROM s JOIN m USING (date)
    """,
)
def w1_below_daily_max(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", floor_time(F.col("ts"), "day").alias("date"), null_if(F.col("value"), 0.05).alias("value"))
    return across(below_group_max(rows, ["date"], "value", "normalised"), ["normalised"], lambda c: F.round(c, 6))


ROLLED_SQL = """
    rolled AS (
        SELECT event_id, event_type, ts, value,
               CASE WHEN count(value) OVER w = 60 THEN avg(value) OVER w END AS mean_60
        FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND 30 FOLLOWING)
    )
"""


@query(
    "w2_centred_rolling_mean",
    f"WITH {ROLLED_SQL} SELECT event_id, event_type, round(mean_60, 6) AS mean_60 FROM rolled",
)
def w2_centred_rolling_mean(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type", "ts", "value")
    rolled = rolling_mean(rows, ["event_type"], ["ts", "event_id"], {"mean_60": "value"}, 60)
    return rolled.select("event_id", "event_type", F.round("mean_60", 6).alias("mean_60"))


@query(
    "w3_rising_falling",
    """
    SELECT event_id, event_type, CASE WHEN value > p THEN 'Rising' WHEN p IS NOT NULL THEN 'Falling' END AS rise_fall
    FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events)
    """,
)
def w3_rising_falling(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type", "ts", "value")
    return direction(rows, ["event_type"], ["ts", "event_id"], "value").select("event_id", "event_type", "rise_fall")


@query(
    "w4_quantile_bins",
    """
    WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, nullif(l_quantity, 10) AS q FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag,
           CASE WHEN q IS NOT NULL THEN CAST(ntile(3) OVER (PARTITION BY l_returnflag, q IS NULL
                ORDER BY q, l_orderkey, l_partkey, l_suppkey) AS INTEGER) END AS bin
    FROM s
    """,
)
def w4_quantile_bins(t: Tables) -> DataFrame:
    rows = t.lineitem.select(*KEY, "l_returnflag", null_if(F.col("l_quantity"), 10.0).alias("q"))
    return quantile_bin(rows, ["l_returnflag"], KEY, "q", 3, "bin").drop("q")


@query(
    "w5_zscore_table",
    """
    WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_extendedprice) AS mp,
                      stddev_samp(l_extendedprice) AS sp FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, round((l_quantity - mq) / sq, 6) AS l_quantity_scaled,
           round((l_extendedprice - mp) / sp, 6) AS l_extendedprice_scaled
    FROM lineitem, s
    """,
)
def w5_zscore_table(t: Tables) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice"]
    out = standardise(t.lineitem.select(*KEY, *columns), columns).drop(*columns)
    return across(out, [f"{c}_scaled" for c in columns], lambda c: F.round(c, 6))


@query(
    "w6_zscore_in_group",
    """
    WITH s AS (SELECT l_linestatus, avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linestatus, round((l_quantity - m) / sd, 6) AS l_quantity
    FROM lineitem JOIN s USING (l_linestatus)
    """,
)
def w6_zscore_in_group(t: Tables) -> DataFrame:
    out = standardise(t.lineitem.select(*KEY, "l_linestatus", "l_quantity"), ["l_quantity"], ["l_linestatus"], suffix="")
    return across(out, ["l_quantity"], lambda c: F.round(c, 6))


@query(
    "w7_undo_zscore",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linestatus, round(l_quantity, 6) AS l_quantity FROM lineitem",
)
def w7_undo_zscore(t: Tables) -> DataFrame:
    rows = t.lineitem.select(*KEY, "l_linestatus", "l_quantity")
    stats = scale_stats(rows, ["l_quantity"], ["l_linestatus"])
    scaled = standardise(rows, ["l_quantity"], ["l_linestatus"], suffix="", stats=stats)
    back = unstandardise(scaled, {"l_quantity": "l_quantity"}, stats, ["l_linestatus"], suffix="")
    return across(back, ["l_quantity"], lambda c: F.round(c, 6))


@query(
    "w8_regular_grid",
    """
    WITH s AS (SELECT event_type, date_trunc('minute', ts) AS date, round(avg(value), 6) AS value FROM events GROUP BY 1, 2),
    span AS (SELECT event_type, min(date) AS a, max(date) AS b FROM s GROUP BY 1),
    grid AS (
        SELECT event_type, unnest(generate_series(a, b, CASE WHEN event_type = 'click' THEN INTERVAL 10 MINUTES
                                                             ELSE INTERVAL 20 MINUTES END)) AS date FROM span
    )
    SELECT event_type, date, value FROM grid FULL JOIN s USING (event_type, date)
    """,
)
def w8_regular_grid(t: Tables) -> DataFrame:
    rows = t.events.groupBy("event_type", floor_time(F.col("ts"), "minute").alias("date")).agg(
        F.round(F.avg("value"), 6).alias("value")
    )
    steps = {k: 600 if k == "click" else 1200 for k in EVENT_TYPES}
    return fill_grid(rows, ["event_type"], "date", steps)


@query("w9_sort", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id")
def w9_sort(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", "value").orderBy("ts", "event_id")


@query(
    "w10_first_rows",
    """
    SELECT event_type, event_id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 2
    """,
)
def w10_first_rows(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", "event_id", "value")
    return first_rows(rows, ["event_type"], [F.desc("value"), "event_id"], 2)


@query(
    "r1_append_unequal",
    """
    SELECT s_suppkey AS key, s_acctbal AS balance, s_name AS name, NULL AS segment FROM supplier
    UNION ALL SELECT c_custkey, c_acctbal, NULL, c_mktsegment FROM customer
    """,
)
def r1_append_unequal(t: Tables) -> DataFrame:
    c = F.col
    suppliers = t.supplier.select(c("s_suppkey").alias("key"), c("s_acctbal").alias("balance"), c("s_name").alias("name"))
    customers = t.customer.select(c("c_custkey").alias("key"), c("c_acctbal").alias("balance"), c("c_mktsegment").alias("segment"))
    return stack(suppliers, customers)


@query(
    "r2_wide_to_long",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, 'l_quantity' AS name, l_quantity AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, 'l_tax', l_tax FROM lineitem
    """,
)
def r2_wide_to_long(t: Tables) -> DataFrame:
    return to_long(t.lineitem, KEY, ["l_quantity", "l_tax"])


@query(
    "r3_long_to_wide",
    """
    SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click,
           round(avg(value) FILTER (event_type = 'error'), 6) AS error,
           round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase,
           round(avg(value) FILTER (event_type = 'signup'), 6) AS signup,
           round(avg(value) FILTER (event_type = 'view'), 6) AS "view"
    FROM events GROUP BY user_id
    """,
)
def r3_long_to_wide(t: Tables) -> DataFrame:
    wide = to_wide(t.events, ["user_id"], "event_type", "value", EVENT_TYPES, F.avg)
    return across(wide, EVENT_TYPES, lambda c: F.round(c, 6))


@query(
    "r4_wide_several_values",
    """
    SELECT l_suppkey, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS l_quantity_F,
           round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS l_quantity_O,
           round(avg(l_tax) FILTER (l_linestatus = 'F'), 8) AS l_tax_F, round(avg(l_tax) FILTER (l_linestatus = 'O'), 8) AS l_tax_O
    FROM lineitem GROUP BY 1
    """,
)
def r4_wide_several_values(t: Tables) -> DataFrame:
    wide = to_wide_many(t.lineitem, ["l_suppkey"], "l_linestatus", ["l_quantity", "l_tax"], ["F", "O"], F.avg)
    wide = across(wide, ["l_quantity_F", "l_quantity_O"], lambda c: F.round(c, 6))
    return across(wide, ["l_tax_F", "l_tax_O"], lambda c: F.round(c, 8))


@query(
    "r5_day_hour_matrix",
    """
    WITH hourly AS (
        SELECT event_type, date_trunc('hour', ts) AS date, round(avg(value), 6) AS v FROM events GROUP BY 1, 2
    ), slots AS (
        SELECT DISTINCT date_trunc('day', ts) + to_hours(CAST(h AS INTEGER)) AS date
        FROM events, range(24) r(h) WHERE event_type = 'click'
    )
    SELECT s.date, coalesce(c.v, 0) AS rain, v.v AS wind, e.v AS waves
    FROM slots s LEFT JOIN hourly c ON c.date = s.date AND c.event_type = 'click'
    LEFT JOIN hourly v ON v.date = s.date AND v.event_type = 'view'
    LEFT JOIN hourly e ON e.date = s.date AND e.event_type = 'error'
    """,
)
def r5_day_hour_matrix(t: Tables) -> DataFrame:
    hours = [f"{h:02d}h" for h in range(24)]

    def matrix(kind: str) -> DataFrame:
        rows = t.events.where(F.col("event_type") == kind).select(
            F.date_format("ts", "dd.MM.yyyy").alias("day"), F.date_format("ts", "HH'h'").alias("hour"), "value"
        )
        wide = to_wide(rows, ["day"], "hour", "value", hours, F.avg)
        return across(wide, hours, lambda c: F.coalesce(F.round(c, 6).cast("string"), F.lit(" ")))

    rain = hours_to_rows(matrix("click"), "day", "rain").fillna(0.0, ["rain"])
    wind, waves = (hours_to_rows(matrix(kind), "day", name) for kind, name in (("view", "wind"), ("error", "waves")))
    return join_on(join_on(rain, wind, ["date"]), waves, ["date"])


@query(
    "r6_nest_unnest",
    """
    SELECT user_id, CAST(hour(ts) AS INTEGER) AS hour, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2
    """,
)
def r6_nest_unnest(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.hour("ts").alias("hour"), "value")
    nested = nest(rows, ["user_id"], ["hour"], mean=F.round(F.avg("value"), 6), n=F.count(F.lit(1)))
    return unnest(nested, "data")


@query(
    "r7_split_name",
    """
    SELECT p_partkey, split_part(p_name, ' ', 1) AS color, nullif(split_part(p_name, ' ', 2), '') AS item,
           nullif(split_part(p_name, ' ', 3), '') AS extra
    FROM part
    """,
)
def r7_split_name(t: Tables) -> DataFrame:
    return split_name(t.part.select("p_partkey", "p_name"), "p_name", ["color", "item", "extra"], " ")


@query("r8_distinct", "SELECT DISTINCT date_trunc('day', ts) AS date, event_type FROM events")
def r8_distinct(t: Tables) -> DataFrame:
    return t.events.select(floor_time(F.col("ts"), "day").alias("date"), "event_type").distinct()
