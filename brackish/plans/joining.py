"""Joins on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.functions.nulls import null_if
from brackish.functions.times import floor_time, round_time
from brackish.operators.joins import (
    align_outer,
    bind_by_key,
    drop_listed,
    join_rounded,
    keep_matches,
    natural_full_chain,
    natural_join,
    natural_left_chain,
    nearest_join,
    offset_join,
    self_reference,
    value_grid,
    with_group_stats,
)
from brackish.operators.keys import attach, join_on
from brackish.operators.project import across
from brackish.operators.regression import line_fit
from brackish.plans.catalog import Tables, query
from brackish.session import settle

SENSORS = ("click", "view", "purchase", "error", "signup")
SENSOR_SQL = """
    base AS (SELECT nullif(user_id, 7) AS site, date_trunc('day', ts) AS date, event_type, value FROM events),
    click AS (SELECT site, date, avg(value) AS click FROM base WHERE event_type = 'click' GROUP BY 1, 2),
    "view" AS (SELECT site, date, avg(value) AS "view" FROM base WHERE event_type = 'view' GROUP BY 1, 2),
    purchase AS (SELECT site, date, avg(value) AS purchase FROM base WHERE event_type = 'purchase' GROUP BY 1, 2),
    error AS (SELECT site, date, avg(value) AS error FROM base WHERE event_type = 'error' GROUP BY 1, 2),
    signup AS (SELECT site, date, avg(value) AS signup FROM base WHERE event_type = 'signup' GROUP BY 1, 2)
"""


def sensors(t: Tables) -> list[DataFrame]:
    base = t.events.select(
        null_if(F.col("user_id"), 7).alias("site"), floor_time(F.col("ts"), "day").alias("date"), "event_type", "value"
    )
    # one scan and one aggregation make the daily means of all sensors
    kind = F.col("event_type")
    daily = settle(
        base.groupBy("site", "date").agg(
            *[F.avg(F.when(kind == s, F.col("value"))).alias(s) for s in SENSORS],
            *[F.max(kind == s).alias(f"_has_{s}") for s in SENSORS],
        )
    )
    return [daily.where(F.col(f"_has_{s}")).select("site", "date", s) for s in SENSORS]


def _rounded(df: DataFrame) -> DataFrame:
    return across(df, list(SENSORS), lambda c: F.round(c, 6))


@query(
    "j1_natural_left_chain",
    f"""
    WITH {SENSOR_SQL}
    SELECT c.site, c.date, round(click, 6) AS click, round("view", 6) AS "view",
           round(purchase, 6) AS purchase, round(error, 6) AS error, round(signup, 6) AS signup
    FROM click c
    LEFT JOIN "view" v ON c.site IS NOT DISTINCT FROM v.site AND c.date IS NOT DISTINCT FROM v.date
    LEFT JOIN purchase p ON c.site IS NOT DISTINCT FROM p.site AND c.date IS NOT DISTINCT FROM p.date
    LEFT JOIN error e ON c.site IS NOT DISTINCT FROM e.site AND c.date IS NOT DISTINCT FROM e.date
    LEFT JOIN signup u ON c.site IS NOT DISTINCT FROM u.site AND c.date IS NOT DISTINCT FROM u.date
    """,
)
def j1_natural_left_chain(t: Tables) -> DataFrame:
    return _rounded(natural_left_chain(*sensors(t)))


FULL_SQL = f"""
    WITH {SENSOR_SQL}, stacked AS (
        SELECT site, date FROM click UNION SELECT site, date FROM "view"
        UNION SELECT site, date FROM purchase UNION SELECT site, date FROM error UNION SELECT site, date FROM signup
    )
    SELECT s.site, s.date, round(click, 6) AS click, round("view", 6) AS "view",
           round(purchase, 6) AS purchase, round(error, 6) AS error, round(signup, 6) AS signup
    FROM stacked s
    LEFT JOIN click c ON s.site IS NOT DISTINCT FROM c.site AND s.date IS NOT DISTINCT FROM c.date
    LEFT JOIN "view" v ON s.site IS NOT DISTINCT FROM v.site AND s.date IS NOT DISTINCT FROM v.date
    LEFT JOIN purchase p ON s.site IS NOT DISTINCT FROM p.site AND s.date IS NOT DISTINCT FROM p.date
    LEFT JOIN error e ON s.site IS NOT DISTINCT FROM e.site AND s.date IS NOT DISTINCT FROM e.date
    LEFT JOIN signup u ON s.site IS NOT DISTINCT FROM u.site AND s.date IS NOT DISTINCT FROM u.date
"""


@query("j2_natural_full_chain", FULL_SQL)
def j2_natural_full_chain(t: Tables) -> DataFrame:
    return _rounded(natural_full_chain(*sensors(t)))


@query("j2_align_outer", FULL_SQL)
def j2_align_outer(t: Tables) -> DataFrame:
    return _rounded(align_outer(sensors(t), ["site", "date"]))


@query(
    "j3_right_join",
    """
    WITH spend AS (SELECT o_custkey AS custkey, round(sum(o_totalprice), 4) AS spend FROM orders
                   WHERE o_totalprice > 400000 GROUP BY 1),
    c AS (SELECT c_custkey AS custkey, c_acctbal FROM customer)
    SELECT custkey, spend, c_acctbal FROM spend RIGHT JOIN c USING (custkey)
    """,
)
def j3_right_join(t: Tables) -> DataFrame:
    spend = (
        t.orders.where(F.col("o_totalprice") > 400000)
        .groupBy(F.col("o_custkey").alias("custkey"))
        .agg(F.round(F.sum("o_totalprice"), 4).alias("spend"))
    )
    return natural_join(spend, t.customer.select(F.col("c_custkey").alias("custkey"), "c_acctbal"), "right")


@query(
    "j4_anti_join",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem l
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'P')
    """,
)
def j4_anti_join(t: Tables) -> DataFrame:
    bad = t.orders.where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("l_orderkey"))
    return drop_listed(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"), bad, ["l_orderkey"])


@query(
    "j5_rounded_time",
    """
    WITH tide AS (SELECT date_trunc('hour', ts) AS date, round(avg(value), 6) AS height FROM events
                  WHERE event_type = 'error' GROUP BY 1)
    SELECT event_id, date_trunc('hour', ts + INTERVAL 30 MINUTES) AS date, height
    FROM events LEFT JOIN tide ON date_trunc('hour', ts + INTERVAL 30 MINUTES) = tide.date
    """,
)
def j5_rounded_time(t: Tables) -> DataFrame:
    tide = (
        t.events.where(F.col("event_type") == "error")
        .groupBy(floor_time(F.col("ts"), "hour").alias("date"))
        .agg(F.round(F.avg("value"), 6).alias("height"))
    )
    rows = t.events.select("event_id", "ts")
    return join_rounded(rows, tide, round_time(F.col("ts"), "hour"), "date").drop("ts")


@query(
    "j6_clock_offset",
    """
    WITH late AS (SELECT user_id, date_trunc('minute', ts) - INTERVAL 3 MINUTES AS date, round(avg(value), 6) AS speed
                  FROM events WHERE event_type <> 'view' GROUP BY 1, 2)
    SELECT e.event_id, e.user_id, date_trunc('minute', ts) AS date, speed
    FROM events e LEFT JOIN late l ON l.user_id = e.user_id AND l.date + INTERVAL 3 MINUTES = date_trunc('minute', ts)
    """,
)
def j6_clock_offset(t: Tables) -> DataFrame:
    minute = floor_time(F.col("ts"), "minute").alias("date")
    late = (
        t.events.where(F.col("event_type") != "view")
        .groupBy("user_id", (floor_time(F.col("ts"), "minute") - F.expr("INTERVAL 3 MINUTES")).alias("date"))
        .agg(F.round(F.avg("value"), 6).alias("speed"))
    )
    return offset_join(t.events.select("event_id", "user_id", minute), late, "date", "3 minutes", ["user_id"])


@query(
    "j6_nearest_in_tolerance",
    """
    WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
    b AS (SELECT event_id AS view_id, user_id, ts AS view_ts, value AS reading FROM events WHERE event_type = 'view'),
    ranked AS (
        SELECT a.*, b.view_id, b.reading, epoch_us(b.view_ts) - epoch_us(a.ts) AS gap,
               row_number() OVER (PARTITION BY a.event_id
                                  ORDER BY abs(epoch_us(b.view_ts) - epoch_us(a.ts)), b.view_ts, b.view_id) AS k
        FROM a LEFT JOIN b ON a.user_id = b.user_id
             AND abs(epoch_us(b.view_ts) - epoch_us(a.ts)) <= CAST(6 AS BIGINT) * 3600 * 1000000
    )
    SELECT event_id, user_id, ts, view_id, reading, round(gap / 1e6, 6) AS time_gap FROM ranked WHERE k = 1
    """,
)
def j6_nearest_in_tolerance(t: Tables) -> DataFrame:
    clicks = t.events.where(F.col("event_type") == "click").select("event_id", "user_id", "ts")
    views = t.events.where(F.col("event_type") == "view").select(
        F.col("event_id").alias("view_id"), "user_id", "ts", F.col("value").alias("reading")
    )
    matched = nearest_join(clicks, views, "ts", 6 * 3600, ["user_id"], tie_break=["view_id"])
    return matched.withColumn("time_gap", F.round("time_gap", 6))


@query(
    "j7_inner_by_elimination",
    """
    SELECT o_orderkey, o_totalprice, lines FROM orders
    JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_quantity > 25 GROUP BY 1) ON o_orderkey = l_orderkey
    """,
)
def j7_inner_by_elimination(t: Tables) -> DataFrame:
    lines = (
        t.lineitem.where(F.col("l_quantity") > 25)
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    return keep_matches(t.orders.select("o_orderkey", "o_totalprice"), lines, ["o_orderkey"])


@query(
    "j8_aggregate_join_back",
    """
    WITH m AS (SELECT l_suppkey, avg(l_quantity) AS mean_quantity, max(l_extendedprice) AS top FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, round(mean_quantity, 6) AS mean_quantity, top
    FROM lineitem JOIN m USING (l_suppkey)
    """,
)
def j8_aggregate_join_back(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    out = with_group_stats(
        rows, ["l_suppkey"], mean_quantity=F.round(F.avg("l_quantity"), 6), top=F.max("l_extendedprice")
    )
    return out.drop("l_extendedprice")


@query(
    "j9_small_dimensions",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, s_name, n_name, r_name
    FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    """,
)
def j9_small_dimensions(t: Tables) -> DataFrame:
    supplier = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name", F.col("s_nationkey").alias("n_nationkey"))
    nation = t.nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey")
    return natural_left_chain(rows, supplier, nation, t.region).drop("n_nationkey", "r_regionkey")


@query(
    "j10_self_reference",
    """
    WITH incoming AS (SELECT l_orderkey, l_extendedprice AS incoming FROM lineitem WHERE l_linenumber = 1)
    SELECT l.l_orderkey, l_partkey, l_suppkey, incoming FROM lineitem l LEFT JOIN incoming i ON l.l_orderkey = i.l_orderkey
    """,
)
def j10_self_reference(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    out = self_reference(rows, F.col("l_linenumber") == 1, ["l_orderkey"], {"incoming": "l_extendedprice"})
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "incoming")


@query(
    "j11_value_grid",
    """
    WITH fit AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
    SELECT round(CAST(1 + i * 0.05 AS DOUBLE), 6) AS x2, round(CAST(7 + j * 0.5 AS DOUBLE), 6) AS x, round(a + b * (7 + j * 0.5) * (1 + i * 0.05), 4) AS expected
    FROM range(21) r1(i), range(11) r2(j), fit
    """,
)
def j11_value_grid(t: Tables) -> DataFrame:
    fit = line_fit(t.lineitem, [], "l_extendedprice", "l_quantity").select("intercept", "slope")
    grid = value_grid(t.spark, x2=(1.0, 2.0, 0.05), x=(7.0, 12.0, 0.5))
    expected = F.col("intercept") + F.col("slope") * F.col("x") * F.col("x2")
    return attach(grid, fit, []).select(F.round("x2", 6).alias("x2"), F.round("x", 6).alias("x"), F.round(expected, 4).alias("expected"))


@query(
    "j13_bind_by_key",
    """
    SELECT o_orderkey, round(ln(o_totalprice), 8) AS logged, o_orderdate FROM orders WHERE o_totalprice > 100000
    """,
)
def j13_bind_by_key(t: Tables) -> DataFrame:
    scored = t.orders.where(F.col("o_totalprice") > 100000).select("o_orderkey", F.round(F.ln("o_totalprice"), 8).alias("logged"))
    return bind_by_key(scored, t.orders.select("o_orderkey", "o_orderdate"), ["o_orderkey"])
