"""The three studies end to end: hourly series, chemistry to path model, slopes per tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.functions.carbonate import with_carbonate_system
from brackish.functions.chemistry import mixing_corrected, calcification_proxy, production_proxy
from brackish.functions.times import floor_time
from brackish.operators.aggregate import time_mean
from brackish.operators.keys import attach, join_on
from brackish.operators.project import across
from brackish.operators.regression import coefficients, fit_models, line_fit
from brackish.operators.reshape import to_wide
from brackish.operators.scaling import standardise
from brackish.plans.catalog import Tables, query
from brackish.plans.models import PATH_MODELS
from brackish.plans.scalars import MIXING_SQL, METABOLISM_SQL, SAMPLE_SQL, metabolism
from brackish.plans.series import EVENT_TYPES
from brackish.session import scratch_path, settle
from brackish.sources.tables import through_table

HOURLY_SQL = """
    hourly AS (
        SELECT date_trunc('hour', ts) AS ts, avg(value) FILTER (event_type = 'click') AS click,
               avg(value) FILTER (event_type = 'error') AS error, avg(value) FILTER (event_type = 'purchase') AS purchase,
               avg(value) FILTER (event_type = 'signup') AS signup, avg(value) FILTER (event_type = 'view') AS "view"
        FROM events GROUP BY 1
    )
"""


def hourly_wide(t: Tables) -> DataFrame:
    long = time_mean(t.events, ["event_type"], "ts", "value")
    return to_wide(long, ["ts"], "event_type", "mean", EVENT_TYPES)


@query(
    "e1_hourly_regression",
    f"""
    WITH {HOURLY_SQL}, z AS (
        SELECT ("view" - (SELECT avg("view") FROM hourly)) / (SELECT stddev_samp("view") FROM hourly) AS x,
               (click - (SELECT avg(click) FROM hourly)) / (SELECT stddev_samp(click) FROM hourly) AS y FROM hourly
    )
    SELECT regr_count(y, x) AS n, round(regr_intercept(y, x), 8) AS intercept, round(regr_slope(y, x), 8) AS slope,
           round(regr_r2(y, x), 8) AS r2
    FROM z
    """,
)
def e1_hourly_regression(t: Tables) -> DataFrame:
    """Hourly means, wide, scaled, one sensor regressed on another."""
    scaled = standardise(hourly_wide(t), ["click", "view"])
    line = line_fit(scaled, [], "click_scaled", "view_scaled").select("n", "intercept", "slope", "r2")
    return across(line, ["intercept", "slope", "r2"], lambda c: F.round(c, 8))


@query(
    "e1_hourly_with_weather",
    f"""
    WITH {HOURLY_SQL}, weather AS (
        SELECT date_trunc('day', o_orderdate) + INTERVAL 26 YEARS AS day, round(avg(o_totalprice), 4) AS waves
        FROM orders GROUP BY 1
    )
    SELECT ts, round(click, 6) AS click, round(error, 6) AS error, round(purchase, 6) AS purchase, round(signup, 6) AS signup,
           round("view", 6) AS "view", waves
    FROM hourly LEFT JOIN weather ON date_trunc('day', ts) = day
    """,
)
def e1_hourly_with_weather(t: Tables) -> DataFrame:
    weather = t.orders.groupBy(
        (floor_time(F.col("o_orderdate"), "day") + F.expr("INTERVAL 26 YEARS")).alias("day")
    ).agg(F.round(F.avg("o_totalprice"), 4).alias("waves"))
    wide = hourly_wide(t).withColumn("day", floor_time(F.col("ts"), "day"))
    joined = join_on(wide, weather, ["day"]).drop("day")
    return across(joined, EVENT_TYPES, lambda c: F.round(c, 6))


@query("e2_chemistry_to_paths")
def e2_chemistry_to_paths(t: Tables) -> DataFrame:
    """Bad rows out, carbonate system, end members, offshore difference, scaling, path model.

    What marks a row as bad stands in the row itself, so it is a filter of the scan. The carbonate
    columns and the model rows are each read twice, so both are written once as a stage boundary.
    """
    c = F.col
    rows = t.lineitem.select(
        c("l_returnflag").alias("location"),
        c("l_linestatus").alias("season"),
        F.when(c("l_linenumber") <= 3, "Day").otherwise("Night").alias("day_night"),
        (30 + c("l_quantity") / 10).alias("salinity"),
        (24 + c("l_linenumber") / 2 + c("l_tax") * 10).alias("temperature"),
        (2200 + c("l_extendedprice") / 500).alias("ta"),
        (7.8 + c("l_discount") * 3).alias("ph"),
        (1 + c("l_quantity") / 5).alias("silicate"),
        (0.1 + F.try_divide("l_extendedprice", "l_quantity") / 1000).alias("nitrate"),
        (c("l_discount") + c("l_tax")).alias("humics"),
        (c("l_tax") * c("l_quantity")).alias("prot"),
    )
    bad = F.coalesce((c("ta") > 2405) & (c("day_night") == "Night"), F.lit(False))
    system = with_carbonate_system(rows.where(~bad), "ph", "ta", "salinity", "temperature")
    system = system.select(*[n for n in rows.columns if n != "salinity"], "DIC")
    system = through_table(system, scratch_path(t.spark, "carbonate"))
    parts = settle(
        system.groupBy("location", "day_night").agg(
            F.max("silicate").alias("si"), F.max("ta").alias("ta"), F.max("DIC").alias("dic"),
            F.avg("ta").alias("ta_off"), F.avg("DIC").alias("dic_off"),
        )
    )
    ends = parts.groupBy("location").agg(
        (F.max("si") + 97.3).alias("si_end"), F.max("ta").alias("ta_end"), F.max("dic").alias("dic_end")
    )
    known = join_on(parts.select("location", "day_night", "ta_off", "dic_off"), ends, ["location"])
    mixed = attach(system, known, ["location", "day_night"])
    d_ta = c("ta_off") - mixing_corrected(c("ta"), c("ta_end"), c("silicate"), c("si_end"))
    d_dic = c("dic_off") - mixing_corrected(c("DIC"), c("dic_end"), c("silicate"), c("si_end"))
    model_rows = mixed.select(
        "location", "season", "day_night", "temperature", "ph", "humics", "prot",
        F.ln("silicate").alias("si"),
        F.ln("nitrate").alias("nn"),
        calcification_proxy(d_ta).alias("nec"),
        production_proxy(d_dic, d_ta).alias("nep"),
    )
    stored = through_table(model_rows, scratch_path(t.spark, "path-rows"))
    scaled = standardise(stored, ["temperature", "ph", "humics", "prot", "si", "nn", "nec", "nep"], suffix="")
    return coefficients(fit_models(scaled, ["location", "season"], PATH_MODELS, {"day_night": ["Day", "Night"]}))


@query(
    "e3_slopes_per_tag",
    f"""
    WITH {SAMPLE_SQL}, {MIXING_SQL}, {METABOLISM_SQL}, v AS (
        SELECT location, season, l_suppkey, silicate, temperature, rho * depth * ta_diff / nullif(2 * tau, 0) / 1000 AS nec,
               rho * depth * (dic_diff - ta_diff / 2) / nullif(tau, 0) / 1000 AS nep FROM rates
    )
    SELECT v.location, v.season, v.l_suppkey, round(regr_slope(nec, nep), 8) AS slope,
           round(max(silicate) - min(silicate), 6) AS silicate, round(max(temperature) - min(temperature), 6) AS temperature,
           any_value(s_name) AS s_name
    FROM v JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3
    """,
)
def e3_slopes_per_tag(t: Tables) -> DataFrame:
    """Slope of calcification on production per tag, with the tag's ranges: one aggregation."""
    keys = ["location", "season", "l_suppkey"]
    tags = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    fitted = metabolism(t).groupBy(*keys).agg(
        F.round(F.regr_slope("nec", "nep"), 8).alias("slope"),
        *[F.round(F.max(c) - F.min(c), 6).alias(c) for c in ("silicate", "temperature")],
    )
    return join_on(fitted, tags, ["l_suppkey"], "left")
