"""Scalar functions: time, text, chemistry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.functions import chemistry as chem
from brackish.functions.carbonate import with_carbonate_system
from brackish.functions.nulls import null_if
from brackish.functions.seawater import density
from brackish.functions.times import (
    ceiling_time,
    floor_time,
    parse_time,
    round_time,
    serial_day_to_time,
    shift_time,
    year_month,
)
from brackish.operators.keys import attach, join_on
from brackish.operators.regression import line_fit
from brackish.plans.catalog import Tables, query
from brackish.session import settle

KEY = ("l_orderkey", "l_partkey", "l_suppkey")
# Stand-in sample columns in plausible ranges, the same expressions in both engines.
SAMPLE_SQL = """
    sample AS (
        SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag AS location, l_linestatus AS season,
               30 + l_quantity / 10 AS salinity, 24 + l_linenumber AS temperature,
               2200 + l_extendedprice / 200 AS ta, 1900 + l_extendedprice / 250 + l_quantity AS dic,
               1 + l_quantity / 5 AS silicate, l_discount AS speed
        FROM lineitem
    )
"""


def samples(t: Tables) -> DataFrame:
    c = F.col
    return t.lineitem.select(
        *KEY,
        c("l_returnflag").alias("location"),
        c("l_linestatus").alias("season"),
        (30 + c("l_quantity") / 10).alias("salinity"),
        (24 + c("l_linenumber")).alias("temperature"),
        (2200 + c("l_extendedprice") / 200).alias("ta"),
        (1900 + c("l_extendedprice") / 250 + c("l_quantity")).alias("dic"),
        (1 + c("l_quantity") / 5).alias("silicate"),
        c("l_discount").alias("speed"),
    )


@query(
    "f1_parse_dates",
    """
    SELECT o_orderkey, o_orderdate AS iso, o_orderdate AS us_minutes, o_orderdate AS us_seconds,
           o_orderdate AS us_day, o_orderdate AS eu_hour, o_orderdate AS compact
    FROM orders
    """,
)
def f1_parse_dates(t: Tables) -> DataFrame:
    layouts = {
        "iso": "yyyy-MM-dd HH:mm:ss", "us_minutes": "M/d/yyyy H:mm", "us_seconds": "M/d/yyyy H:mm:ss",
        "us_day": "M/d/yyyy", "eu_hour": "dd.MM.yyyy HH'h'", "compact": "yyyyMMdd",
    }
    date = F.col("o_orderdate")
    return t.orders.select("o_orderkey", *[parse_time(F.date_format(date, f)).alias(n) for n, f in layouts.items()])


@query(
    "f2_floor_round_ceiling",
    """
    SELECT event_id, date_trunc('hour', ts) AS floored, date_trunc('hour', ts + INTERVAL 30 MINUTES) AS rounded,
           date_trunc('minute', ts + INTERVAL 1 MINUTE - INTERVAL 1 MICROSECOND) AS ceiled
    FROM events
    """,
)
def f2_floor_round_ceiling(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select(
        "event_id",
        floor_time(ts, "hour").alias("floored"),
        round_time(ts, "hour").alias("rounded"),
        ceiling_time(ts, "minute").alias("ceiled"),
    )


@query(
    "f3_time_parts",
    """
    SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d,
           CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi,
           year(ts) || '-' || month(ts) AS label, strftime(ts, '%H:%M:%S') AS clock
    FROM events
    """,
)
def f3_time_parts(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select(
        "event_id",
        F.year(ts).alias("y"), F.month(ts).alias("m"), F.dayofmonth(ts).alias("d"),
        F.hour(ts).alias("h"), F.minute(ts).alias("mi"),
        year_month(ts).alias("label"), F.date_format(ts, "HH:mm:ss").alias("clock"),
    )


@query(
    "f4_time_arithmetic",
    "SELECT event_id, ts + INTERVAL 3 MINUTES AS later, ts - INTERVAL 10 HOURS AS local_time FROM events",
)
def f4_time_arithmetic(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select("event_id", shift_time(ts, minutes=3).alias("later"), shift_time(ts, hours=-10).alias("local_time"))


@query("f5_serial_day", "SELECT event_id, date_trunc('minute', ts) AS date FROM events")
def f5_serial_day(t: Tables) -> DataFrame:
    # Half a second past the minute keeps the fractional day clear of the cut.
    micros = F.unix_micros(floor_time(F.col("ts"), "minute").cast("timestamp")) + 500_000
    serial = 719529 + micros / 86_400_000_000
    return t.events.select("event_id", serial_day_to_time(serial).alias("date"))


@query(
    "f6_text",
    """
    SELECT o_orderkey, o_orderstatus || ' ' || o_orderpriority AS pasted,
           regexp_replace(o_orderpriority, '[0-9]-', '', 'g') AS replaced,
           'Order ' || o_orderkey || ': ' || o_orderstatus AS glued
    FROM orders
    """,
)
def f6_text(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("pasted"),
        F.regexp_replace("o_orderpriority", "[0-9]-", "").alias("replaced"),
        F.format_string("Order %d: %s", "o_orderkey", "o_orderstatus").alias("glued"),
    )


@query(
    "f7_math",
    """
    SELECT c_custkey, round(ln(abs(c_acctbal) + 0.001), 8) AS logged, round(exp(c_acctbal / 10000), 8) AS raised,
           round(c_acctbal, 1) AS rounded, abs(c_acctbal) AS size, CAST(sign(c_acctbal) AS DOUBLE) AS direction
    FROM customer
    """,
)
def f7_math(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey",
        F.round(F.ln(F.abs(b) + 0.001), 8).alias("logged"),
        F.round(F.exp(b / 10000), 8).alias("raised"),
        F.round(b, 1).alias("rounded"),
        F.abs(b).alias("size"),
        F.signum(b).alias("direction"),
    )


@query(
    "f8_fill_par",
    """
    WITH s AS (
        SELECT l_orderkey, l_partkey, l_suppkey, nullif(l_quantity, 10) - 5 AS par, l_extendedprice AS lux,
               CASE WHEN l_linestatus = 'F' THEN 'Dry' ELSE 'Wet' END AS season FROM lineitem
    ), f AS (
        SELECT *, CASE WHEN par IS NOT NULL THEN par
                       WHEN season = 'Dry' THEN 16778.33 + (0 - 16778.33) * exp(-exp(-13.29572) * lux)
                       ELSE 1555.751648 + (0 - 1555.751648) * exp(-exp(-10.777624) * lux) END AS par_calc FROM s
    )
    SELECT l_orderkey, l_partkey, l_suppkey, round(CASE WHEN par_calc < 0 THEN 0 ELSE par_calc END, 6) AS par_calc FROM f
    """,
)
def f8_fill_par(t: Tables) -> DataFrame:
    par = null_if(F.col("l_quantity"), 10.0) - 5
    season = F.when(F.col("l_linestatus") == "F", "Dry").otherwise("Wet")
    return t.lineitem.select(*KEY, F.round(chem.fill_par(par, F.col("l_extendedprice"), season), 6).alias("par_calc"))


@query(
    "f9_salinity_normalised",
    f"WITH {SAMPLE_SQL} SELECT l_orderkey, l_partkey, l_suppkey, round(ta * salinity / 36, 8) AS ta_norm FROM sample",
)
def f9_salinity_normalised(t: Tables) -> DataFrame:
    value = chem.salinity_normalised(F.col("ta"), F.col("salinity"))
    return samples(t).select(*KEY, F.round(value, 8).alias("ta_norm"))


@query(
    "f10_log_ratio",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, round(ln((l_quantity + 1) / (l_linenumber + 1)), 8) AS log_ratio FROM lineitem
    """,
)
def f10_log_ratio(t: Tables) -> DataFrame:
    return t.lineitem.select(*KEY, F.round(chem.log_ratio(F.col("l_quantity"), F.col("l_linenumber")), 8).alias("log_ratio"))


MIXING_SQL = """
    ends AS (
        SELECT location, max(salinity) AS salinity_high, min(silicate) AS silicate_high,
               max(silicate) + 97.3 AS silicate_spring, max(ta) + 500 AS ta_spring, max(dic) + 900 AS dic_spring
        FROM sample GROUP BY location
    ), mixed AS (
        SELECT s.*, ta + (ta - ta_spring) * ((silicate - 0.965) / (silicate_spring - silicate)) AS ta_mix,
               dic + (dic - dic_spring) * ((silicate - 0.965) / (silicate_spring - silicate)) AS dic_mix
        FROM sample s JOIN ends USING (location)
    )
"""


def mixed_samples(t: Tables) -> DataFrame:
    """Samples with their location's end members, their season's offshore means and the mixing line.

    One aggregation by location and season gives both; its few rows give those by location.
    """
    s = samples(t)
    parts = settle(
        s.groupBy("location", "season").agg(
            F.max("salinity").alias("salinity_high"),
            F.min("silicate").alias("silicate_high"),
            F.max("silicate").alias("silicate_spring"),
            F.max("ta").alias("ta_spring"),
            F.max("dic").alias("dic_spring"),
            F.avg("ta").alias("ta_offshore"),
            F.avg("dic").alias("dic_offshore"),
        )
    )
    ends = parts.groupBy("location").agg(
        F.max("salinity_high").alias("salinity_high"),
        F.min("silicate_high").alias("silicate_high"),
        (F.max("silicate_spring") + 97.3).alias("silicate_spring"),
        (F.max("ta_spring") + 500).alias("ta_spring"),
        (F.max("dic_spring") + 900).alias("dic_spring"),
    )
    known = join_on(parts.select("location", "season", "ta_offshore", "dic_offshore"), ends, ["location"])
    si, si_end = F.col("silicate"), F.col("silicate_spring")
    return attach(s, known, ["location", "season"]).withColumns(
        {
            "ta_mix": chem.mixing_corrected(F.col("ta"), F.col("ta_spring"), si, si_end),
            "dic_mix": chem.mixing_corrected(F.col("dic"), F.col("dic_spring"), si, si_end),
        }
    )


@query(
    "f11_mixing_correction",
    f"""
    WITH {SAMPLE_SQL}, {MIXING_SQL}
    SELECT l_orderkey, l_partkey, l_suppkey, round(ta_mix, 4) AS ta_mix, round(dic_mix, 4) AS dic_mix FROM mixed
    """,
)
def f11_mixing_correction(t: Tables) -> DataFrame:
    return mixed_samples(t).select(*KEY, F.round("ta_mix", 4).alias("ta_mix"), F.round("dic_mix", 4).alias("dic_mix"))


# Stand-in values: reef lengths by site (and 0.965, 97.3, 500, 900 above: end members of the samples).
LENGTHS = {"R": 189.0, "A": 100.0, "N": 272.0}


def reef_length(location):
    out = F.lit(None).cast("double")
    for site, length in LENGTHS.items():
        out = F.when(location == site, length).otherwise(out)
    return out


@query(
    "f12_residence_time",
    """
    SELECT l_orderkey, l_partkey, l_suppkey,
           round((1 / nullif(l_discount * 60, 0)) * CASE l_returnflag WHEN 'R' THEN 189 WHEN 'A' THEN 100 ELSE 272 END, 6) AS residence_time
    FROM lineitem
    """,
)
def f12_residence_time(t: Tables) -> DataFrame:
    tau = chem.residence_time(F.col("l_discount"), reef_length(F.col("l_returnflag")))
    return t.lineitem.select(*KEY, F.round(tau, 6).alias("residence_time"))


METABOLISM_SQL = """
    offshore AS (
        SELECT location, season, avg(ta) AS ta_offshore, avg(dic) AS dic_offshore FROM sample GROUP BY location, season
    ), rates AS (
        SELECT m.*, o.ta_offshore - m.ta_mix AS ta_diff, o.dic_offshore - m.dic_mix AS dic_diff,
               CASE location WHEN 'R' THEN 189.0 WHEN 'A' THEN 100.0 ELSE 272.0 END / nullif(m.speed * 60, 0) AS tau,
               1023.0 AS rho, 0.7 AS depth
        FROM mixed m JOIN offshore o USING (location, season)
    )
"""


def metabolism(t: Tables) -> DataFrame:
    rows = mixed_samples(t).withColumns(
        {
            "ta_diff": F.col("ta_offshore") - F.col("ta_mix"),
            "dic_diff": F.col("dic_offshore") - F.col("dic_mix"),
            "tau": chem.residence_time(F.col("speed"), reef_length(F.col("location"))),
        }
    )
    rho, depth, tau = F.lit(1023.0), F.lit(0.7), F.col("tau")
    d_ta, d_dic = F.col("ta_diff"), F.col("dic_diff")
    return rows.withColumns(
        {
            "nec": chem.calcification(rho, depth, d_ta, tau),
            "nep": chem.production(rho, depth, d_dic, d_ta, tau),
            "nec_proxy": chem.calcification_proxy(d_ta),
            "nep_proxy": chem.production_proxy(d_dic, d_ta),
        }
    )


@query(
    "f13_calcification_production",
    f"""
    WITH {SAMPLE_SQL}, {MIXING_SQL}, {METABOLISM_SQL}
    SELECT l_orderkey, l_partkey, l_suppkey,
           round(((rho * depth * ta_diff) / nullif(2 * tau, 0)) / 1000, 4) AS nec,
           round(((rho * depth * (dic_diff - ta_diff / 2)) / nullif(tau, 0)) / 1000, 4) AS nep,
           round(ta_diff / 2, 4) AS nec_proxy, round(dic_diff - ta_diff / 2, 4) AS nep_proxy
    FROM rates
    """,
)
def f13_calcification_production(t: Tables) -> DataFrame:
    return metabolism(t).select(*KEY, *[F.round(c, 4).alias(c) for c in ("nec", "nep", "nec_proxy", "nep_proxy")])


@query(
    "f14_nutrient_differences",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, round(l_quantity - (l_discount + l_tax), 6) AS ton,
           round(l_quantity - l_discount, 6) AS top
    FROM lineitem
    """,
)
def f14_nutrient_differences(t: Tables) -> DataFrame:
    n, a, b = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return t.lineitem.select(
        *KEY,
        F.round(chem.organic_nitrogen(n, a, b), 6).alias("ton"),
        F.round(chem.organic_phosphorus(n, a), 6).alias("top"),
    )


@query(
    "f15_combined_and_ratio",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, round(l_discount + l_tax, 6) AS humics, round(l_discount / l_quantity, 8) AS ratio
    FROM lineitem
    """,
)
def f15_combined_and_ratio(t: Tables) -> DataFrame:
    return t.lineitem.select(
        *KEY,
        F.round(F.col("l_discount") + F.col("l_tax"), 6).alias("humics"),
        F.round(F.try_divide("l_discount", "l_quantity"), 8).alias("ratio"),
    )


@query(
    "f16_impute_from_line",
    """
    WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, nullif(l_tax, 0.03) AS speed, l_quantity AS wave FROM lineitem),
    fit AS (SELECT regr_slope(speed, wave) AS b, regr_intercept(speed, wave) AS a FROM s)
    SELECT l_orderkey, l_partkey, l_suppkey, round(coalesce(speed, a + b * wave), 8) AS speed FROM s, fit
    """,
)
def f16_impute_from_line(t: Tables) -> DataFrame:
    s = t.lineitem.select(*KEY, null_if(F.col("l_tax"), 0.03).alias("speed"), F.col("l_quantity").alias("wave"))
    line = line_fit(s, [], "speed", "wave").select("intercept", "slope")
    filled = F.coalesce(F.col("speed"), F.col("intercept") + F.col("slope") * F.col("wave"))
    return attach(s, line, []).select(*KEY, F.round(filled, 8).alias("speed"))


@query(
    "f17_density",
    f"""
    WITH {SAMPLE_SQL}, p AS (SELECT *, salinity AS s, CAST(temperature AS DOUBLE) AS t FROM sample)
    SELECT l_orderkey, l_partkey, l_suppkey, round(
        999.842594 + 6.793952e-2 * t - 9.095290e-3 * t ** 2 + 1.001685e-4 * t ** 3 - 1.120083e-6 * t ** 4 + 6.536332e-9 * t ** 5
        + (0.824493 - 4.0899e-3 * t + 7.6438e-5 * t ** 2 - 8.2467e-7 * t ** 3 + 5.3875e-9 * t ** 4) * s
        + (-5.72466e-3 + 1.0227e-4 * t - 1.6546e-6 * t ** 2) * s ** 1.5 + 4.8314e-4 * s ** 2, 6) AS rho
    FROM p
    """,
)
def f17_density(t: Tables) -> DataFrame:
    return samples(t).select(*KEY, F.round(density(F.col("salinity"), F.col("temperature")), 6).alias("rho"))


LUEKER_SQL = (
    "10 ** -(3633.86 / t - 61.2172 + 9.6777 * ln(t) - 0.011555 * s + 0.0001152 * s ** 2)",
    "10 ** -(471.78 / t + 25.929 - 3.16967 * ln(t) - 0.01781 * s + 0.0001122 * s ** 2)",
)
WATERS_SQL = (
    "10 ** -(-126.34048 + 6320.813 / t + 19.568224 * ln(t) + 13.409160 * sqrt(s) + 0.031646 * s - 5.1895e-5 * s ** 2"
    " + (-531.3642 * sqrt(s) - 5.713 * s) / t - 2.0669166 * sqrt(s) * ln(t)) * (1 + st / ks) / (1 + st / ks + ft / kf)",
    "10 ** -(-90.18333 + 5143.692 / t + 14.613358 * ln(t) + 21.225890 * sqrt(s) + 0.12450870 * s - 3.7243e-4 * s ** 2"
    " + (-779.3444 * sqrt(s) - 19.91739 * s) / t - 3.3534679 * sqrt(s) * ln(t)) * (1 + st / ks) / (1 + st / ks + ft / kf)",
)


def _carbonate_sql(k1: str, k2: str, fluoride: str = "kf / hf", nutrients: str = "") -> str:
    return f"""
    WITH {SAMPLE_SQL}, p AS (
        SELECT *, salinity AS s, temperature + 273.15 AS t, 10 ** (-(7.7 + l_suppkey % 5 / 10.0)) AS h FROM sample
    ), b AS (
        SELECT *, 19.924 * s / (1000 - 1.005 * s) AS i, s * 0.14 / 96.062 / 1.80655 AS st, s * 0.000067 / 18.998 / 1.80655 AS ft,
            s * 0.000232 / 10.811 / 1.80655 AS bt, s * 0.02127 / 40.078 / 1.80655 AS ca
        FROM p
    ), q AS (
        SELECT *, exp(-4276.1 / t + 141.328 - 23.093 * ln(t) + (-13856 / t + 324.57 - 47.986 * ln(t)) * sqrt(i)
                + (35474 / t - 771.54 + 114.723 * ln(t)) * i - 2698 / t * i ** 1.5 + 1776 / t * i ** 2 + ln(1 - 0.001005 * s)) AS ks,
            exp(1590.2 / t - 12.641 + 1.525 * sqrt(i) + ln(1 - 0.001005 * s)) AS kf
        FROM b
    ), k AS (
        SELECT *, {k1} AS k1, {k2} AS k2,
            exp((-8966.90 - 2890.53 * sqrt(s) - 77.942 * s + 1.728 * s ** 1.5 - 0.0996 * s ** 2) / t + 148.0248
                + 137.1942 * sqrt(s) + 1.62142 * s - (24.4344 + 25.085 * sqrt(s) + 0.2474 * s) * ln(t) + 0.053105 * sqrt(s) * t) AS kb,
            exp(148.9652 - 13847.26 / t - 23.6521 * ln(t) + (118.67 / t - 5.977 + 1.0495 * ln(t)) * sqrt(s) - 0.01615 * s) AS kw,
            exp(93.4517 * 100 / t - 60.2409 + 23.3585 * ln(t / 100) + s * (0.023517 - 0.023656 * t / 100 + 0.0047036 * (t / 100) ** 2)) AS k0
        FROM q
    ), f AS (SELECT *, h / (1 + st / ks) AS hf FROM k
    ), a AS (SELECT *, ta / 1e6 - bt / (1 + h / kb) - kw / h + hf + st / (1 + ks / hf) + ft / (1 + {fluoride}) {nutrients} AS ac FROM f
    ), d AS (SELECT *, ac * (h * h + k1 * h + k1 * k2) / (k1 * h + 2 * k1 * k2) AS dic0 FROM a
    ), e AS (SELECT *, dic0 / (1 + k1 / h + k1 * k2 / (h * h)) AS co2, dic0 / (1 + h / k2 + h * h / (k1 * k2)) AS co3 FROM d)
    """


@query(
    "f18_carbonate_system",
    f"""
    {_carbonate_sql(*LUEKER_SQL)}
    SELECT l_orderkey, l_partkey, l_suppkey, round(co2 * 1e6, 6) AS CO2, round((dic0 - co2 - co3) * 1e6, 6) AS HCO3,
        round(co3 * 1e6, 6) AS CO3, round(dic0 * 1e6, 6) AS DIC, round(co2 / k0 * 1e6, 6) AS fCO2,
        round(co2 / k0 * 1e6 / exp((-1636.75 + 12.0408 * t - 0.0327957 * t ** 2 + 3.16528e-5 * t ** 3 + 2 * (57.7 - 0.118 * t)) / (82.05736 * t)), 6) AS pCO2,
        round(co3 * ca / 10 ** (-171.945 - 0.077993 * t + 2903.293 / t + 71.595 * log10(t)
            + (-0.068393 + 0.0017276 * t + 88.135 / t) * sqrt(s) - 0.10018 * s + 0.0059415 * s ** 1.5), 6) AS OmegaAragonite,
        round(co3 * ca / 10 ** (-171.9065 - 0.077993 * t + 2839.319 / t + 71.595 * log10(t)
            + (-0.77712 + 0.0028426 * t + 178.34 / t) * sqrt(s) - 0.07711 * s + 0.0041249 * s ** 1.5), 6) AS OmegaCalcite
    FROM e
    """,
)
def f18_carbonate_system(t: Tables) -> DataFrame:
    rows = samples(t).select(*KEY, "salinity", "temperature", "ta", (7.7 + F.col("l_suppkey") % 5 / 10.0).alias("ph"))
    out = with_carbonate_system(rows, "ph", "ta", "salinity", "temperature", constants="x")
    names = ("CO2", "HCO3", "CO3", "DIC", "fCO2", "pCO2", "OmegaAragonite", "OmegaCalcite")
    return out.select(*KEY, *[F.round(c, 6).alias(c) for c in names])


@query(
    "f18_carbonate_constants_w14",
    f"""
    {_carbonate_sql(*WATERS_SQL)}
    SELECT location, season, round(avg(dic0 * 1e6), 6) AS dic,
           round(avg(co2 / k0 * 1e6 / exp((-1636.75 + 12.0408 * t - 0.0327957 * t ** 2 + 3.16528e-5 * t ** 3
                                           + 2 * (57.7 - 0.118 * t)) / (82.05736 * t))), 6) AS pco2
    FROM e GROUP BY 1, 2
    """,
)
def f18_carbonate_constants_w14(t: Tables) -> DataFrame:
    rows = samples(t).select("location", "season", "salinity", "temperature", "ta", (7.7 + F.col("l_suppkey") % 5 / 10.0).alias("ph"))
    out = with_carbonate_system(rows, "ph", "ta", "salinity", "temperature", constants="w14")
    return out.groupBy("location", "season").agg(F.round(F.avg("DIC"), 6).alias("dic"), F.round(F.avg("pCO2"), 6).alias("pco2"))


# Dickson, Sabine & Christian (2007): alkalinity of phosphate and silicate; Perez & Fraga (1987) in its range.
_P = (
    "exp(-4576.752 / t + 115.525 - 18.453 * ln(t) + (-106.736 / t + 0.69171) * sqrt(s) + (-0.65643 / t - 0.01844) * s)",
    "exp(-8814.715 / t + 172.0883 - 27.927 * ln(t) + (-160.340 / t + 1.3566) * sqrt(s) + (0.37335 / t - 0.05778) * s)",
    "exp(-3070.75 / t - 18.141 + (17.27039 / t + 2.81197) * sqrt(s) + (-44.99486 / t - 0.09984) * s)",
)
_NUTRIENT_SQL = f"""
    - speed * 1e-5 * ({_P[0]} * {_P[1]} * h + 2 * {_P[0]} * {_P[1]} * {_P[2]} - h ** 3)
      / (h ** 3 + {_P[0]} * h ** 2 + {_P[0]} * {_P[1]} * h + {_P[0]} * {_P[1]} * {_P[2]})
    - silicate * 1e-6 / (1 + h / exp(-8904.2 / t + 117.385 - 19.334 * ln(t) + (-458.79 / t + 3.5913) * sqrt(i)
        + (188.74 / t - 1.5998) * i + (-12.1652 / t + 0.07871) * i ** 2 + ln(1 - 0.001005 * s)))
"""
_FLUORIDE_SQL = (
    "CASE WHEN t - 273.15 BETWEEN 9 AND 33 AND s BETWEEN 10 AND 40 THEN exp(874 / t - 9.68 + 0.111 * sqrt(s)) / h ELSE kf / hf END"
)


@query(
    "f18_carbonate_nutrients",
    f"""
    {_carbonate_sql(*LUEKER_SQL, fluoride=_FLUORIDE_SQL, nutrients=_NUTRIENT_SQL)}
    SELECT l_orderkey, l_partkey, l_suppkey, round(dic0 * 1e6, 5) AS DIC, round(co2 / k0 * 1e6, 5) AS fCO2 FROM e
    """,
)
def f18_carbonate_nutrients(t: Tables) -> DataFrame:
    """Phosphate and silicate alkalinity and the fluoride constant by range."""
    rows = samples(t).select(
        *KEY, "salinity", "temperature", "ta", "silicate",
        (7.7 + F.col("l_suppkey") % 5 / 10.0).alias("ph"), (F.col("speed") * 10).alias("phosphate"),
    )
    out = with_carbonate_system(
        rows, "ph", "ta", "salinity", "temperature", "x", phosphate="phosphate", silicate="silicate", fluoride="x"
    )
    return out.select(*KEY, F.round("DIC", 5).alias("DIC"), F.round("fCO2", 5).alias("fCO2"))
