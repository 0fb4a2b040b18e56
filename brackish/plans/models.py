"""Grouped statistics on the supplied tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.functions.nulls import null_if
from brackish.functions.seawater import electrode_ph
from brackish.operators.density import density_curve, density_surface, rule_of_thumb_bandwidth, share_of_total
from brackish.operators.draws import effect_curve, expected_band, residual_summary, shortest_interval
from brackish.operators.effects import effect_curves
from brackish.operators.keys import attach
from brackish.operators.pca import fit_pca, loadings, percent_explained, scores
from brackish.operators.project import across
from brackish.operators.regression import (
    Model,
    anova_table,
    apply_line,
    coefficients,
    correlations,
    fit_log_link,
    fit_models,
    fit_student,
    fit_summary,
    line_fit,
    marginal_effects,
    nested_slopes,
    predict,
    shared_slope,
    term_columns,
)
from brackish.operators.scaling import scale_stats, standardise, unstandardise
from brackish.plans.catalog import Tables, query
from brackish.plans.scalars import KEY, METABOLISM_SQL, MIXING_SQL, SAMPLE_SQL, metabolism, samples
from brackish.session import settle

FACTORS = {"l_linestatus": ["F", "O"], "l_returnflag": ["A", "N", "R"], "season": ["F", "O"], "location": ["A", "N", "R"]}


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return across(df, list(names), lambda c: F.round(c, digits))


LINE_SQL = """
    count(*) AS n, round(regr_intercept({y}, {x}), 6) AS intercept, round(regr_slope({y}, {x}), 8) AS slope,
    round(regr_r2({y}, {x}), 8) AS r2,
    round(sqrt((regr_syy({y}, {x}) - regr_sxy({y}, {x}) ** 2 / regr_sxx({y}, {x})) / (count(*) - 2) / regr_sxx({y}, {x})), 8) AS slope_se
"""


@query(
    "g1_simple_regression",
    f"SELECT {LINE_SQL.format(y='l_extendedprice', x='l_quantity')} FROM lineitem",
)
def g1_simple_regression(t: Tables) -> DataFrame:
    line = line_fit(t.lineitem, [], "l_extendedprice", "l_quantity").drop("sigma", "intercept_se")
    return _round(_round(line, 6, "intercept"), 8, "slope", "r2", "slope_se")


@query(
    "g2_regression_per_group",
    f"""
    SELECT l_suppkey, l_linestatus, {LINE_SQL.format(y='l_tax', x='l_quantity')},
           round(max(l_discount) - min(l_discount), 6) AS discount_range
    FROM lineitem GROUP BY 1, 2
    """,
)
def g2_regression_per_group(t: Tables) -> DataFrame:
    keys = ["l_suppkey", "l_linestatus"]
    spread = F.max("l_discount") - F.min("l_discount")
    lines = line_fit(t.lineitem, keys, "l_tax", "l_quantity", discount_range=spread).drop("sigma", "intercept_se")
    return _round(_round(lines, 6, "intercept", "discount_range"), 8, "slope", "r2", "slope_se")


# Two separate lines give the coefficients of a crossed two-level model.
CROSSED_SQL = """
    lines AS (
        SELECT {keys} {f} AS level, regr_intercept({y}, {x}) AS a, regr_slope({y}, {x}) AS b FROM {table} GROUP BY ALL
    ), wide AS (
        SELECT {keys} max(a) FILTER (level = 'F') AS a0, max(b) FILTER (level = 'F') AS b0,
               max(a) FILTER (level = 'O') AS a1, max(b) FILTER (level = 'O') AS b1 FROM lines GROUP BY ALL
    )
"""


@query(
    "g3_factor_interaction",
    f"""
    WITH {CROSSED_SQL.format(keys='l_returnflag,', f='l_linestatus', y='l_extendedprice', x='l_quantity', table='lineitem')}
    SELECT l_returnflag, '(Intercept)' AS term, round(a0, 6) AS estimate FROM wide
    UNION ALL SELECT l_returnflag, 'l_quantity', round(b0, 6) FROM wide
    UNION ALL SELECT l_returnflag, 'l_linestatusO', round(a1 - a0, 6) FROM wide
    UNION ALL SELECT l_returnflag, 'l_quantity:l_linestatusO', round(b1 - b0, 6) FROM wide
    """,
)
def g3_factor_interaction(t: Tables) -> DataFrame:
    model = Model.crossed("l_extendedprice", "l_quantity", "l_linestatus")
    fitted = fit_models(t.lineitem, ["l_returnflag"], [model], FACTORS)
    return coefficients(fitted).select("l_returnflag", "term", F.round("estimate", 6).alias("estimate"))


def _three_way_sql() -> str:
    """Differences of the six separate lines give the coefficients of the fully crossed model."""
    cells = ", ".join(
        f"max({v}) FILTER (f = '{f}' AND r = '{r}') AS {v}{f}{r}" for v in "ab" for f in "FO" for r in "ANR"
    )
    rows = []
    for v, name in (("a", "(Intercept)"), ("b", "l_quantity")):
        prefix = "" if v == "a" else "l_quantity:"
        rows.append((name, f"{v}FA"))
        rows.append((f"{prefix}l_linestatusO", f"{v}OA - {v}FA"))
        for r in "NR":
            rows.append((f"{prefix}l_returnflag{r}", f"{v}F{r} - {v}FA"))
            rows.append((f"{prefix}l_linestatusO:l_returnflag{r}", f"({v}O{r} - {v}F{r}) - ({v}OA - {v}FA)"))
    body = " UNION ALL ".join(f"SELECT '{t}' AS term, round({e}, 5) AS estimate FROM wide" for t, e in rows)
    return f"""
        WITH lines AS (
            SELECT l_linestatus AS f, l_returnflag AS r, regr_intercept(l_extendedprice, l_quantity) AS a,
                   regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY 1, 2
        ), wide AS (SELECT {cells} FROM lines) {body}
    """


@query("g3_three_way_interaction", _three_way_sql())
def g3_three_way_interaction(t: Tables) -> DataFrame:
    model = Model.crossed("l_extendedprice", "l_quantity", "l_linestatus", "l_returnflag")
    table = coefficients(fit_models(t.lineitem, [], [model], FACTORS))
    return table.select("term", F.round("estimate", 5).alias("estimate"))


@query(
    "g3_two_predictors",
    """
    WITH m AS (
        SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_tax) AS m2,
               covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_quantity, l_tax) AS s12, covar_pop(l_tax, l_tax) AS s22,
               covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_tax, l_extendedprice) AS s2y,
               covar_pop(l_extendedprice, l_extendedprice) AS syy
        FROM lineitem GROUP BY 1
    ), b AS (
        SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m
    ), e AS (SELECT *, n * (syy - b1 * s1y - b2 * s2y) / (n - 3) AS sigma2 FROM b)
    SELECT l_returnflag, '(Intercept)' AS term, round(my - b1 * m1 - b2 * m2, 6) AS estimate, NULL AS std_error FROM e
    UNION ALL SELECT l_returnflag, 'l_quantity', round(b1, 6), round(sqrt(sigma2 * s22 / (n * (s11 * s22 - s12 * s12))), 6) FROM e
    UNION ALL SELECT l_returnflag, 'l_tax', round(b2, 6), round(sqrt(sigma2 * s11 / (n * (s11 * s22 - s12 * s12))), 6) FROM e
    """,
)
def g3_two_predictors(t: Tables) -> DataFrame:
    fitted = fit_models(t.lineitem, ["l_returnflag"], [Model("l_extendedprice", ("l_quantity", "l_tax"))])
    se = F.when(F.col("term") != "(Intercept)", F.round("std_error", 6))
    return coefficients(fitted).select("l_returnflag", "term", F.round("estimate", 6).alias("estimate"), se.alias("std_error"))


@query(
    "g4_nested_slopes",
    """
    WITH p AS (
        SELECT l_returnflag, l_linestatus, count(*) AS n, regr_intercept(l_extendedprice, l_quantity) AS intercept,
               regr_slope(l_extendedprice, l_quantity) AS slope, regr_sxx(l_extendedprice, l_quantity) AS sxx,
               regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity) AS rss
        FROM lineitem GROUP BY 1, 2
    ), s AS (SELECT l_returnflag, sqrt(sum(rss) / (sum(n) - 2 * count(*))) AS sigma FROM p GROUP BY 1)
    SELECT l_returnflag, l_linestatus, n, round(intercept, 6) AS intercept, round(slope, 6) AS slope,
           round(sigma, 6) AS sigma, round(sigma / sqrt(sxx), 6) AS slope_se
    FROM p JOIN s USING (l_returnflag)
    """,
)
def g4_nested_slopes(t: Tables) -> DataFrame:
    lines = nested_slopes(t.lineitem, ["l_returnflag"], "l_linestatus", "l_extendedprice", "l_quantity")
    return _round(lines, 6, "intercept", "slope", "sigma", "slope_se").withColumn("n", F.col("n").cast("bigint"))


@query(
    "g5_sequential_anova",
    """
    WITH t AS (SELECT count(*) AS n, regr_syy(l_extendedprice, l_quantity) AS tss,
                      regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity) AS rss1
               FROM lineitem),
    g AS (SELECT l_linestatus, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxy(l_extendedprice, l_quantity) AS sxy,
                 regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem GROUP BY 1),
    r AS (SELECT sum(syy) - sum(sxy) ** 2 / sum(sxx) AS rss2, sum(syy - sxy ** 2 / sxx) AS rss3 FROM g),
    a AS (SELECT *, rss3 / (n - 4) AS ms FROM t, r)
    SELECT 'l_quantity' AS term, CAST(1 AS INTEGER) AS df, round((tss - rss1) / 1e6, 4) AS sumsq, round((tss - rss1) / ms, 6) AS statistic FROM a
    UNION ALL SELECT 'l_linestatus', 1, round((rss1 - rss2) / 1e6, 4), round((rss1 - rss2) / ms, 6) FROM a
    UNION ALL SELECT 'l_quantity:l_linestatus', 1, round((rss2 - rss3) / 1e6, 4), round((rss2 - rss3) / ms, 6) FROM a
    UNION ALL SELECT 'Residuals', CAST(n - 4 AS INTEGER), round(rss3 / 1e6, 2), NULL FROM a
    """,
)
def g5_sequential_anova(t: Tables) -> DataFrame:
    fitted = fit_models(t.lineitem, [], [Model.crossed("l_extendedprice", "l_quantity", "l_linestatus")], FACTORS)
    millions = F.col("sumsq") / 1e6
    sumsq = F.when(F.col("term") == "Residuals", F.round(millions, 2)).otherwise(F.round(millions, 4))
    return anova_table(fitted).select("term", "df", sumsq.alias("sumsq"), F.round("statistic", 6).alias("statistic"))


@query(
    "g6_marginal_effects",
    """
    WITH p AS (
        SELECT l_linestatus, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS effect,
               regr_sxx(l_extendedprice, l_quantity) AS sxx,
               regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity) AS rss
        FROM lineitem GROUP BY 1
    ), s AS (SELECT sqrt(sum(rss) / (sum(n) - 4)) AS sigma FROM p)
    SELECT l_linestatus, round(effect, 6) AS effect, round(sigma / sqrt(sxx), 6) AS std_error,
           CASE WHEN abs(effect / (sigma / sqrt(sxx))) >= 1.959963984540054 THEN 'yes' ELSE 'no' END AS sig
    FROM p, s
    """,
)
def g6_marginal_effects(t: Tables) -> DataFrame:
    model = Model.crossed("l_extendedprice", "l_quantity", "l_linestatus")
    effects = marginal_effects(fit_models(t.lineitem, [], [model], FACTORS), model, "l_quantity", FACTORS)
    return _round(effects.select("l_linestatus", "effect", "std_error", "sig"), 6, "effect", "std_error")


@query(
    "g7_quadratic_fit",
    """
    WITH c AS (SELECT avg(l_quantity) AS centre FROM lineitem),
    s AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity - centre AS x1, (l_quantity - centre) ** 2 AS x2 FROM lineitem, c),
    m AS (SELECT l_returnflag, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12,
                 covar_pop(x2, x2) AS s22, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM s GROUP BY 1),
    b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m)
    SELECT DISTINCT l_returnflag, l_quantity, round(my + b1 * (l_quantity - centre - m1) + b2 * ((l_quantity - centre) ** 2 - m2), 6) AS fitted
    FROM lineitem JOIN b USING (l_returnflag), c
    """,
)
def g7_quadratic_fit(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", "l_quantity", "l_extendedprice")
    centred = attach(rows, rows.agg(F.avg("l_quantity").alias("centre")), [])
    x = F.col("l_quantity") - F.col("centre")
    centred = centred.withColumns({"x1": x, "x2": x * x})
    model = Model("l_extendedprice", ("x1", "x2"))
    fitted = fit_models(centred, ["l_returnflag"], [model])
    levels = centred.select("l_returnflag", "l_quantity", "x1", "x2").distinct()
    out = predict(levels, fitted, ["l_returnflag"], model, {}, "fitted")
    return out.select("l_returnflag", "l_quantity", F.round("fitted", 6).alias("fitted"))


@query("g8_log_link_glm")
def g8_log_link_glm(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("y", F.col("l_extendedprice") / 1e4)
    return coefficients(fit_log_link(rows, ["l_returnflag"], Model("y", ("l_quantity",))))


@query(
    "g8_log_link_optimum",
    "SELECT DISTINCT l_returnflag, 0.0::DOUBLE AS constant, 0.0::DOUBLE AS slope, TRUE AS converged FROM lineitem",
)
def g8_log_link_optimum(t: Tables) -> DataFrame:
    """At the least squares optimum the residuals, times the curve's slopes, sum to zero."""
    keys = ["l_returnflag"]
    rows = t.lineitem.select(*keys, "l_quantity", (F.col("l_extendedprice") / 1e4).alias("y"))
    fitted = fit_log_link(rows, keys, Model("y", ("l_quantity",)))
    given = attach(rows, fitted.select(*keys, F.col("fits")[0]["terms"]["estimate"].alias("b"), "converged"), keys)
    mu = F.exp(F.col("b")[0] + F.col("b")[1] * F.col("l_quantity"))
    pull = (F.col("y") - mu) * mu
    return given.groupBy(*keys).agg(
        F.round(F.abs(F.avg(pull)), 6).alias("constant"),
        F.round(F.abs(F.avg(pull * F.col("l_quantity"))), 5).alias("slope"),
        F.bool_and("converged").alias("converged"),
    )


@query(
    "g9_log_response",
    """
    WITH s AS (SELECT l_linestatus, ln(l_extendedprice) AS y, ln(l_quantity) AS x FROM lineitem),
    lines AS (SELECT l_linestatus AS level, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM s GROUP BY ALL),
    wide AS (SELECT max(a) FILTER (level = 'F') AS a0, max(b) FILTER (level = 'F') AS b0,
                    max(a) FILTER (level = 'O') AS a1, max(b) FILTER (level = 'O') AS b1 FROM lines)
    SELECT '(Intercept)' AS term, round(a0, 8) AS estimate FROM wide
    UNION ALL SELECT 'log_quantity', round(b0, 8) FROM wide
    UNION ALL SELECT 'l_linestatusO', round(a1 - a0, 8) FROM wide
    UNION ALL SELECT 'log_quantity:l_linestatusO', round(b1 - b0, 8) FROM wide
    """,
)
def g9_log_response(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_linestatus", F.ln("l_extendedprice").alias("log_price"), F.ln("l_quantity").alias("log_quantity"))
    fitted = fit_models(rows, [], [Model.crossed("log_price", "log_quantity", "l_linestatus")], FACTORS)
    return coefficients(fitted).select("term", F.round("estimate", 8).alias("estimate"))


@query(
    "g10_correlations",
    """
    WITH r AS (
        SELECT l_returnflag, l_linestatus, 'l_quantity' AS name, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1, 2
        UNION ALL SELECT l_returnflag, l_linestatus, 'l_tax', count(*), corr(l_tax, l_extendedprice) FROM lineitem GROUP BY 1, 2
        UNION ALL SELECT l_returnflag, l_linestatus, 'l_discount', count(*), corr(l_discount, l_extendedprice) FROM lineitem GROUP BY 1, 2
    )
    SELECT l_returnflag, l_linestatus, name, n, round(r, 8) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS statistic FROM r
    """,
)
def g10_correlations(t: Tables) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus"]
    out = correlations(t.lineitem, keys, ["l_quantity", "l_tax", "l_discount"], "l_extendedprice", alpha=0.1)
    return out.select(*keys, "name", "n", F.round("r", 8).alias("r"), F.round("statistic", 6).alias("statistic"))


@query(
    "g10_correlation_flags",
    # two-sided p by Simpson's rule over the angle whose tangent is t / sqrt(df)
    """
    WITH r AS (
        SELECT l_suppkey, 'l_quantity' AS name, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1
        UNION ALL SELECT l_suppkey, 'l_tax', count(*), corr(l_tax, l_extendedprice) FROM lineitem GROUP BY 1
    ), s AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, atan(abs(r * sqrt(1 / (1 - r * r)))) AS low FROM r),
    p AS (
        SELECT l_suppkey, name, any_value(n) AS n, any_value(r) AS r, any_value(t) AS t,
               2 * exp(lgamma((any_value(n) - 1) / 2.0) - lgamma((any_value(n) - 2) / 2.0)) / sqrt(pi()) * (pi() / 2 - any_value(low)) / 6000
               * sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                     * greatest(cos(low + (pi() / 2 - low) * i / 2000), 0) ** (n - 3)) AS p
        FROM s, range(2001) q(i) GROUP BY 1, 2
    )
    SELECT l_suppkey, name, n, round(r, 8) AS r, round(t, 6) AS statistic, round(p, 6) AS p_value, CAST(p < 0.05 AS INTEGER) AS sig FROM p
    """,
)
def g10_correlation_flags(t: Tables) -> DataFrame:
    out = correlations(t.lineitem, ["l_suppkey"], ["l_quantity", "l_tax"], "l_extendedprice", alpha=0.05)
    return _round(_round(out, 8, "r"), 6, "statistic", "p_value")


@query(
    "g11_calibration_line",
    """
    WITH fit AS (SELECT l_shipdate, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
                 FROM lineitem GROUP BY 1)
    SELECT o_orderkey, round(a + b * (o_totalprice / 20000), 3) AS mv_tris
    FROM orders LEFT JOIN fit ON l_shipdate = o_orderdate
    """,
)
def g11_calibration_line(t: Tables) -> DataFrame:
    lines = line_fit(
        t.lineitem, ["l_shipdate"], "l_extendedprice", "l_quantity"
    ).withColumnRenamed("l_shipdate", "o_orderdate")
    rows = t.orders.select("o_orderkey", "o_orderdate", (F.col("o_totalprice") / 20000).alias("lab"))
    return apply_line(rows, lines, ["o_orderdate"], "lab", "mv_tris").select("o_orderkey", F.round("mv_tris", 3).alias("mv_tris"))


@query(
    "g11_electrode_ph",
    """
    WITH fit AS (SELECT regr_slope(-l_extendedprice / 1000, l_quantity) AS b, regr_intercept(-l_extendedprice / 1000, l_quantity) AS a FROM lineitem),
    s AS (SELECT l_orderkey, l_partkey, l_suppkey, 30 + l_discount * 60 AS s, 20 + l_quantity / 5 AS c, 293.15 + l_quantity / 5 AS t,
                 -l_extendedprice / 1000 AS mv, a + b * (20 + l_quantity / 5) AS tris FROM lineitem, fit)
    SELECT l_orderkey, l_partkey, l_suppkey, round((11911.08 - 18.2499 * s - 0.039336 * s ** 2) / t - 366.27059 + 0.53993607 * s
        + 0.00016329 * s ** 2 + (64.52243 - 0.084041 * s) * ln(t) - 0.11149858 * t
        + (tris - mv) / 1000 / (8.314472 * t * ln(10) / 96485.3399), 6) AS ph
    FROM s
    """,
)
def g11_electrode_ph(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        *KEY, "l_quantity", (-F.col("l_extendedprice") / 1000).alias("mv"),
        (30 + F.col("l_discount") * 60).alias("salinity"), (20 + F.col("l_quantity") / 5).alias("lab"),
    )
    calibrated = apply_line(rows, line_fit(rows, [], "mv", "l_quantity"), [], "lab", "tris")
    ph = electrode_ph(F.col("mv"), F.col("tris"), F.col("salinity"), F.col("lab"))
    return calibrated.select(*KEY, F.round(ph, 6).alias("ph"))


@query(
    "g12_shared_slope",
    """
    WITH p AS (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
                      regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem GROUP BY 1, 2),
    b AS (SELECT l_returnflag, sum(sxy) / sum(sxx) AS slope FROM p GROUP BY 1)
    SELECT l_orderkey, l_partkey, l_suppkey, round(my - slope * mx + slope * l_quantity, 3) AS ta_pred,
           round(my - slope * mx + slope * l_quantity - l_extendedprice, 3) AS ta_pred_diff
    FROM lineitem JOIN p USING (l_returnflag, l_linestatus) JOIN b USING (l_returnflag)
    """,
)
def g12_shared_slope(t: Tables) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus"]
    lines = shared_slope(t.lineitem, ["l_returnflag"], "l_linestatus", "l_extendedprice", "l_quantity")
    rows = t.lineitem.select(*KEY, *keys, "l_quantity", "l_extendedprice")
    out = apply_line(rows, lines, keys, "l_quantity", "ta_pred", "l_extendedprice")
    return _round(out.select(*KEY, "ta_pred", "ta_pred_diff"), 3, "ta_pred", "ta_pred_diff")


@query(
    "g13_line_per_season",
    """
    WITH b AS (SELECT l_returnflag, l_linestatus, regr_slope(l_extendedprice, l_quantity) AS slope,
                      regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, l_partkey, l_suppkey, round(intercept + slope * l_quantity, 3) AS ta_mix,
           round(intercept + slope * l_quantity - l_extendedprice, 3) AS ta_mix_diff
    FROM lineitem JOIN b USING (l_returnflag, l_linestatus)
    """,
)
def g13_line_per_season(t: Tables) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus"]
    lines = line_fit(t.lineitem, keys, "l_extendedprice", "l_quantity")
    rows = t.lineitem.select(*KEY, *keys, "l_quantity", "l_extendedprice")
    out = apply_line(rows, lines, keys, "l_quantity", "ta_mix", "l_extendedprice")
    return _round(out.select(*KEY, "ta_mix", "ta_mix_diff"), 3, "ta_mix", "ta_mix_diff")


PCA_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIR = ["l_quantity", "l_extendedprice"]


@query(
    "g14_pca_percent",
    """
    WITH r AS (SELECT l_returnflag, abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem GROUP BY 1)
    SELECT l_returnflag, CAST(1 AS INTEGER) AS component, round(sqrt(1 + r), 8) AS sdev,
           round(100 * sqrt(1 + r) / (sqrt(1 + r) + sqrt(1 - r)), 1) AS percent FROM r
    UNION ALL SELECT l_returnflag, 2, round(sqrt(1 - r), 8), round(100 * sqrt(1 - r) / (sqrt(1 + r) + sqrt(1 - r)), 1) FROM r
    """,
)
def g14_pca_percent(t: Tables) -> DataFrame:
    keys = ["l_returnflag"]
    return _round(percent_explained(fit_pca(t.lineitem, keys, PAIR), keys), 8, "sdev")


@query(
    "g14_pca_scores",
    """
    WITH s AS (SELECT l_returnflag, avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_extendedprice) AS mp,
                      stddev_samp(l_extendedprice) AS sp, sign(corr(l_quantity, l_extendedprice)) AS d FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_partkey, l_suppkey,
           round(abs(((l_quantity - mq) / sq + d * (l_extendedprice - mp) / sp) / sqrt(2)), 6) AS pc1,
           round(abs(((l_quantity - mq) / sq - d * (l_extendedprice - mp) / sp) / sqrt(2)), 6) AS pc2
    FROM lineitem JOIN s USING (l_returnflag)
    """,
)
def g14_pca_scores(t: Tables) -> DataFrame:
    keys = ["l_returnflag"]
    rows = t.lineitem.select(*KEY, *keys, *PAIR)
    out = scores(rows, fit_pca(rows, keys, PAIR), keys, PAIR)
    return out.select(*KEY, F.round(F.abs("PC1"), 6).alias("pc1"), F.round(F.abs("PC2"), 6).alias("pc2"))


DIMENSIONS = [f"x{i}" for i in range(64)]


def _dimensions(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(DIMENSIONS)])


@query("g14_pca_embeddings")
def g14_pca_embeddings(t: Tables) -> DataFrame:
    rows = settle(_dimensions(t), "dimensions")
    return scores(rows, fit_pca(rows, [], DIMENSIONS), [], DIMENSIONS).select("vec_id", "PC1", "PC2")


@query(
    "g14_pca_correlations",
    """
    WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings),
    d AS (SELECT vec_id, i, CAST(v AS DOUBLE) AS v FROM e)
    SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(corr(a.v, b.v), 8) AS r
    FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2
    """,
)
def g14_pca_correlations(t: Tables) -> DataFrame:
    """The correlations of all dimensions, put together again from all components."""
    at = F.sequence(F.lit(0), F.lit(len(DIMENSIONS) - 1))
    parts = F.transform("sdev", lambda s, k: s * s * F.col("rotation")[k][F.col("i")] * F.col("rotation")[k][F.col("j")])
    pairs = fit_pca(_dimensions(t), [], DIMENSIONS).withColumn("i", F.explode(at)).withColumn("j", F.explode(at)).where("i < j")
    return pairs.select("i", "j", F.round(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b), 8).alias("r"))


LOADING_GROUPS = {"l_quantity": "Amount", "l_extendedprice": "Amount", "l_discount": "Rate", "l_tax": "Rate"}
LOADING_NAMES = {"l_quantity": "Quantity", "l_extendedprice": "Price", "l_discount": "Discount"}


@query("g15_labelled_loadings")
def g15_labelled_loadings(t: Tables) -> DataFrame:
    model = fit_pca(t.lineitem, ["l_returnflag", "l_linestatus"], PCA_COLUMNS)
    return loadings(model, ["l_returnflag", "l_linestatus"], PCA_COLUMNS, 2, LOADING_GROUPS, LOADING_NAMES)


@query(
    "g15_pair_loadings",
    """
    WITH r AS (SELECT l_returnflag, sign(corr(l_quantity, l_extendedprice)) AS d FROM lineitem GROUP BY 1)
    SELECT l_returnflag, 'l_quantity' AS label, 'Amount' AS label_group, 'Quantity' AS nice_name,
           round(sqrt(0.5), 8) AS PC1, round(sqrt(0.5), 8) AS PC2 FROM r
    UNION ALL SELECT l_returnflag, 'l_extendedprice', 'Amount', 'Price', round(d * sqrt(0.5), 8), round(-d * sqrt(0.5), 8) FROM r
    """,
)
def g15_pair_loadings(t: Tables) -> DataFrame:
    model = fit_pca(t.lineitem, ["l_returnflag"], PAIR)
    return _round(loadings(model, ["l_returnflag"], PAIR, 2, LOADING_GROUPS, LOADING_NAMES), 8, "PC1", "PC2")


PATH_MODELS = (
    Model("nn", ("si",)),
    Model("nep", ("day_night", "nn", "temperature", "day_night:nn")),
    Model("ph", ("nep", "si", "nep:si")),
    Model("nec", ("ph", "temperature")),
    Model("humics", ("day_night", "nep", "si", "day_night:nep")),
    Model("prot", ("nec", "si")),
)


def path_data(t: Tables) -> DataFrame:
    c = F.col
    rows = t.lineitem.select(
        c("l_returnflag").alias("location"),
        c("l_linestatus").alias("season"),
        F.when(c("l_linenumber") <= 3, "Day").otherwise("Night").alias("day_night"),
        F.ln(c("l_quantity")).alias("si"),
        F.ln(F.try_divide("l_extendedprice", "l_quantity")).alias("nn"),
        (c("l_tax") * 10 + c("l_linenumber")).alias("temperature"),
        (c("l_discount") - c("l_tax")).alias("nep"),
        (c("l_discount") * c("l_quantity")).alias("ph"),
        (c("l_tax") * c("l_quantity")).alias("nec"),
        (c("l_discount") + c("l_tax")).alias("humics"),
        c("l_extendedprice").alias("prot"),
    )
    return standardise(rows, ["si", "nn", "temperature", "nep", "ph", "nec", "humics", "prot"], suffix="")


@query(
    "g16_path_model_first_equation",
    """
    WITH s AS (SELECT l_returnflag AS location, l_linestatus AS season, ln(l_quantity) AS si, ln(l_extendedprice / l_quantity) AS nn FROM lineitem),
    z AS (SELECT avg(si) AS ms, stddev_samp(si) AS ss, avg(nn) AS mn, stddev_samp(nn) AS sn FROM s)
    SELECT location, season, round(regr_slope((nn - mn) / sn, (si - ms) / ss), 8) AS estimate FROM s, z GROUP BY 1, 2
    """,
)
def g16_path_model_first_equation(t: Tables) -> DataFrame:
    table = _path_coefficients(t).where((F.col("dependent") == "nn") & (F.col("term") == "si"))
    return table.select("location", "season", F.round("estimate", 8).alias("estimate"))


def _path_coefficients(t: Tables) -> DataFrame:
    return coefficients(fit_models(path_data(t), ["location", "season"], PATH_MODELS, {"day_night": ["Day", "Night"]}))


@query("g16_path_model")
def g16_path_model(t: Tables) -> DataFrame:
    return _path_coefficients(t)


@query("g16_student_residuals")
def g16_student_residuals(t: Tables) -> DataFrame:
    rows = settle(path_data(t), "paths")
    fitted = fit_student(rows, ["location", "season"], PATH_MODELS, {"day_night": ["Day", "Night"]})
    return coefficients(fitted)


def _worst_pull(rows: DataFrame, fitted: DataFrame, keys: list[str], factors: dict, nu: float | None = None) -> DataFrame:
    """Per group and equation: the largest mean product of (weighted) residuals and a design column."""
    parts = []
    for m in PATH_MODELS:
        mine = fit_summary(fitted).where(F.col("dependent") == m.response)
        spread = F.col("sigma") * F.sqrt(F.col("df_residual") / F.col("n"))
        given = predict(attach(rows, mine.select(*keys, spread.alias("_s")), keys), fitted, keys, m, factors, "_fit")
        rest = F.col(m.response) - F.col("_fit")
        if nu is not None:
            rest = rest * (nu + 1) / (nu + (rest / F.col("_s")) ** 2)
        columns = [F.lit(1.0), *[c for term in m.terms for c in term_columns(term, factors).values()]]
        pulls = [F.abs(F.avg(rest * c)) for c in columns]
        parts.append(given.groupBy(*keys).agg(F.lit(m.response).alias("dependent"), F.round(F.greatest(*pulls), 6).alias("pull")))
    return reduce(DataFrame.unionByName, parts)


_NO_PULL_SQL = """
    SELECT DISTINCT l_returnflag AS location, l_linestatus AS season, dependent, 0.0::DOUBLE AS pull
    FROM lineitem, (VALUES ('nn'), ('nep'), ('ph'), ('nec'), ('humics'), ('prot')) v(dependent)
"""


@query("g16_path_model_optimum", _NO_PULL_SQL)
def g16_path_model_optimum(t: Tables) -> DataFrame:
    """All six equations: residuals are orthogonal to every design column, over the rows of the fit."""
    keys, factors = ["location", "season"], {"day_night": ["Day", "Night"]}
    rows = path_data(t)
    rows = rows.dropna(subset=[n for n in rows.columns if n not in keys])
    return _worst_pull(rows, settle(fit_models(rows, keys, PATH_MODELS, factors)), keys, factors)


@query("g16_student_optimum", _NO_PULL_SQL)
def g16_student_optimum(t: Tables) -> DataFrame:
    """As for the plain fit, with the residuals' Student weights."""
    keys, factors = ["location", "season"], {"day_night": ["Day", "Night"]}
    rows = settle(path_data(t), "paths")
    return _worst_pull(rows, settle(fit_student(rows, keys, PATH_MODELS, factors, tolerance=1e-9)), keys, factors, 4.0)


@query(
    "g17_shortest_interval",
    """
    WITH d AS (
        SELECT event_type, value - 40 AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i,
               count(*) OVER (PARTITION BY event_type) AS n FROM events
    ), w AS (
        SELECT a.event_type, a.v AS lower, b.v AS upper,
               row_number() OVER (PARTITION BY a.event_type ORDER BY b.v - a.v, a.i) AS k
        FROM d a JOIN d b ON a.event_type = b.event_type AND b.i = a.i + CAST(floor(a.n * 0.95) AS BIGINT)
    ), m AS (SELECT event_type, count(*) AS n, quantile_cont(value - 40, 0.5) AS median FROM events GROUP BY 1)
    SELECT event_type, n, round(median, 6) AS median, round(lower, 6) AS lower, round(upper, 6) AS upper,
           CASE WHEN sign(lower) = sign(upper) THEN 'yes' ELSE 'no' END AS sig
    FROM w JOIN m USING (event_type) WHERE k = 1
    """,
)
def g17_shortest_interval(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", (F.col("value") - 40).alias("v"))
    return _round(shortest_interval(rows, ["event_type"], "v"), 6, "median", "lower", "upper")


@query(
    "g18_effect_curve",
    """
    WITH z AS (SELECT avg(l_quantity) AS mx, stddev_samp(l_quantity) AS sx, avg(l_extendedprice) AS my, stddev_samp(l_extendedprice) AS sy FROM lineitem),
    f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
                 min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1)
    SELECT l_returnflag, CAST(i AS INTEGER) AS point, round(low + (high - low) * i / 199, 6) AS x,
           round(a + b * (low + (high - low) * i / 199), 6) AS y
    FROM f, range(200) r(i)
    """,
)
def g18_effect_curve(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    stats = scale_stats(rows, ["x", "y"])
    scaled = standardise(rows, ["x", "y"], suffix="", stats=stats)
    spans = scaled.groupBy("l_returnflag").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    curve = effect_curve(line_fit(scaled, ["l_returnflag"], "y", "x"), spans, ["l_returnflag"], stats)
    return _round(curve, 6, "x", "y")


@query(
    "g18_effect_curve_interaction",
    """
    WITH r AS (SELECT l_returnflag AS f, l_quantity AS x, l_discount AS s, l_quantity * l_discount AS i, l_extendedprice AS y FROM lineitem),
    m AS (
        SELECT f, count(*) AS n, avg(x) AS mx, avg(s) AS ms, avg(i) AS mi, avg(y) AS my, stddev_samp(s) AS sd, min(x) AS low, max(x) AS high,
               regr_slope(s, x) AS b21, regr_slope(i, x) AS b31
        FROM r GROUP BY f
    ), q AS (SELECT r.*, x - mx AS q1, s - ms - b21 * (x - mx) AS q2, i - mi - b31 * (x - mx) AS rest, y - my AS cy FROM r JOIN m USING (f)),
    c AS (SELECT f, sum(rest * q2) / sum(q2 * q2) AS b32 FROM q GROUP BY f),
    o AS (SELECT f, q1, q2, rest - b32 * q2 AS q3, cy FROM q JOIN c USING (f)),
    g AS (
        SELECT f, sum(q1 * q1) AS s1, sum(q2 * q2) AS s2, sum(q3 * q3) AS s3, sum(q1 * cy) / sum(q1 * q1) AS g1,
               sum(q2 * cy) / sum(q2 * q2) AS g2, sum(q3 * cy) / sum(q3 * q3) AS g3, sum(cy * cy) AS syy
        FROM o GROUP BY f
    ), grid AS (
        SELECT m.*, c.b32, g.* EXCLUDE (f), slice, CAST(p AS INTEGER) AS point, low + (high - low) * p / 199 AS place, ms + k * sd AS held
        FROM m JOIN c USING (f) JOIN g USING (f), range(200) points(p), (VALUES ('mean-sd', -1), ('mean', 0), ('mean+sd', 1)) slices(slice, k)
    ), based AS (SELECT *, place - mx AS a1, held - ms - b21 * (place - mx) AS a2 FROM grid),
    placed AS (SELECT *, place * held - mi - b31 * a1 - b32 * a2 AS a3 FROM based),
    told AS (
        SELECT *, my + g1 * a1 + g2 * a2 + g3 * a3 AS estimate,
               sqrt((syy - g1 * g1 * s1 - g2 * g2 * s2 - g3 * g3 * s3) / (n - 4) * (1.0 / n + a1 * a1 / s1 + a2 * a2 / s2 + a3 * a3 / s3)) AS se
        FROM placed
    )
    SELECT f AS l_returnflag, slice, point, round(place, 6) AS x, round(estimate, 4) AS estimate,
           round(estimate - 1.959963984540054 * se, 4) AS lower, round(estimate + 1.959963984540054 * se, 4) AS upper
    FROM told
    """,
)
def g18_effect_curve_interaction(t: Tables) -> DataFrame:
    """Fitted on scaled variables; the curves are in original units again."""
    keys, model = ["l_returnflag"], Model.crossed("y", "x", "s")
    raw = {"x": "l_quantity", "s": "l_discount", "y": "l_extendedprice"}
    rows = t.lineitem.select(*keys, *[F.col(c).alias(n) for n, c in raw.items()])
    stats = settle(scale_stats(rows, list(raw)), "scales")
    scaled = standardise(rows, list(raw), suffix="", stats=stats)
    curves = effect_curves(scaled, fit_models(scaled, keys, [model]), keys, model, "x", by="s")
    back = unstandardise(curves, {"x": "x", "estimate": "y", "lower": "y", "upper": "y"}, stats, suffix="")
    return _round(_round(back, 6, "x"), 4, "estimate", "lower", "upper").select(*keys, "slice", "point", "x", "estimate", "lower", "upper")


@query(
    "g19_residuals_over_draws",
    """
    WITH d AS (SELECT sqrt(p_retailprice) * 90 AS b0, sqrt(p_size) AS b1, ln(p_retailprice) AS b2 FROM part),
    s AS (SELECT s_suppkey, s_acctbal AS y, s_nationkey AS x1, s_suppkey / 10.0 AS x2 FROM supplier)
    SELECT s_suppkey, round(avg(y - (b0 + b1 * x1 + b2 * x2)), 4) AS resid, round(stddev_samp(y - (b0 + b1 * x1 + b2 * x2)), 4) AS resid_sd
    FROM s, d GROUP BY s_suppkey
    """,
)
def g19_residuals_over_draws(t: Tables) -> DataFrame:
    c = F.col
    draws = t.part.select(
        (F.sqrt("p_retailprice") * 90).alias("b0"), F.sqrt("p_size").alias("b1"), F.ln("p_retailprice").alias("b2")
    )
    rows = t.supplier.select("s_suppkey", c("s_acctbal").alias("y"), c("s_nationkey").alias("x1"), (c("s_suppkey") / 10.0).alias("x2"))
    out = residual_summary(rows, draws, "y", {"b1": "x1", "b2": "x2"}, "b0")
    return _round(out.select("s_suppkey", "resid", "resid_sd"), 4, "resid", "resid_sd")


@query(
    "g20_expected_band",
    """
    WITH d AS (SELECT p_retailprice AS b0, p_size AS b1, p_retailprice / 100 - 9 AS b2 FROM part),
    g AS (SELECT x, b0 + b1 * x + b2 * z AS e FROM d, (SELECT i / 2.0 AS x FROM range(5) r(i)), (SELECT j + 1.0 AS z FROM range(3) q(j)))
    SELECT CAST(x AS DOUBLE) AS x, round(quantile_cont(e, 0.025), 6) AS lower, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.975), 6) AS upper
    FROM g GROUP BY x
    """,
)
def g20_expected_band(t: Tables) -> DataFrame:
    draws = t.part.select(
        F.col("p_retailprice").alias("b0"), F.col("p_size").alias("b1"), (F.col("p_retailprice") / 100 - 9).alias("b2")
    )
    axes = {"x": ("b1", [0, 0.5, 1, 1.5, 2]), "z": ("b2", [1, 2, 3])}
    band = expected_band(draws, "b0", axes, "x", {"lower": 0.025, "median": 0.5, "upper": 0.975})
    return _round(band, 6, "lower", "median", "upper")


DENSITY_SQL = """
    halves AS (
        SELECT event_type, CAST(floor(value / (300.0 / 63)) AS INTEGER) + k AS cell,
               CASE WHEN k = 0 THEN 1 - (value / (300.0 / 63) - floor(value / (300.0 / 63)))
                    ELSE value / (300.0 / 63) - floor(value / (300.0 / 63)) END AS weight
        FROM events, range(2) r(k)
    ), cells AS (SELECT event_type, cell, sum(weight) AS weight FROM halves GROUP BY 1, 2),
    total AS (SELECT event_type, sum(weight) AS n FROM cells GROUP BY 1),
    curve AS (
        SELECT event_type, CAST(p AS INTEGER) AS point, any_value(n) AS n,
               sum(weight * exp(-0.5 * ((p - cell) * (300.0 / 63) / 8) ** 2) / sqrt(2 * pi()) / 8 / n) AS density
        FROM cells JOIN total USING (event_type), range(64) q(p) GROUP BY 1, 2
    )
"""


@query(
    "g21_density_curve",
    f"WITH {DENSITY_SQL} SELECT event_type, point, round(density, 10) AS density FROM curve",
)
def g21_density_curve(t: Tables) -> DataFrame:
    curve = density_curve(t.events, ["event_type"], "value", 8.0, 0.0, 300.0, 64)
    return _round(curve.select("event_type", "point", "density"), 10, "density")


@query(
    "g21_density_share",
    f"""
    WITH {DENSITY_SQL}
    SELECT event_type, point, round(density * n / sum(density * n) OVER (PARTITION BY point), 8) AS share FROM curve
    """,
)
def g21_density_share(t: Tables) -> DataFrame:
    curve = share_of_total(density_curve(t.events, ["event_type"], "value", 8.0, 0.0, 300.0, 64), ["event_type"])
    return _round(curve.select("event_type", "point", "share"), 8, "share")


@query(
    "g21_bandwidth",
    """
    SELECT event_type, round(0.9 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34)
                             * count(*) ** -0.2, 8) AS bandwidth
    FROM events GROUP BY 1
    """,
)
def g21_bandwidth(t: Tables) -> DataFrame:
    return _round(rule_of_thumb_bandwidth(t.events, ["event_type"], "value"), 8, "bandwidth")


@query(
    "g21_density_surface",
    """
    WITH c AS (SELECT l_returnflag, round((l_quantity - 1) / (49.0 / 12)) AS cx, round((l_tax - 0) / (0.08 / 12)) AS cy, count(*) AS w
               FROM lineitem GROUP BY 1, 2, 3),
    n AS (SELECT l_returnflag, sum(w) AS n FROM c GROUP BY 1)
    SELECT l_returnflag, round(1 + ix * (49.0 / 12), 6) AS l_quantity, round(iy * (0.08 / 12), 8) AS l_tax,
           round(sum(w * exp(-0.5 * ((ix - cx) * (49.0 / 12) / 4) ** 2) * exp(-0.5 * ((iy - cy) * (0.08 / 12) / 0.01) ** 2)) / (2 * pi() * 4 * 0.01 * any_value(n)), 8) AS density
    FROM c JOIN n USING (l_returnflag), range(13) a(ix), range(13) b(iy) GROUP BY l_returnflag, ix, iy
    """,
)
def g21_density_surface(t: Tables) -> DataFrame:
    surface = density_surface(
        t.lineitem, ["l_returnflag"], "l_quantity", "l_tax", (4.0, 0.01), (1.0, 50.0), (0.0, 0.08), points=13
    )
    return _round(_round(surface, 6, "l_quantity"), 8, "l_tax", "density")


@query("g5_metabolism_anova")
def g5_metabolism_anova(t: Tables) -> DataFrame:
    rows = metabolism(t).withColumn("half_ta", F.col("ta_diff") / 2)
    fitted = fit_models(rows, ["location"], [Model.crossed("half_ta", "dic_diff", "season")], FACTORS)
    return anova_table(fitted)


@query(
    "g5_anova_per_location",
    f"""
    WITH {SAMPLE_SQL}, {MIXING_SQL}, {METABOLISM_SQL},
    v AS (SELECT location, season, ta_diff / 2 AS y, dic_diff AS x FROM rates WHERE ta_diff IS NOT NULL AND dic_diff IS NOT NULL),
    whole AS (SELECT location, count(*) AS n, regr_syy(y, x) AS tss, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS rss1
              FROM v GROUP BY 1),
    parts AS (SELECT location, season, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM v GROUP BY 1, 2),
    left_over AS (SELECT location, sum(syy) - sum(sxy) ** 2 / sum(sxx) AS rss2, sum(syy - sxy ** 2 / sxx) AS rss3, count(*) AS seasons
                  FROM parts GROUP BY 1),
    a AS (SELECT *, n - 2 * seasons AS df, rss3 / (n - 2 * seasons) AS ms FROM whole JOIN left_over USING (location)),
    lines AS (
        SELECT location, 'dic_diff' AS term, CAST(1 AS INTEGER) AS df, tss - rss1 AS ss, tss, ms FROM a
        UNION ALL SELECT location, 'season', 1, rss1 - rss2, tss, ms FROM a
        UNION ALL SELECT location, 'dic_diff:season', 1, rss2 - rss3, tss, ms FROM a
        UNION ALL SELECT location, 'Residuals', CAST(df AS INTEGER), rss3, tss, ms FROM a
    )
    SELECT location, term, df, round(ss / tss, 8) AS share, CASE WHEN term <> 'Residuals' THEN round(log10(ss / ms), 3) END AS log_statistic FROM lines
    """,
)
def g5_anova_per_location(t: Tables) -> DataFrame:
    """The table of g5_metabolism_anova as shares of the location's total sum of squares, F as its logarithm.

    The line explains all but a hundred-thousandth, so the SQL's differences of sums lose ten digits
    in the small terms; three digits of the logarithm are what both can give.
    """
    table = settle(g5_metabolism_anova(t), "anova")
    total = table.groupBy("location").agg(F.sum("sumsq").alias("total"))
    joined = attach(table, total, ["location"])
    share = (F.col("sumsq") / F.col("total")).alias("share")
    return _round(joined.select("location", "term", "df", share, F.round(F.log10("statistic"), 3).alias("log_statistic")), 8, "share")


@query(
    "g3_fit_summary",
    f"""
    WITH {SAMPLE_SQL}
    SELECT location, season, count(*) AS n, 'ta' AS dependent, count(*) - 2 AS df_residual, round(regr_r2(ta, dic), 8) AS r2 FROM sample GROUP BY 1, 2
    """,
)
def g3_fit_summary(t: Tables) -> DataFrame:
    fitted = fit_models(samples(t), ["location", "season"], [Model("ta", ("dic",))])
    return _round(fit_summary(fitted).drop("sigma"), 8, "r2")
