"""Linear models per group.

Rows are reduced to one moment row per group by a single distributed aggregation; the
small normal equations are then solved per group, in parallel over groups.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.functions.tails import f_upper, t_p_value, t_two_sided, z_p_value
from brackish.operators.keys import attach, join_on
from brackish.operators.moments import cross_moments, squares
from brackish.session import settle

# A column whose unexplained share falls below this is a combination of earlier ones.
ALIAS_TOLERANCE = 1e-10
INTERCEPT = "(Intercept)"


# --- straight lines -----------------------------------------------------------------


def line_fit(df: DataFrame, keys: Sequence[str], y: str, x: str, **measures: Column) -> DataFrame:
    """Intercept, slope, r2, sigma and standard errors of ``y ~ x`` per key, JVM only.

    Further aggregates of the group, over all its rows, come from the same pass as `measures`.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    own_x, own_y = F.when(both, F.col(x)), F.when(both, F.col(y))
    sums = df.groupBy(*keys).agg(
        F.count(own_x).alias("n"),
        F.avg(own_x).alias("_mx"),
        F.avg(own_y).alias("_my"),
        F.regr_sxx(own_y, own_x).alias("_sxx"),
        F.regr_sxy(own_y, own_x).alias("_sxy"),
        F.regr_syy(own_y, own_x).alias("_syy"),
        *[c.alias(name) for name, c in measures.items()],
    )
    if not measures:
        sums = sums.where("n > 0")
    sxx, sxy, syy, n = (F.col(c) for c in ("_sxx", "_sxy", "_syy", "n"))
    rss = F.greatest(syy - F.try_divide(sxy * sxy, sxx), F.lit(0.0))
    return (
        sums.withColumn("slope", F.try_divide(sxy, sxx))
        .withColumns(
            {
                "intercept": F.col("_my") - F.col("slope") * F.col("_mx"),
                "r2": F.try_divide(sxy * sxy, sxx * syy),
                "sigma": F.when(n > 2, F.sqrt(rss / (n - 2))),
            }
        )
        .withColumns(
            {
                "slope_se": F.try_divide(F.col("sigma"), F.sqrt(sxx)),
                "intercept_se": F.col("sigma") * F.sqrt(1 / n + F.try_divide(F.col("_mx") * F.col("_mx"), sxx)),
            }
        )
        .select(*keys, "n", "intercept", "slope", "r2", "sigma", "intercept_se", "slope_se", *measures)
    )


def nested_slopes(df: DataFrame, keys: Sequence[str], level: str, y: str, x: str) -> DataFrame:
    """A line for each level of a factor with one pooled residual variance (``y ~ level/x - 1``)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(level).isNotNull()
    parts = df.where(both).groupBy(*keys, level).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_sxy(y, x).alias("_sxy"),
        F.regr_syy(y, x).alias("_syy"),
    )
    sxx, sxy = F.col("_sxx"), F.col("_sxy")
    parts = parts.withColumn("_rss", F.col("_syy") - F.coalesce(F.try_divide(sxy * sxy, sxx), F.lit(0.0)))
    pooled = parts.groupBy(*keys).agg(
        F.sqrt(
            F.try_divide(
                F.sum("_rss"), F.sum("n") - F.count(F.lit(1)) - F.count(F.when(sxx > 0, 1))
            )
        ).alias("sigma")
    )
    return (
        attach(parts, pooled, keys)
        .withColumn("slope", F.try_divide(sxy, sxx))
        .withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
        .withColumn("slope_se", F.try_divide(F.col("sigma"), F.sqrt(sxx)))
        .select(*keys, level, "n", "intercept", "slope", "sigma", "slope_se")
    )


def shared_slope(df: DataFrame, keys: Sequence[str], level: str, y: str, x: str) -> DataFrame:
    """One slope per key, one intercept per level."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    parts = df.where(both).groupBy(*keys, level).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_sxy(y, x).alias("_sxy"),
    )
    slope = parts.groupBy(*keys).agg(F.try_divide(F.sum("_sxy"), F.sum("_sxx")).alias("slope"))
    return attach(parts, slope, keys).select(
        *keys, level, "n", "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept")
    )


def apply_line(
    df: DataFrame, lines: DataFrame, keys: Sequence[str], x: str, name: str, y: str | None = None
) -> DataFrame:
    """Predicted value of each row from its group's line, and predicted minus observed if `y` is given."""
    out = attach(df, lines.select(*keys, "intercept", "slope"), keys)
    out = out.withColumn(name, F.col("intercept") + F.col("slope") * F.col(x)).drop("intercept", "slope")
    return out.withColumn(f"{name}_diff", F.col(name) - F.col(y)) if y else out


# --- models with several terms --------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """``response ~ terms``. A term joins variables with ``:``; `factors` lists sorted levels."""

    response: str
    terms: tuple[str, ...]

    @staticmethod
    def crossed(response: str, *variables: str, extra: Sequence[str] = ()) -> "Model":
        """All variables and all their interactions, lower orders first, then `extra` terms."""
        terms = [":".join(c) for r in range(1, len(variables) + 1) for c in itertools.combinations(variables, r)]
        mains = [t for t in terms if ":" not in t]
        return Model(response, (*mains, *extra, *[t for t in terms if ":" in t]))


Factors = Mapping[str, Sequence[str]]


def term_columns(term: str, factors: Factors) -> dict[str, Column]:
    """Design columns of a term under treatment coding: the first level is the reference."""
    expanded = [
        [(f"{v}{level}", F.when(F.col(v).isNotNull(), (F.col(v) == level).cast("double"))) for level in factors[v][1:]]
        if v in factors
        else [(v, F.col(v).cast("double"))]
        for v in term.split(":")
    ]
    return {
        ":".join(label for label, _ in combo): reduce(mul, [c for _, c in combo])
        for combo in itertools.product(*expanded)
    }


@dataclass(frozen=True)
class _Equation:
    response: str
    at_response: int
    terms: tuple[str, ...]  # term of each column
    labels: tuple[str, ...]
    at: tuple[int, ...]


_TERM = pa.struct(
    [("term", pa.string())]
    + [(n, pa.float64()) for n in ("estimate", "std_error", "statistic", "p_value")]
)
_ANOVA = pa.struct(
    [("term", pa.string()), ("df", pa.int32())]
    + [(n, pa.float64()) for n in ("sumsq", "meansq", "statistic", "p_value")]
)
_FIT = pa.struct(
    [
        ("dependent", pa.string()),
        ("df_residual", pa.int64()),
        ("sigma", pa.float64()),
        ("r2", pa.float64()),
        ("terms", pa.list_(_TERM)),
        ("vcov", pa.list_(pa.float64())),
        ("anova", pa.list_(_ANOVA)),
    ]
)
_FIT_DDL = (
    "array<struct<dependent:string,df_residual:bigint,sigma:double,r2:double,"
    "terms:array<struct<term:string,estimate:double,std_error:double,statistic:double,p_value:double>>,"
    "vcov:array<double>,"
    "anova:array<struct<term:string,df:int,sumsq:double,meansq:double,statistic:double,p_value:double>>>>"
)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quotients, NaN where they are not finite."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = a / b
    return np.where(np.isfinite(out), out, np.nan)


def _p_values(function: Callable[..., np.ndarray], statistic: np.ndarray, *df: np.ndarray) -> np.ndarray:
    out = np.full(statistic.shape, np.nan)
    known = np.isfinite(statistic) & (df[-1] > 0)
    if known.any():
        out[known] = function(statistic[known], *[np.broadcast_to(d, statistic.shape)[known] for d in df])
    return out


def _solve(eq: _Equation, n: np.ndarray, total: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> list[dict]:
    """Coefficients, their covariance and sequential sums of squares, for a batch of groups.

    `total` is the sum of the weights; it equals `n` where rows are not weighted.
    """
    at = [*eq.at, eq.at_response]
    cross, centre, p = cov[:, at][:, :, at] * total[:, None, None], mean[:, at], len(eq.at)
    left = cross.copy()
    kept, sequential = np.zeros((len(n), p), bool), np.zeros((len(n), p))
    for j in range(p):
        pivot = left[:, j, j].copy()
        keep = (pivot > ALIAS_TOLERANCE * cross[:, j, j]) & (cross[:, j, j] > 0)
        safe = np.where(keep, pivot, 1.0)
        sequential[:, j] = np.where(keep, left[:, j, p] ** 2 / safe, 0.0)
        step = left[:, :, j, None] * left[:, j, None, :] / safe[:, None, None]
        left = np.where(keep[:, None, None], left - step, left)
        kept[:, j] = keep
    explained = cross[:, p, p]
    rss = np.maximum(left[:, p, p], 0.0)
    df_residual = n - kept.sum(1) - 1
    sigma2 = np.where(df_residual > 0, rss / np.maximum(df_residual, 1), np.nan)

    # an aliased column gets a unit row, so that all groups are inverted at once
    both = kept[:, :, None] & kept[:, None, :]
    scale = np.where(kept, np.sqrt(np.where(kept, cross[:, range(p), range(p)], 1.0)), 1.0)
    unit = scale[:, :, None] * scale[:, None, :]
    inverse = np.linalg.inv(np.where(both, cross[:, :p, :p] / unit, np.eye(p))) / unit
    inverse = np.where(both, inverse, 0.0)
    slopes = np.einsum("gij,gj->gi", inverse, np.where(kept, cross[:, :p, p], 0.0))
    where = np.concatenate([np.ones((len(n), 1), bool), kept], axis=1)
    beta = np.concatenate([(centre[:, p] - (centre[:, :p] * slopes).sum(1))[:, None], slopes], axis=1)
    with_mean = np.einsum("gij,gj->gi", inverse, centre[:, :p])
    vcov = np.zeros((len(n), p + 1, p + 1))
    vcov[:, 0, 0] = 1.0 / total + (centre[:, :p] * with_mean).sum(1)
    vcov[:, 0, 1:] = vcov[:, 1:, 0] = -with_mean
    vcov[:, 1:, 1:] = inverse
    vcov = np.where(where[:, :, None] & where[:, None, :], vcov * sigma2[:, None, None], np.nan)
    beta = np.where(where, beta, np.nan)

    variance = vcov[:, range(p + 1), range(p + 1)]
    se = np.where(variance >= 0, np.sqrt(np.where(variance >= 0, variance, 0.0)), np.nan)
    statistic = _ratio(beta, se)
    p_value = _p_values(t_two_sided, statistic, df_residual[:, None])
    names = list(dict.fromkeys(eq.terms))
    columns = [[j for j in range(p) if eq.terms[j] == t] for t in names]
    df = np.array([kept[:, c].sum(1) for c in columns]).reshape(len(names), len(n)).T
    ss = np.array([sequential[:, c].sum(1) for c in columns]).reshape(len(names), len(n)).T
    ms = _ratio(ss, df)
    f = _ratio(ms, sigma2[:, None])
    f_p = _p_values(f_upper, f, df, df_residual[:, None])
    r2 = _ratio(explained - rss, explained)

    def number(v: float) -> float | None:
        return float(v) if math.isfinite(v) else None

    out = []
    for g in range(len(n)):
        terms = [
            dict(zip(("term", "estimate", "std_error", "statistic", "p_value"), (label, *map(number, row))))
            for label, *row in zip((INTERCEPT, *eq.labels), beta[g], se[g], statistic[g], p_value[g])
        ]
        anova = [
            dict(zip(("term", "df", "sumsq", "meansq", "statistic", "p_value"), (t, int(d), *map(number, row))))
            for t, d, *row in zip(names, df[g], ss[g], ms[g], f[g], f_p[g])
            if d
        ]
        anova.append(
            {
                "term": "Residuals", "df": int(df_residual[g]), "sumsq": float(rss[g]), "meansq": number(sigma2[g]),
                "statistic": None, "p_value": None,
            }
        )
        out.append(
            {
                "dependent": eq.response,
                "df_residual": int(df_residual[g]),
                "sigma": number(np.sqrt(sigma2[g])),
                "r2": number(r2[g]),
                "terms": terms,
                "vcov": [number(v) for v in vcov[g].ravel()],
                "anova": anova,
            }
        )
    return out


def _design(models: Sequence[Model], factors: Factors) -> tuple[list[Column], list[_Equation]]:
    """The distinct columns of all models, and where each model finds its own."""
    design: dict[str, Column] = {}
    equations = []
    for m in models:
        terms, labels = [], []
        for term in m.terms:
            columns = term_columns(term, factors)
            design.update(columns)
            terms += [term] * len(columns)
            labels += columns
        design[m.response] = F.col(m.response).cast("double")
        equations.append((m.response, terms, labels))
    names = list(design)
    plan = [
        _Equation(y, names.index(y), tuple(t), tuple(ls), tuple(names.index(label) for label in ls))
        for y, t, ls in equations
    ]
    return list(design.values()), plan


def _wanted(plan: Sequence[_Equation]) -> list[tuple[int, int]]:
    """The column pairs whose covariances the equations need."""
    return sorted({tuple(sorted(pair)) for eq in plan for pair in itertools.product((*eq.at, eq.at_response), repeat=2)})


def _solved(
    moments: DataFrame, keys: Sequence[str], size: int, sets: Sequence[tuple[str, Sequence[_Equation], list[tuple[int, int]]]]
) -> DataFrame:
    """``keys, n, fits`` from moment columns; each set names the suffix of its columns, its
    equations and the pairs its ``cov`` lists. ``n`` is that of the first set."""
    key_list = list(keys)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for suffix, plan, wanted in sets:
                count = np.array(batch.column(f"n{suffix}").to_pylist(), dtype=np.int64)
                some = np.flatnonzero(count)
                picked = batch.take(pa.array(some))
                mean = np.array(picked.column(f"mean{suffix}").to_pylist(), dtype=float).reshape(len(some), size)
                cov = squares(picked.column(f"cov{suffix}").to_pylist(), size, wanted)
                total = np.array(picked.column(f"total{suffix}").to_pylist(), dtype=float)
                for eq in plan if len(some) else ():
                    for g, fit in zip(some, _solve(eq, count[some], total, mean, cov)):
                        fits[g].append(fit)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in key_list], batch.column(f"n{sets[0][0]}"), pa.array(fits, pa.list_(_FIT))],
                names=[*key_list, "n", "fits"],
            )

    ddl = ", ".join([f"`{k}` {moments.schema[k].dataType.simpleString()}" for k in key_list] + ["n bigint", f"fits {_FIT_DDL}"])
    return moments.mapInArrow(solve, ddl)


def fit_models(
    df: DataFrame, keys: Sequence[str], models: Sequence[Model], factors: Factors | None = None, weight: str | None = None
) -> DataFrame:
    """Fit every model in every group from one aggregation: ``keys, n, fits``.

    Rows with a NULL in any variable of any model are left out of all of them.
    """
    columns, plan = _design(models, factors or {})
    internal = [f"_d{i}" for i in range(len(columns))]
    rows = df.select(*keys, *([weight] if weight else []), *[c.alias(i) for i, c in zip(internal, columns)])
    wanted = _wanted(plan)
    return _solved(cross_moments(rows, keys, internal, weight, wanted), keys, len(columns), [("", plan, wanted)])


def _fits(fitted: DataFrame) -> DataFrame:
    keys = fitted.columns[: fitted.columns.index("n")]
    told = [c for c in fitted.columns if c == "converged"]
    return fitted.select(*keys, "n", *told, F.inline("fits"))


def coefficients(fitted: DataFrame) -> DataFrame:
    """``keys, dependent, term, estimate, std_error, statistic, p_value``, and ``converged`` of
    fits that were iterated."""
    keys = fitted.columns[: fitted.columns.index("n")]
    told = [c for c in fitted.columns if c == "converged"]
    return _fits(fitted).select(*keys, "dependent", *told, F.inline("terms"))


def anova_table(fitted: DataFrame) -> DataFrame:
    """Sequential sums of squares in term order, with the residual line."""
    keys = fitted.columns[: fitted.columns.index("n")]
    return _fits(fitted).select(*keys, "dependent", F.inline("anova"))


def fit_summary(fitted: DataFrame) -> DataFrame:
    """``keys, n, dependent, df_residual, sigma, r2``."""
    return _fits(fitted).drop("terms", "vcov", "anova")


def marginal_effects(fitted: DataFrame, model: Model, variable: str, factors: Factors, alpha: float = 0.05) -> DataFrame:
    """Slope of `variable` at every combination of factor levels, with delta-method error.

    The slope is a fixed combination of coefficients, so it is an expression on the
    coefficient table.
    """
    keys = fitted.columns[: fitted.columns.index("n")]
    labels = [INTERCEPT, *[label for t in model.terms for label in term_columns(t, factors)]]
    involved = [t.split(":") for t in model.terms if variable in t.split(":")]
    others = list(dict.fromkeys(v for t in involved for v in t if v != variable))
    if any(v not in factors for v in others):
        raise ValueError("only interactions with factors are supported")

    def active(term: list[str], levels: Mapping[str, str]) -> str | None:
        if any(v in factors and levels[v] == factors[v][0] for v in term):
            return None
        return ":".join(f"{v}{levels[v]}" if v in factors else v for v in term)

    rows, p = [], len(labels)
    for combo in itertools.product(*[factors[v] for v in others]):
        levels = dict(zip(others, combo))
        at = [labels.index(name) for name in (active(t, levels) for t in involved) if name]
        effect = reduce(add, [F.col("terms")[i]["estimate"] for i in at])
        variance = reduce(add, [F.col("vcov")[i * p + j] for i in at for j in at])
        rows.append(
            F.struct(
                *[F.lit(levels[v]).alias(v) for v in others],
                effect.alias("effect"),
                F.sqrt(variance).alias("std_error"),
            )
        )
    table = _fits(fitted).select(*keys, "dependent", F.inline(F.array(*rows)))
    return table.withColumn("p_value", z_p_value(F.try_divide(F.col("effect"), F.col("std_error")))).withColumn(
        "sig", F.when(F.col("p_value") <= alpha, "yes").when(F.col("p_value").isNotNull(), "no")
    )


def _fitted_value(model: Model, factors: Factors) -> Column:
    """Fitted value from the coefficient array ``_b``; aliased coefficients count as zero."""
    columns = [c for t in model.terms for c in term_columns(t, factors).values()]
    parts = [F.coalesce(F.col("_b")[i + 1], F.lit(0.0)) * c for i, c in enumerate(columns)]
    return reduce(add, parts, F.col("_b")[0])


def predict(df: DataFrame, fitted: DataFrame, keys: Sequence[str], model: Model, factors: Factors, name: str) -> DataFrame:
    """Fitted value of each row; coefficients dropped as aliased count as zero."""
    mine = _fits(fitted).where(F.col("dependent") == model.response).select(*keys, F.col("terms.estimate").alias("_b"))
    return attach(df, mine, keys).withColumn(name, _fitted_value(model, factors)).drop("_b")


Score = Callable[[Column, Column, Column], tuple[Column, Column]]


def _beside(df: DataFrame, settled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`attach` for a table that is settled already."""
    return join_on(df, settled, keys, "left") if keys else attach(df, settled, [])


def _reweighted(
    df: DataFrame, keys: Sequence[str], models: Sequence[Model], factors: Factors, tolerance: float, most: int, start: Score, score: Score
) -> DataFrame:
    """Fits that are repeated, with weights from the last fit, until no coefficient moves.

    ``score(observed, fitted, sigma)`` gives the response and the weight of the next pass. The
    design columns, less their group's means, are written once; a pass joins the small table of
    the last fits and is one aggregation for all models and groups. A row counts for the models
    whose variables it has. The result has a column ``converged``: whether the coefficients moved
    by less than `tolerance` times their size (at least one) in the last pass.
    """
    columns, plan = _design(models, factors)
    size, span = len(columns), range(len(columns))
    base = df.select(*keys, *[c.alias(f"_d{i}") for i, c in enumerate(columns)])
    centres = settle(base.groupBy(*keys).agg(F.array(*[F.coalesce(F.avg(f"_d{i}"), F.lit(0.0)) for i in span]).alias("_c")))
    rows = _beside(base, centres, keys).select(*keys, *[(F.col(f"_d{i}") - F.col("_c")[i]).alias(f"_d{i}") for i in span])
    rows = settle(rows, "design")
    pairs_of = [_wanted([eq]) for eq in plan]

    def refit(last: DataFrame, rule: Score) -> DataFrame:
        given = _beside(rows, last, keys)
        weighed, sums, out = {}, [], []
        for k, (eq, wanted) in enumerate(zip(plan, pairs_of)):
            whole = reduce(lambda x, y: x & y, [F.col(f"_d{i}").isNotNull() for i in (*eq.at, eq.at_response)])
            b, centre = F.col("_b")[k], F.col("_c")[eq.at_response]
            fit = reduce(add, [F.coalesce(b[j + 1], F.lit(0.0)) * (F.col(f"_d{i}") + F.col("_c")[i]) for j, i in enumerate(eq.at)], b[0])
            response, weight = rule(F.col(f"_d{eq.at_response}") + centre, fit, F.col("_sigma")[k])
            weighed |= {f"_y{k}": response - centre, f"_w{k}": F.when(whole, weight)}
            x = {i: f"_d{i}" for i in eq.at} | {eq.at_response: f"_y{k}"}
            sums += [
                F.expr(f"count(_w{k}) AS n{k}"),
                F.expr(f"sum(_w{k}) AS total{k}"),
                F.expr(f"array({', '.join(f'sum(_w{k} * {x[i]})' if i in x else '0D' for i in span)}) AS _s{k}"),
                F.expr(f"array({', '.join(f'sum(_w{k} * {x[i]} * {x[j]})' for i, j in wanted)}) AS _p{k}"),
            ]
            cov = ", ".join(f"_p{k}[{at}] / total{k} - (_s{k}[{i}] / total{k}) * (_s{k}[{j}] / total{k})" for at, (i, j) in enumerate(wanted))
            out += [
                f"n{k}", f"total{k}", F.expr(f"zip_with(_s{k}, _c, (s, c) -> c + s / total{k}) AS mean{k}"), F.expr(f"array({cov}) AS cov{k}")
            ]
        moments = _beside(given.withColumns(weighed).groupBy(*keys).agg(*sums), centres, keys).select(*keys, *out)
        return settle(_solved(moments, keys, size, [(str(k), [eq], w) for k, (eq, w) in enumerate(zip(plan, pairs_of))]))

    def table(fitted: DataFrame) -> DataFrame:
        fits = F.transform("fits", lambda f: f["terms"]["estimate"])
        # the weights' own spread: their sum stands for the number of rows
        sigma = F.transform("fits", lambda f: f["sigma"] * F.sqrt(f["df_residual"] / F.col("n")))
        return settle(_beside(fitted.select(*keys, fits.alias("_b"), sigma.alias("_sigma")), centres, keys))

    none = F.array(*[F.array(*[F.lit(0.0)] * (len(eq.at) + 1)) for eq in plan])
    begin = settle(centres.withColumns({"_b": none, "_sigma": F.array(*[F.lit(1.0)] * len(plan))}))
    fitted = refit(begin, start)
    last, told = table(fitted), None
    step = F.expr(
        "aggregate(zip_with(flatten(_b), flatten(_p), (x, y) -> abs(x - y) / greatest(1D, abs(y))), 0D, (m, d) -> greatest(m, coalesce(d, 0D)))"
    )
    for _ in range(most):
        fitted = refit(last, score)
        now = table(fitted)
        told = settle(_beside(now, last.select(*keys, F.col("_b").alias("_p")), keys).select(*keys, (step < tolerance).alias("converged")))
        last = now
        if told.where("NOT converged").isEmpty():
            break
    return _beside(fitted, told, keys)


def _plain(observed: Column, fitted: Column, sigma: Column) -> tuple[Column, Column]:
    return observed, F.lit(1.0)


def fit_student(
    df: DataFrame,
    keys: Sequence[str],
    models: Model | Sequence[Model],
    factors: Factors | None = None,
    nu: float = 4.0,
    tolerance: float = 1e-8,
    most: int = 200,
) -> DataFrame:
    """Regressions with Student-t residuals (`nu` degrees of freedom), each with its own weights."""
    models = [models] if isinstance(models, Model) else list(models)

    def score(observed: Column, fitted: Column, sigma: Column) -> tuple[Column, Column]:
        ratio = F.try_divide(observed - fitted, sigma)
        return observed, (nu + 1) / (nu + F.coalesce(ratio * ratio, F.lit(0.0)))

    return _reweighted(df, keys, models, factors or {}, tolerance, most, _plain, score)


def fit_log_link(
    df: DataFrame,
    keys: Sequence[str],
    model: Model,
    factors: Factors | None = None,
    tolerance: float = 1e-10,
    most: int = 100,
) -> DataFrame:
    """Gaussian model with a log link, ``log(E[y]) = terms``, by reweighted least squares.

    Starts from the regression of log y, so y must be positive.
    """

    def start(observed: Column, fitted: Column, sigma: Column) -> tuple[Column, Column]:
        return F.ln(observed), F.lit(1.0)

    def score(observed: Column, fitted: Column, sigma: Column) -> tuple[Column, Column]:
        return fitted + (observed - F.exp(fitted)) / F.exp(fitted), F.exp(2 * fitted)

    rows = df.where(F.col(model.response) > 0)
    return _reweighted(rows, keys, [model], factors or {}, tolerance, most, start, score)


# --- correlation ---------------------------------------------------------------------


def correlations(df: DataFrame, keys: Sequence[str], columns: Sequence[str], against: str, alpha: float) -> DataFrame:
    """Pearson r of each column with `against` per key: ``name, n, r, statistic, p_value, sig``.

    Aggregated wide, reshaped after: the data is not unpivoted.
    """
    a = F.col(against)
    wide = df.groupBy(*keys).agg(
        *[
            F.struct(
                F.count(F.when(a.isNotNull(), F.col(c))).alias("n"),
                F.corr(c, against).alias("r"),
            ).alias(c)
            for c in columns
        ]
    )
    long = wide.select(
        *keys, F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c)["n"].alias("n"), F.col(c)["r"].alias("r")) for c in columns]))
    )
    r, n = F.col("r"), F.col("n")
    statistic = F.when((n > 2) & (r * r < 1), r * F.sqrt((n - 2) / (1 - r * r)))
    return (
        long.withColumn("statistic", statistic)
        .withColumn("p_value", t_p_value(F.col("statistic"), (n - 2).cast("double")))
        .withColumn("sig", (F.col("p_value") < alpha).cast("int"))
    )
