"""Tail probabilities of t, F and normal statistics, over arrays."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Above this first parameter the gamma limit of the beta function is exact to rounding.
_LARGE = 1e6
_TINY = 1e-300


def _each(function: Callable[[float], float], x: np.ndarray) -> np.ndarray:
    return np.array([function(v) for v in np.ravel(x)], float).reshape(np.shape(x))


def _lgamma(x: np.ndarray) -> np.ndarray:
    return _each(math.lgamma, x)


def _erfc(x: np.ndarray) -> np.ndarray:
    return _each(math.erfc, x)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz).

    An entry is done when it has settled: rounding may move it again later, so entries of a batch
    need not all stand still at one step.
    """

    def away(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) > _TINY, v, _TINY)

    c, d = np.ones_like(x), 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
    now, out, left = d.copy(), np.empty_like(x), np.arange(len(x))
    for m in range(1, 20_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d, c = 1.0 / away(1.0 + step * d), away(1.0 + step / c)
            now = now * c * d
        moves = ~(np.abs(c * d - 1.0) < 1e-15) & ~np.isnan(now)
        if not moves.all():
            out[left[~moves]] = now[~moves]
            a, b, x, c, d, now, left = (v[moves] for v in (a, b, x, c, d, now, left))
        if not len(left):
            return out
    raise ArithmeticError("the continued fraction of the beta function has not settled")


def upper_gamma(s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function for half-integer s: recurrence from s or s + 1."""
    s, y = np.broadcast_arrays(np.asarray(s, float), np.asarray(y, float))
    half = s % 1 != 0
    out = np.where(half, _erfc(np.sqrt(y)), np.exp(-y))
    at = np.where(half, 0.5, 1.0)
    with np.errstate(divide="ignore"):
        log_y = np.log(y)
    while np.any(at < s):
        grown = np.exp(np.where(y > 0, at * log_y, -np.inf) - y - _lgamma(at + 1.0))
        out, at = np.where(at < s, out + grown, out), np.where(at < s, at + 1.0, at)
    return np.minimum(out, 1.0)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, rest: np.ndarray | None = None) -> np.ndarray:
    """Regularised incomplete beta function; for large `a` (then `b` a multiple of 1/2) its gamma limit.

    `rest` is 1 - x, for callers that know it without cancellation.
    """
    rest = 1.0 - np.asarray(x, float) if rest is None else rest
    a, b, x, rest = (np.array(v, float, ndmin=1) for v in np.broadcast_arrays(a, b, x, rest))
    out = np.where(rest <= 0.0, 1.0, np.where(x <= 0.0, 0.0, np.nan))
    inner = (x > 0.0) & (rest > 0.0)
    large = inner & (a > _LARGE)
    out[large] = upper_gamma(b[large], -(a[large] + (b[large] - 1.0) / 2.0) * np.log1p(-rest[large]))
    inner &= ~large
    low = inner & (x < (a + 1.0) / (a + b + 2.0))
    for rows, flip in ((low, False), (inner & ~low, True)):
        p, q, v, w = a[rows], b[rows], x[rows], rest[rows]
        if not len(v):
            continue
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(v) + q * np.log(w))
        out[rows] = 1.0 - front * _beta_fraction(q, p, w) / q if flip else front * _beta_fraction(p, q, v) / p
    return out


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def f_upper(f: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    f, df1, df2 = (np.asarray(v, float) for v in (f, df1, df2))
    scaled = df1 * np.maximum(f, 0.0)
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + scaled), scaled / (df2 + scaled))


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    known = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if known.any():
        out[known] = t_two_sided(t[known].to_numpy(), df[known].to_numpy())
    return out.where(known, None)


@F.pandas_udf(DoubleType())
def z_p_value(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore").astype("float64")
