"""Derived columns for light, mixing, metabolism and nutrients."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from brackish.functions.nulls import clamp_below, safe_divide


@dataclass(frozen=True)
class LightCurve:
    """PAR = ceiling * (1 - exp(-exp(rate) * lux))."""

    ceiling: float
    rate: float


# Calibrated light curves of the two seasons.
LIGHT_CURVES = {
    "Dry": LightCurve(16778.33, -13.29572),
    "Wet": LightCurve(1555.751648, -10.777624),
}
# Reference salinity, open-ocean silicate.
REFERENCE_SALINITY = 36.0
OCEAN_SILICATE = 0.965


def fill_par(par: Column, lux: Column, season: Column, curves: dict[str, LightCurve] = LIGHT_CURVES) -> Column:
    """Measured PAR, or the season's curve of lux where PAR is missing; never negative."""
    modelled = F.lit(None).cast("double")
    for name, curve in curves.items():
        value = curve.ceiling * (1 - F.exp(-F.exp(F.lit(curve.rate)) * lux))
        modelled = F.when(season == name, value).otherwise(modelled)
    return clamp_below(F.coalesce(par, modelled))


def salinity_normalised(value: Column, salinity: Column, reference: float = REFERENCE_SALINITY) -> Column:
    return value * salinity / reference


def log_ratio(num: Column, den: Column) -> Column:
    """Log of the ratio after adding one to both sides."""
    return F.ln((num + 1) / (den + 1))


def mixing_corrected(
    value: Column, end_value: Column, silicate: Column, end_silicate: Column, ocean: float = OCEAN_SILICATE
) -> Column:
    """Value with the fresh end member's share (read from silicate) taken out."""
    return value + (value - end_value) * safe_divide(silicate - ocean, end_silicate - silicate)


def residence_time(speed: Column, length: Column) -> Column:
    """length / (speed * 60): minutes for m and m/s; zero speed gives NULL."""
    return safe_divide(length, speed * 60)


def calcification(rho: Column, depth: Column, d_ta: Column, tau: Column) -> Column:
    return safe_divide(rho * depth * d_ta, 2 * tau) / 1000


def production(rho: Column, depth: Column, d_dic: Column, d_ta: Column, tau: Column) -> Column:
    return safe_divide(rho * depth * production_proxy(d_dic, d_ta), tau) / 1000


def calcification_proxy(d_ta: Column) -> Column:
    return d_ta / 2


def production_proxy(d_dic: Column, d_ta: Column) -> Column:
    return d_dic - d_ta / 2


def organic_nitrogen(total: Column, nitrate: Column, ammonium: Column) -> Column:
    return total - (nitrate + ammonium)


def organic_phosphorus(total: Column, phosphate: Column) -> Column:
    return total - phosphate
