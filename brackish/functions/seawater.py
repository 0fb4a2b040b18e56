"""Seawater density and electrode pH as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Horner form, lowest power first."""
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


# UNESCO EOS-80 one-atmosphere equation of state (Millero & Poisson 1981).
_PURE = (999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9)
_S1 = (0.824493, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9)
_S15 = (-5.72466e-3, 1.0227e-4, -1.6546e-6)
_S2 = 4.8314e-4


def density(salinity: Column, temperature: Column) -> Column:
    """kg/m3 at the surface."""
    return (
        _poly(temperature, _PURE)
        + _poly(temperature, _S1) * salinity
        + _poly(temperature, _S15) * salinity * F.sqrt(salinity)
        + _S2 * salinity * salinity
    )


# Gas and Faraday constants.
_GAS = 8.314472
_FARADAY = 96485.3399


def tris_ph(salinity: Column, temperature: Column) -> Column:
    """Total-scale pH of the Tris buffer (DelValls & Dickson 1998)."""
    s, t = salinity, temperature + 273.15
    return (
        (11911.08 - 18.2499 * s - 0.039336 * s * s) / t
        - 366.27059
        + 0.53993607 * s
        + 0.00016329 * s * s
        + (64.52243 - 0.084041 * s) * F.ln(t)
        - 0.11149858 * t
    )


def electrode_ph(millivolt: Column, tris_millivolt: Column, salinity: Column, temperature: Column) -> Column:
    """Sample pH from its reading and the buffer's reading at the same temperature."""
    nernst = _GAS * (temperature + 273.15) * F.ln(F.lit(10.0)) / _FARADAY
    return tris_ph(salinity, temperature) + (tris_millivolt - millivolt) / 1000 / nernst
