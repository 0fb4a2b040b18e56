"""Carbonate system from pH and total alkalinity, closed form, surface pressure.

Equilibrium constants on the total pH scale, from the published papers named at each one.
Everything is a column expression: no iteration and no Python worker.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Validity of the Lueker et al. (2000) constants.
LUEKER_TEMPERATURE = (2.0, 35.0)
LUEKER_SALINITY = (19.0, 43.0)
# Validity of the Perez & Fraga (1987) constant.
PEREZ_TEMPERATURE = (9.0, 33.0)
PEREZ_SALINITY = (10.0, 40.0)


class Water(NamedTuple):
    """Salinity and absolute temperature with the two functions of them every constant needs."""

    s: Column
    t: Column
    log_t: Column
    root_s: Column


def water(salinity: Column, kelvin: Column) -> Water:
    return Water(salinity, kelvin, F.ln(kelvin), F.sqrt(salinity))


def _ionic_strength(s: Column) -> Column:
    return 19.924 * s / (1000 - 1.005 * s)


def total_sulfate(s: Column) -> Column:
    return s * (0.14 / 96.062 / 1.80655)


def total_fluoride(s: Column) -> Column:
    return s * (0.000067 / 18.998 / 1.80655)


def total_boron(s: Column) -> Column:
    """Uppström (1974)."""
    return s * (0.000232 / 10.811 / 1.80655)


def total_calcium(s: Column) -> Column:
    return s * (0.02127 / 40.078 / 1.80655)


def k_sulfate(w: Water) -> Column:
    """Dickson (1990), free scale."""
    s, t = w.s, w.t
    i = _ionic_strength(s)
    return F.exp(
        -4276.1 / t + 141.328 - 23.093 * w.log_t
        + (-13856 / t + 324.57 - 47.986 * w.log_t) * F.sqrt(i)
        + (35474 / t - 771.54 + 114.723 * w.log_t) * i
        - 2698 / t * i * F.sqrt(i)
        + 1776 / t * i * i
        + F.ln(1 - 0.001005 * s)
    )


def k_fluoride(w: Water) -> Column:
    """Dickson & Riley (1979) as in Dickson & Goyet (1994), free scale."""
    s, t = w.s, w.t
    return F.exp(1590.2 / t - 12.641 + 1.525 * F.sqrt(_ionic_strength(s)) + F.ln(1 - 0.001005 * s))


def k_fluoride_total(w: Water) -> Column:
    """Perez & Fraga (1987), total scale."""
    return F.exp(874 / w.t - 9.68 + 0.111 * w.root_s)


def k_phosphoric(w: Water) -> tuple[Column, Column, Column]:
    """Dickson, Sabine & Christian (2007), total scale."""
    s, t, r = w.s, w.t, w.root_s
    return (
        F.exp(-4576.752 / t + 115.525 - 18.453 * w.log_t + (-106.736 / t + 0.69171) * r + (-0.65643 / t - 0.01844) * s),
        F.exp(-8814.715 / t + 172.0883 - 27.927 * w.log_t + (-160.340 / t + 1.3566) * r + (0.37335 / t - 0.05778) * s),
        F.exp(-3070.75 / t - 18.141 + (17.27039 / t + 2.81197) * r + (-44.99486 / t - 0.09984) * s),
    )


def k_silicic(w: Water) -> Column:
    """Dickson, Sabine & Christian (2007), total scale."""
    t, i = w.t, _ionic_strength(w.s)
    return F.exp(
        -8904.2 / t + 117.385 - 19.334 * w.log_t
        + (-458.79 / t + 3.5913) * F.sqrt(i)
        + (188.74 / t - 1.5998) * i
        + (-12.1652 / t + 0.07871) * i * i
        + F.ln(1 - 0.001005 * w.s)
    )


def k_boric(w: Water) -> Column:
    """Dickson (1990), total scale."""
    s, t = w.s, w.t
    r = w.root_s
    return F.exp(
        (-8966.90 - 2890.53 * r - 77.942 * s + 1.728 * s * r - 0.0996 * s * s) / t
        + 148.0248 + 137.1942 * r + 1.62142 * s
        - (24.4344 + 25.085 * r + 0.2474 * s) * w.log_t
        + 0.053105 * r * t
    )


def k_water(w: Water) -> Column:
    """Millero (1995), total scale."""
    s, t = w.s, w.t
    return F.exp(
        148.9652 - 13847.26 / t - 23.6521 * w.log_t
        + (118.67 / t - 5.977 + 1.0495 * w.log_t) * w.root_s
        - 0.01615 * s
    )


def k_henry(w: Water) -> Column:
    """Weiss (1974), mol/kg/atm."""
    s, t = w.s, w.t
    h = t / 100
    return F.exp(
        93.4517 / h - 60.2409 + 23.3585 * F.ln(h) + s * (0.023517 - 0.023656 * h + 0.0047036 * h * h)
    )


def _carbonic_lueker(w: Water) -> tuple[Column, Column]:
    """Lueker et al. (2000), total scale."""
    s, t = w.s, w.t
    pk1 = 3633.86 / t - 61.2172 + 9.6777 * w.log_t - 0.011555 * s + 0.0001152 * s * s
    pk2 = 471.78 / t + 25.929 - 3.16967 * w.log_t - 0.01781 * s + 0.0001122 * s * s
    return F.pow(F.lit(10.0), -pk1), F.pow(F.lit(10.0), -pk2)


def _carbonic_waters(w: Water) -> tuple[Column, Column]:
    """Waters, Millero & Woosley (2014), seawater scale."""
    s, t = w.s, w.t
    r = w.root_s
    pk1 = (
        -126.34048 + 6320.813 / t + 19.568224 * w.log_t
        + 13.409160 * r + 0.031646 * s - 5.1895e-5 * s * s
        + (-531.3642 * r - 5.713 * s) / t
        - 2.0669166 * r * w.log_t
    )
    pk2 = (
        -90.18333 + 5143.692 / t + 14.613358 * w.log_t
        + 21.225890 * r + 0.12450870 * s - 3.7243e-4 * s * s
        + (-779.3444 * r - 19.91739 * s) / t
        - 3.3534679 * r * w.log_t
    )
    return F.pow(F.lit(10.0), -pk1), F.pow(F.lit(10.0), -pk2)


def seawater_to_total(w: Water) -> Column:
    """Factor from the seawater pH scale to the total scale."""
    sulfate = total_sulfate(w.s) / k_sulfate(w)
    return (1 + sulfate) / (1 + sulfate + total_fluoride(w.s) / k_fluoride(w))


def k_carbonic(w: Water, source: str = "w14", to_total: Column | None = None) -> tuple[Column, Column]:
    """First and second constants; ``"l"``, ``"w14"``, or ``"x"`` = the former inside its range."""
    if source == "l":
        return _carbonic_lueker(w)
    if source not in ("w14", "x"):
        raise ValueError(f"unknown constants {source!r}")
    factor = seawater_to_total(w) if to_total is None else to_total
    waters = tuple(k * factor for k in _carbonic_waters(w))
    if source == "w14":
        return waters
    # A 0/1 weight instead of a branch: branches keep shared terms from being reused.
    inside = ((w.t - 273.15).between(*LUEKER_TEMPERATURE) & w.s.between(*LUEKER_SALINITY)).cast("double")
    return tuple(inside * a + (1 - inside) * b for a, b in zip(_carbonic_lueker(w), waters))


def k_aragonite(w: Water) -> Column:
    """Mucci (1983)."""
    s, t = w.s, w.t
    r = w.root_s
    return F.pow(
        F.lit(10.0),
        -171.945 - 0.077993 * t + 2903.293 / t + 71.595 * F.log10(t)
        + (-0.068393 + 0.0017276 * t + 88.135 / t) * r - 0.10018 * s + 0.0059415 * s * r,
    )


def k_calcite(w: Water) -> Column:
    """Mucci (1983)."""
    s, t = w.s, w.t
    r = w.root_s
    return F.pow(
        F.lit(10.0),
        -171.9065 - 0.077993 * t + 2839.319 / t + 71.595 * F.log10(t)
        + (-0.77712 + 0.0028426 * t + 178.34 / t) * r - 0.07711 * s + 0.0041249 * s * r,
    )


def fugacity_factor(t: Column) -> Column:
    """Weiss (1974) for CO2 in air at one atmosphere."""
    virial = -1636.75 + 12.0408 * t - 0.0327957 * t * t + 3.16528e-5 * t * t * t
    return F.exp((virial + 2 * (57.7 - 0.118 * t)) / (82.05736 * t))


def with_carbonate_system(
    df: DataFrame,
    ph: str,
    ta: str,
    salinity: str,
    temperature: str,
    constants: str = "w14",
    phosphate: str | None = None,
    silicate: str | None = None,
    fluoride: str = "dg",
) -> DataFrame:
    """Add CO2, HCO3, CO3, DIC (umol/kg), fCO2, pCO2 (uatm) and both saturation states.

    `ta`, `phosphate` and `silicate` in umol/kg (a NULL nutrient counts as none), `temperature` in
    Celsius. `fluoride` is ``"dg"`` (Dickson & Goyet), ``"pf"`` (Perez & Fraga) or ``"x"``, the
    latter inside its range. The work is laid out as a chain of
    projections, each reusing columns of the one before, so that no single generated method
    grows past what the JVM compiles.
    """
    w = Water(F.col(salinity), F.col("_t"), F.col("_log_t"), F.col("_root_s"))
    s, t = w.s, w.t
    scale = F.col("_scale")
    base = df.withColumn("_t", F.col(temperature) + 273.15).withColumns(
        {"_log_t": F.ln("_t"), "_root_s": F.sqrt(s), "_h": F.pow(F.lit(10.0), -F.col(ph))}
    )
    h, k1, k2, kb, kw, ks, kf = (F.col(f"_{n}") for n in ("h", "k1", "k2", "kb", "kw", "ks", "kf"))
    first, second = k_carbonic(w, constants, scale)
    ready = (
        base.withColumns(
            {"_scale": seawater_to_total(w), "_ks": k_sulfate(w), "_kf": k_fluoride(w)}
        )
        .withColumns({"_k1": first, "_k2": second})
        .withColumns({"_kb": k_boric(w), "_kw": k_water(w), "_free": h / (1 + total_sulfate(s) / ks)})
    )
    free = F.col("_free")
    if fluoride not in ("dg", "pf", "x"):
        raise ValueError(f"unknown fluoride constant {fluoride!r}")
    by_total = F.lit(float(fluoride == "pf"))
    if fluoride == "x":
        warm = F.col(temperature).between(*PEREZ_TEMPERATURE) & s.between(*PEREZ_SALINITY)
        by_total = warm.cast("double")
    nutrients = {}
    if phosphate or silicate:
        p1, p2, p3 = k_phosphoric(w)
        amounts = {"_pt": phosphate, "_sit": silicate}
        ready = ready.withColumns(
            {n: F.coalesce(F.col(c), F.lit(0.0)) / 1e6 if c else F.lit(0.0) for n, c in amounts.items()}
            | {"_p1": p1, "_p2": p2, "_p3": p3, "_ksi": k_silicic(w)}
        )
        p1, p2, p3 = (F.col(n) for n in ("_p1", "_p2", "_p3"))
        charged = p1 * p2 * h + 2 * p1 * p2 * p3 - h * h * h
        whole = h * h * h + p1 * h * h + p1 * p2 * h + p1 * p2 * p3
        nutrients = {"_na": F.col("_pt") * charged / whole + F.col("_sit") / (1 + h / F.col("_ksi"))}
        ready = ready.withColumns(nutrients)
    bound = (1 - by_total) * kf / free + by_total * k_fluoride_total(w) / h
    carbonate_alkalinity = (
        F.col(ta) / 1e6
        - total_boron(s) / (1 + h / kb)
        - kw / h
        + free
        + total_sulfate(s) / (1 + ks / free)
        + total_fluoride(s) / (1 + (kf / free if fluoride == "dg" else bound))
    )
    if nutrients:
        carbonate_alkalinity = carbonate_alkalinity - F.col("_na")
    out = (
        ready
        .withColumn("_ca", carbonate_alkalinity)
        .withColumn("_dic", F.col("_ca") * (h * h + k1 * h + k1 * k2) / (k1 * h + 2 * k1 * k2))
        .withColumns(
            {
                "_co2": F.col("_dic") / (1 + k1 / h + k1 * k2 / (h * h)),
                "_co3": F.col("_dic") / (1 + h / k2 + h * h / (k1 * k2)),
            }
        )
    )
    out = out.withColumns({"_fco2": F.col("_co2") / k_henry(w) * 1e6, "_product": F.col("_co3") * total_calcium(s)})
    return out.withColumns(
        {
            "CO2": F.col("_co2") * 1e6,
            "HCO3": (F.col("_dic") - F.col("_co2") - F.col("_co3")) * 1e6,
            "CO3": F.col("_co3") * 1e6,
            "DIC": F.col("_dic") * 1e6,
            "fCO2": F.col("_fco2"),
            "pCO2": F.col("_fco2") / fugacity_factor(t),
            "OmegaAragonite": F.col("_product") / k_aragonite(w),
            "OmegaCalcite": F.col("_product") / k_calcite(w),
        }
    ).select(
        *df.columns, "CO2", "HCO3", "CO3", "DIC", "fCO2", "pCO2", "OmegaAragonite", "OmegaCalcite"
    )
