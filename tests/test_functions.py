"""Scalar rules and published check values."""

from __future__ import annotations

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from brackish.functions import carbonate, chemistry, nulls, seawater, times
from brackish.functions.tails import f_upper, incomplete_beta, t_two_sided
from brackish.sources.delimited import clean_names


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def at(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "text, want",
    [
        ("2022-06-03T07:51:00Z", datetime(2022, 6, 3, 7, 51)),
        ("8/4/2021 16:42", datetime(2021, 8, 4, 16, 42)),
        ("8/4/2021 6:42:05", datetime(2021, 8, 4, 6, 42, 5)),
        ("6/14/2023", datetime(2023, 6, 14)),
        ("01.08.2021 05h", datetime(2021, 8, 1, 5)),
        ("20240211", datetime(2024, 2, 11)),
        ("N/A", None),
        ("13/45/2021", None),
        (None, None),
    ],
)
def test_parse_time(spark, text, want):
    assert value(spark, times.parse_time(F.lit(text).cast("string"))) == want


def test_rounding_of_times(spark):
    assert value(spark, times.ceiling_time(at("2022-06-03 07:50:00"), "minute")) == datetime(2022, 6, 3, 7, 50)
    assert value(spark, times.ceiling_time(at("2022-06-03 07:50:31"), "minute")) == datetime(2022, 6, 3, 7, 51)
    assert value(spark, times.round_time(at("2022-06-03 07:30:00"), "hour")) == datetime(2022, 6, 3, 8)
    assert value(spark, times.round_time(at("2022-06-03 07:29:59"), "hour")) == datetime(2022, 6, 3, 7)
    assert value(spark, times.shift_time(at("2022-06-03 00:00:00"), hours=-10)) == datetime(2022, 6, 2, 14)
    serial = F.lit(719529 + 10 + 0.5 + 30 / 86400)
    assert value(spark, times.serial_day_to_time(serial)) == datetime(1970, 1, 11, 12, 0)


def test_null_rules(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("c", None)], "k string, x double")
    got = {
        r["k"]: (r["s"], r["m"])
        for r in rows.groupBy("k").agg(nulls.strict(F.max, F.col("x")).alias("s"), F.avg("x").alias("m")).collect()
    }
    assert got == {"a": (None, 1.0), "b": (2.0, 2.0), "c": (None, None)}
    assert value(spark, nulls.clamp_below(F.lit(-1.0))) == 0.0
    assert value(spark, nulls.clamp_below(F.lit(None).cast("double"))) is None
    assert value(spark, nulls.to_number(F.lit(" 3.5 "))) == 3.5
    assert value(spark, nulls.to_number(F.lit(" "))) is None
    assert value(spark, nulls.safe_divide(F.lit(1.0), F.lit(0.0))) is None


def test_light_and_residence(spark):
    none = F.lit(None).cast("double")
    assert value(spark, chemistry.fill_par(none, F.lit(0.0), F.lit("Dry"))) == 0.0
    want = 1555.751648 * (1 - math.exp(-math.exp(-10.777624) * 5000))
    assert value(spark, chemistry.fill_par(none, F.lit(5000.0), F.lit("Wet"))) == pytest.approx(want)
    assert value(spark, chemistry.fill_par(F.lit(7.0), none, F.lit("Wet"))) == 7.0
    assert value(spark, chemistry.residence_time(F.lit(0.0), F.lit(189.0))) is None
    assert value(spark, chemistry.residence_time(F.lit(0.1), F.lit(189.0))) == pytest.approx(31.5)


@pytest.mark.parametrize(
    "s, t, want", [(0.0, 5.0, 999.96675), (35.0, 5.0, 1027.67547), (35.0, 25.0, 1023.34306)]
)
def test_density_check_values(spark, s, t, want):
    assert value(spark, seawater.density(F.lit(s), F.lit(t))) == pytest.approx(want, abs=1e-4)


def test_constants_at_25_degrees(spark):
    """Published check values at S = 35, T = 298.15 K."""
    w = carbonate.water(F.lit(35.0), F.lit(298.15))
    k1, k2 = carbonate.k_carbonic(w, "l")
    logs = {
        "k1": (-F.log10(k1), 5.8472), "k2": (-F.log10(k2), 8.9660), "kb": (F.ln(carbonate.k_boric(w)), -19.7964),
        "kw": (F.ln(carbonate.k_water(w)), -30.434), "ks": (F.ln(carbonate.k_sulfate(w)), -2.30),
        "k0": (F.ln(carbonate.k_henry(w)), -3.5617), "ca": (F.log10(carbonate.k_calcite(w)), -6.3693),
        "ar": (F.log10(carbonate.k_aragonite(w)), -6.1883),
    }
    for name, (column, want) in logs.items():
        assert value(spark, column) == pytest.approx(want, abs=2e-3), name
    w1, w2 = carbonate.k_carbonic(w, "w14")
    assert value(spark, -F.log10(w1)) == pytest.approx(5.84, abs=0.02)
    assert value(spark, -F.log10(w2)) == pytest.approx(8.96, abs=0.03)


def test_open_ocean_carbonate(spark):
    row = spark.createDataFrame([(8.134, 2364.613, 35.972, 25.0)], "ph double, ta double, s double, t double")
    out = carbonate.with_carbonate_system(row, "ph", "ta", "s", "t", constants="x").first()
    assert out["DIC"] == pytest.approx(1994.888, abs=0.5)
    assert out["CO2"] + out["HCO3"] + out["CO3"] == pytest.approx(out["DIC"])
    assert out["OmegaCalcite"] > out["OmegaAragonite"] > 1
    assert out["pCO2"] > out["fCO2"]


def test_tris_ph(spark):
    assert value(spark, seawater.tris_ph(F.lit(35.0), F.lit(25.0))) == pytest.approx(8.0936, abs=2e-3)
    same = seawater.electrode_ph(F.lit(-80.0), F.lit(-80.0), F.lit(35.0), F.lit(25.0))
    assert value(spark, same) == pytest.approx(8.0936, abs=2e-3)


def test_tail_probabilities():
    assert incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248)
    assert t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert t_two_sided(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-6)
    assert f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert f_upper(3.0, 1, 20) == pytest.approx(t_two_sided(math.sqrt(3.0), 20))


def test_clean_names():
    headers = ["Test #", "Full Date", "% Counts (A)", "Radon In Water [Dpm/L]", "Full Date", "LiveTime"]
    assert clean_names(headers) == [
        "test_number", "full_date", "percent_counts_a", "radon_in_water_dpm_l", "full_date_2", "live_time"
    ]


@pytest.mark.parametrize(
    "text,want",
    [
        ("2022-06-03", datetime(2022, 6, 3)), ("2021-08-06 05:00", datetime(2021, 8, 6, 5)),
        ("2022-06-03T07:50:00", datetime(2022, 6, 3, 7, 50)), ("8/4/21 16:42", datetime(2021, 8, 4, 16, 42)),
        ("2022-06-03 07:50:00.25", datetime(2022, 6, 3, 7, 50, 0, 250_000)), ("2022-06-03T07:50:00.5Z", datetime(2022, 6, 3, 7, 50, 0, 500_000)),
        ("2022-6-3x", None),
    ],
)
def test_looser_times(spark, text, want):
    assert value(spark, times.parse_time(F.lit(text))) == want


def test_tails_of_large_samples():
    assert t_two_sided(2.0, 1e11) == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=1e-6)
    assert t_two_sided(2.5, 1.999e6) == pytest.approx(t_two_sided(2.5, 2.001e6), rel=1e-5)
    assert f_upper(3.0, 4, 1e12) == pytest.approx(math.exp(-6.0) * 7.0, rel=1e-6)


def test_scratch_needs_a_shared_folder_off_one_machine(spark, monkeypatch):
    from brackish import session

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(Session(), "x")


def test_release_removes_derived_tables(spark):
    import os

    from brackish import session

    settled = session.settle(spark.range(3))
    assert settled.count() == 3
    root = session.scratch_root(spark)
    assert os.path.isdir(root)
    session.release(spark)
    assert not os.path.exists(root)


def test_tables_that_nothing_reads_are_removed(spark):
    import os

    from brackish import session

    with session.recording() as made:
        kept, gone = session.settle(spark.range(3)), session.settle(spark.range(4))
        kept.join(gone, "id")
    session.settle(spark.range(1))
    assert len(made) == 2
    assert session.remove_unread(spark, made, kept) == made[:1]
    assert os.path.isdir(made[0]) and not os.path.exists(made[1])
    assert kept.count() == 3


def test_tails_of_a_batch_are_those_of_its_entries():
    t, df = np.linspace(0.05, 6.0, 60), np.full(60, 601_000.0)
    assert t_two_sided(t, df).tolist() == [t_two_sided(a, b)[0] for a, b in zip(t, df)]
    assert f_upper(t * t, np.ones(60), df) == pytest.approx(t_two_sided(t, df), rel=1e-9)
    # 1 - p keeps its digits where t * t is lost beside the degrees of freedom
    assert 1 - t_two_sided(1e-4, 600_000.0)[0] == pytest.approx(math.erf(1e-4 / math.sqrt(2)), rel=2e-6)
