"""Registered queries against their SQL on the small tables, and the registry's shape."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brackish.plans import mapping
from brackish.plans.registry import Tables
from tools.check_oracle import TABLES, canonical

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CHECKED = (
    "a1_hourly_mean", "a18_box_statistics", "e1_hourly_regression", "e3_slopes_per_tag", "f18_carbonate_system",
    "g3_factor_interaction", "g5_sequential_anova", "g17_shortest_interval", "g21_density_share", "j1_natural_left_chain",
    "j2_align_outer", "j6_nearest_in_tolerance", "r5_day_hour_matrix", "s7_messy_headers", "t1_tumbling_mean",
    "w2_centred_rolling_mean", "w8_regular_grid", "x2_variogram", "x3_values_at_points", "x4_group_status",
    "f18_carbonate_nutrients", "g2_regression_per_group", "g8_log_link_optimum", "g10_correlation_flags",
    "g16_path_model_optimum", "g21_density_curve", "j2_natural_full_chain", "s1_delimited_table", "s2_logger_folder",
    "t2_sliding_mean", "t1_late_rows", "g5_anova_per_location",
)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(entry.oracle_sql()[name])
    want = canonical([d[0] for d in result.description], result.fetchall())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_surface_has_three_parameters_at_500_pixels(spark):
    mapped = mapping._mapped(Tables(spark, "/root/testdata/sf0.01"))
    groups = {(r.season, r.parameter): r.status for r in mapped.groups.collect()}
    assert set(groups) == {(season, parameter) for season in (0, 1) for parameter in ("free", "sloped", "domed")}
    assert all(groups[season, "sloped"] == "ok" for season in (0, 1))
    surface = entry.queries()["x3_kriging_surface"](spark, "/root/testdata/sf0.01")
    assert 400 < surface.agg(F.max("ix")).first()[0] < 500


@pytest.fixture(scope="module")
def idle_folder(duck, tmp_path_factory):
    """Some rows have a quantity of zero."""
    folder = tmp_path_factory.mktemp("idle")
    rows = "SELECT * REPLACE (CASE WHEN l_orderkey % 97 = 0 THEN 0 ELSE l_quantity END AS l_quantity) FROM lineitem"
    duck.execute(f"COPY ({rows}) TO '{folder}/lineitem.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ("e2_chemistry_to_paths", "g16_path_model", "g16_path_model_first_equation"))
def test_division_by_zero_is_null(spark, idle_folder, name):
    rows = entry.queries()[name](spark, idle_folder).collect()
    assert len(rows) == (6 if name.endswith("equation") else 132)
    assert all(r.estimate is not None for r in rows)


def test_pull_is_over_the_rows_of_the_fit(spark, idle_folder):
    assert {r.pull for r in entry.queries()["g16_path_model_optimum"](spark, idle_folder).collect()} == {0.0}
