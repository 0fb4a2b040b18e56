"""Operators against hand-made frames and brute force."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brackish.operators import draws, joins, kriging, ordered, regression, reshape, scaling, spatial, variograms
from brackish.operators.density import density_curve
from brackish.operators.draws import shortest_interval
from brackish.operators.effects import effect_curves
from brackish.operators.keys import join_on
from brackish.operators.moments import cross_moments
from brackish.operators.pca import fit_pca, percent_explained, scores
from brackish.operators.regression import Model

START = datetime(2022, 6, 3)


def series(spark, values, site="A"):
    rows = [(site, START + timedelta(minutes=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "site string, ts timestamp_ntz, x double")


def test_null_keys_match(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (4, "z")], "k int, r string")
    full = {(r["k"], r["l"], r["r"]) for r in join_on(left, right, ["k"], "full").collect()}
    assert full == {(1, "a", "x"), (None, "b", "y"), (3, "c", None), (4, None, "z")}
    assert {r["l"] for r in joins.drop_listed(left, right, ["k"]).collect()} == {"c"}
    aligned = {(r["k"], r["l"], r["r"]) for r in joins.align_outer([left, right], ["k"]).collect()}
    assert aligned == full


def test_columns_of_both_sides_get_suffixes(spark):
    left = spark.createDataFrame([(1, "a", 1.0)], "k int, v string, l double")
    right = spark.createDataFrame([(1, "b", 2.0), (2, "c", 3.0)], "k int, v string, r double")
    out = join_on(left, right, ["k"], "full").orderBy("k")
    assert out.columns == ["k", "v_x", "l", "v_y", "r"]
    assert [tuple(r) for r in out.collect()] == [(1, "a", 1.0, "b", 2.0), (2, None, None, "c", 3.0)]
    assert join_on(left, right, ["k"], "left_semi").columns == ["k", "v", "l"]


def test_duplicate_right_keys_multiply(spark):
    left = spark.createDataFrame([(1, "a")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, r string")
    assert joins.natural_join(left, right).count() == 2


@pytest.mark.parametrize("length", [59, 60, 61, 400])
def test_rolling_mean_matches_pandas(spark, length):
    values = [math.sin(i) for i in range(length)]
    rolled = ordered.rolling_mean(series(spark, values), ["site"], ["ts"], {"m": "x"}, 60)
    got = [r["m"] for r in rolled.orderBy("ts").collect()]
    want = pd.Series(values).rolling(60).mean().shift(-30)
    assert len(got) == length
    for a, b in zip(got, want):
        assert (a is None) == bool(np.isnan(b)) and (a is None or a == pytest.approx(b))


def test_chunks_do_not_change_a_window(spark):
    values = [float((i * 37) % 101) for i in range(500)]
    values[100] = None
    df = series(spark, values).unionByName(series(spark, [5, 4, 6], "B"))
    small = ordered.over_series(
        df, ["site"], ["ts"], 3, 2,
        lambda w: {"s": F.sum("x").over(w.rowsBetween(-3, 2)), "p": F.lag("x", 3).over(w)}, chunk_rows=7,
    )
    from pyspark.sql import Window

    w = Window.partitionBy("site").orderBy("ts")
    plain = df.withColumns({"s": F.sum("x").over(w.rowsBetween(-3, 2)), "p": F.lag("x", 3).over(w)})
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_direction(spark):
    got = [r["rise_fall"] for r in ordered.direction(series(spark, [1, 2, 2, None, 1]), ["site"], ["ts"], "x").orderBy("ts").collect()]
    assert got == [None, "Rising", "Falling", None, None]


@pytest.mark.parametrize("bins, want", [(2, [1, 1, 1, 2, 2]), (3, [1, 1, 2, 2, 3])])
def test_quantile_bins_leave_nulls_out(spark, bins, want):
    binned = ordered.quantile_bin(series(spark, [10, 20, None, 30, 40, 50]), ["site"], ["ts"], "x", bins, "b")
    rows = {r["x"]: r["b"] for r in binned.collect()}
    assert [rows[v] for v in (10, 20, 30, 40, 50)] == want and rows[None] is None


def test_exact_quantiles(spark):
    values = list(np.random.default_rng(1).normal(size=101))
    got = ordered.exact_quantiles(series(spark, values), ["site"], "x", {"a": 0.25, "b": 0.975}).first()
    assert (got["a"], got["b"]) == pytest.approx(tuple(np.quantile(values, [0.25, 0.975])))


def test_nearest_join_brute_force(spark):
    rng = np.random.default_rng(3)
    left = [(int(k), START + timedelta(seconds=int(s))) for k, s in zip(rng.integers(0, 3, 200), rng.integers(0, 20000, 200))]
    left += [(0, START)] * 50
    right = [(int(k), START + timedelta(seconds=int(s)), i) for i, (k, s) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(0, 20000, 80)))]
    right += [(0, START + timedelta(seconds=30), 1000), (0, START - timedelta(seconds=30), 1001)]
    l_df = spark.createDataFrame(left, "k int, ts timestamp_ntz")
    r_df = spark.createDataFrame(right, "k int, ts timestamp_ntz, v int")
    got = joins.nearest_join(l_df, r_df, "ts", 120, ["k"], ["v"]).collect()
    assert len(got) == len(left)
    for r in got:
        near = sorted((abs((t - r["ts"]).total_seconds()), t, v) for k, t, v in right if k == r["k"])
        want = near[0][2] if near and near[0][0] <= 120 else None
        assert r["v"] == want


def test_nearest_join_spreads_a_busy_hour(spark):
    rng = np.random.default_rng(9)
    busy, calm = rng.integers(0, 3600 * 10**6, 4_000), rng.integers(0, 10**6 * 86_400 * 60, 8_000)
    left = pd.DataFrame({"k": 1, "t": np.unique(np.concatenate([busy, calm]))})
    right = pd.DataFrame({"k": 1, "t": np.sort(rng.choice(86_400 * 60, 300, replace=False)) * 10**6})
    right["v"] = right.index
    l_df, r_df = (
        spark.createDataFrame(d).withColumn("ts", F.timestamp_micros("t")).drop("t") for d in (left, right)
    )
    got = joins.nearest_join(l_df, r_df, "ts", 7200, ["k"], ["v"]).select(F.unix_micros("ts").alias("t"), "v").toPandas()
    at = np.searchsorted(right.t, left.t, side="right")
    back, ahead = np.clip(at - 1, 0, 299), np.clip(np.searchsorted(right.t, left.t), 0, 299)
    gap_back = np.where(at > 0, left.t - right.t[back].values, 10**18)
    gap_ahead = np.where(right.t[ahead].values >= left.t, right.t[ahead].values - left.t, 10**18)
    best, gap = np.where(gap_back <= gap_ahead, back, ahead), np.minimum(gap_back, gap_ahead)
    want = pd.Series(np.where(gap <= 7200 * 10**6, best, -1), index=left.t)
    assert got.set_index("t").v.fillna(-1).astype(int).sort_index().tolist() == want.sort_index().tolist()
    probes = l_df.withColumn("_t", F.unix_micros("ts"))
    targets = r_df.select("k", F.unix_micros("ts").alias("_t"), F.struct("v").alias("_row"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one range
    try:
        ranges = joins.stacked_ranges(probes, targets, ["k"], "_t")
        found = {(r.ts, r._back, r._ahead) for r in joins.merge_ranges(probes, targets, ["k"], "_t").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {(r.ts, r._back, r._ahead) for r in joins.merge_ranges(probes, targets, ["k"], "_t").collect()}
    sizes = [r["count"] for r in ranges.groupBy("_split").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * sum(sizes) / len(sizes)


def test_time_grid_keeps_off_grid_rows(spark):
    rows = [("A", "Dry", START, 1.0), ("A", "Dry", START + timedelta(minutes=3, seconds=30), 2.0), ("A", "Wet", START, 3.0),
            ("A", "Wet", START + timedelta(minutes=4), 4.0)]
    df = spark.createDataFrame(rows, "site string, season string, ts timestamp_ntz, x double")
    got = reshape.fill_grid(df, ["site", "season"], "ts", {"Dry": 60, "Wet": 120}).orderBy("season", "ts").collect()
    dry = [(r["ts"] - START).total_seconds() for r in got if r["season"] == "Dry"]
    wet = [((r["ts"] - START).total_seconds(), r["x"]) for r in got if r["season"] == "Wet"]
    assert dry == [0, 60, 120, 180, 210]
    assert wet == [(0, 3.0), (120, None), (240, 4.0)]


def test_scaling_round_trip_and_long_wide(spark):
    df = series(spark, [1, 5, 9, None])
    stats = scaling.scale_stats(df, ["x"], ["site"])
    back = scaling.unstandardise(scaling.standardise(df, ["x"], ["site"], "", stats), {"x": "x"}, stats, ["site"], "")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    one = scaling.standardise(series(spark, [4]), ["x"], ["site"]).first()
    assert one["x_scaled"] is None
    wide = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], "k int, a double, b double")
    again = reshape.to_wide(reshape.to_long(wide, ["k"], ["a", "b"]), ["k"], "name", "value", ["a", "b"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, wide.collect()))


def _sample(spark, n=200):
    rng = np.random.default_rng(5)
    x, z = rng.normal(2300, 20, n), rng.normal(size=n)
    f, g = rng.choice(["Day", "Night"], n), rng.choice(["High", "Low", "Mid"], n)
    y = 3 + 0.5 * x - 2 * z + np.where(f == "Night", 4 + 0.1 * x, 0) + rng.normal(size=n)
    return pd.DataFrame({"x": x, "z": z, "f": f, "g": g, "y": y})


def test_multi_term_fit_matches_least_squares(spark):
    pdf = _sample(spark)
    model = Model.crossed("y", "x", "f", extra=["z"])
    factors = {"f": ["Day", "Night"]}
    fitted = regression.fit_models(spark.createDataFrame(pdf), [], [model], factors)
    night = (pdf.f == "Night").astype(float)
    design = np.column_stack([np.ones(len(pdf)), pdf.x, night, pdf.z, pdf.x * night])
    beta, rss, *_ = np.linalg.lstsq(design, pdf.y, rcond=None)
    rows = regression.coefficients(fitted).collect()
    assert [r["term"] for r in rows] == ["(Intercept)", "x", "fNight", "z", "x:fNight"]
    assert [r["estimate"] for r in rows] == pytest.approx(list(beta), rel=1e-5)
    sigma2 = float(rss[0]) / (len(pdf) - 5)
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sigma2)
    assert [r["std_error"] for r in rows] == pytest.approx(list(se), rel=1e-4)
    table = {r["term"]: r for r in regression.anova_table(fitted).collect()}
    total = float(((pdf.y - pdf.y.mean()) ** 2).sum())
    assert sum(r["sumsq"] for r in table.values()) == pytest.approx(total)
    assert table["Residuals"]["df"] == len(pdf) - 5
    slopes = {r["f"]: r for r in regression.marginal_effects(fitted, model, "x", factors).collect()}
    assert slopes["Day"]["effect"] == pytest.approx(beta[1], rel=1e-5)
    assert slopes["Night"]["effect"] == pytest.approx(beta[1] + beta[4], rel=1e-5)
    assert slopes["Night"]["sig"] == "yes"


def test_collinear_terms_are_dropped(spark):
    pdf = _sample(spark).assign(copy=lambda d: 2 * d.z)
    fitted = regression.fit_models(spark.createDataFrame(pdf), [], [Model("y", ("z", "copy", "x"))])
    got = {r["term"]: r["estimate"] for r in regression.coefficients(fitted).collect()}
    assert got["copy"] is None and got["z"] is not None
    plain = regression.fit_models(spark.createDataFrame(pdf), [], [Model("y", ("z", "x"))])
    want = {r["term"]: r["estimate"] for r in regression.coefficients(plain).collect()}
    assert got["x"] == pytest.approx(want["x"], rel=1e-6)


def test_single_row_group(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "k string, x double, y double")
    line = regression.line_fit(df, ["k"], "y", "x").first()
    assert line["n"] == 1 and line["slope"] is None and line["sigma"] is None
    row = regression.coefficients(regression.fit_models(df, ["k"], [Model("y", ("x",))])).collect()
    assert [r["estimate"] for r in row] == [2.0, None]


def test_shared_slope_residuals_sum_to_zero(spark):
    df = spark.createDataFrame(_sample(spark))
    lines = regression.shared_slope(df, [], "f", "y", "x")
    out = regression.apply_line(df, lines, ["f"], "x", "p", "y").groupBy("f").agg(F.sum("p_diff").alias("s"))
    assert all(abs(r["s"]) < 1e-6 for r in out.collect())


def test_log_link_fit_recovers_curve(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 2, 300)
    pdf = pd.DataFrame({"k": "a", "x": x, "y": np.exp(1 + 0.7 * x) + rng.normal(0, 0.05, 300)})
    rows = regression.coefficients(regression.fit_log_link(spark.createDataFrame(pdf), ["k"], Model("y", ("x",)))).collect()
    assert [r["estimate"] for r in rows] == pytest.approx([1.0, 0.7], abs=5e-3)


def test_student_fit_resists_outliers(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, 200)
    y = 1 + 2 * x + rng.normal(0, 0.1, 200)
    y[:10] += 100
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x, "y": y}))
    rows = regression.coefficients(regression.fit_student(df, ["k"], Model("y", ("x",)))).collect()
    assert [r["estimate"] for r in rows] == pytest.approx([1.0, 2.0], abs=0.2)


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(9)
    data = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 4))
    names = list("abcd")
    df = spark.createDataFrame(pd.DataFrame(data, columns=names).assign(id=range(120)))
    model = fit_pca(df, [], names)
    z = (data - data.mean(0)) / data.std(0, ddof=1)
    singular = np.linalg.svd(z, compute_uv=False)
    sdev = singular / np.sqrt(119)
    got = percent_explained(model, []).orderBy("component").collect()
    assert [r["sdev"] for r in got] == pytest.approx(list(sdev))
    assert [r["percent"] for r in got] == pytest.approx(list((100 * sdev / sdev.sum()).round(1)))
    spread = scores(df, model, [], names).agg(F.stddev("PC1"), F.stddev("PC2"), F.corr("PC1", "PC2")).first()
    assert tuple(spread) == pytest.approx((sdev[0], sdev[1], 0.0), abs=1e-9)


def test_shortest_interval_brute_force(spark):
    values = np.sort(np.random.default_rng(4).gamma(2.0, size=200))
    got = draws.shortest_interval(series(spark, values), ["site"], "x").first()
    k = int(len(values) * 0.95)
    widths = values[k:] - values[: len(values) - k]
    i = int(widths.argmin())
    assert (got["lower"], got["upper"], got["median"]) == pytest.approx((values[i], values[i + k], np.median(values)))
    assert got["sig"] == "yes"


def test_residual_summary_equals_all_pairs(spark):
    rng = np.random.default_rng(6)
    d = pd.DataFrame({"a": rng.normal(size=50), "b": rng.normal(size=50)})
    r = pd.DataFrame({"y": rng.normal(size=9), "x": rng.normal(size=9)})
    got = draws.residual_summary(spark.createDataFrame(r), spark.createDataFrame(d), "y", {"b": "x"}, "a").toPandas()
    every = r.y.to_numpy()[:, None] - (d.a.to_numpy() + r.x.to_numpy()[:, None] * d.b.to_numpy())
    got, order = got.sort_values("y"), np.argsort(r.y.to_numpy())
    assert got.resid.tolist() == pytest.approx(every.mean(1)[order].tolist())
    assert got.resid_sd.tolist() == pytest.approx(every.std(1, ddof=1)[order].tolist())


def test_density_integrates_to_one(spark):
    df = series(spark, np.random.default_rng(8).normal(50, 5, 300))
    curve = density_curve(df, ["site"], "x", 2.0, 0.0, 100.0, 201).agg(F.sum("density") * 0.5).first()[0]
    assert curve == pytest.approx(1.0, abs=1e-6)


def test_point_in_polygon(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.5, 2.0), (5.0, 1.0)], "x double, y double")
    got = [r[0] for r in df.select(spatial.inside_polygon(F.col("x"), F.col("y"), spatial.ring_column(ring))).collect()]
    assert got == [True, False, True, False]


def field(spark, n=25, seed=12):
    rng = np.random.default_rng(seed)
    pts = [("a", float(x), float(y), float(np.sin(x) + y)) for x, y in rng.uniform(0, 10, (n, 2))]
    pts += [("b", 1.0, 1.0, 1.0), ("c", None, 1.0, 1.0), ("d", 1.0, 1.0, 1.0), ("d", 2.0, 1.0, 1.0), ("d", 3.0, 1.0, 1.0)]
    df = spark.createDataFrame(pts, "k string, x double, y double, z double")
    models = spark.createDataFrame([(k, 0.0, 4.0, 10.0) for k in "ab"], "k string, nugget double, range double, sill double")
    return pts, df, models


def test_kriging_is_exact_at_points_and_reports_failures(spark):
    pts, df, models = field(spark)
    mapped = kriging.krige(df, models, ["k"], "x", "y", "z", cell=0.01, tile=2000)
    status = {r["k"]: r["status"] for r in mapped.groups.collect()}
    assert status == {"a": "ok", "b": "too few points", "d": "no spatial structure"}
    got = sorted(r["prediction"] for r in mapped.at_cells().collect())
    assert got == pytest.approx(sorted(p[3] for p in pts if p[0] == "a"))
    assert mapped.surface([(0, 0), (10, 0), (10, 10), (0, 10)], pixels=20).count() == 400
    total = mapped.systems.select(F.aggregate("weights", F.lit(0.0), lambda s, w: s + w["w"])).collect()
    assert max(abs(r[0]) for r in total) < 1e-9


def test_tiles_agree_with_one_solve(spark):
    """The halo is the variogram's range, so 4 x 4 tiles differ from one system by under 2% of the
    values' spread; no tile holds the group."""
    _, df, models = field(spark, 600)
    ring = [(0, 0), (10, 0), (10, 10), (0, 10)]
    one = kriging.krige(df, models, ["k"], "x", "y", "z", cell=0.25, tile=40, halo=40)
    tiled = kriging.krige(df, models, ["k"], "x", "y", "z", cell=0.25, tile=10, halo=16)
    assert one.systems.where("tx = 0 AND ty = 0").count() == 1
    sizes = [r[0] for r in tiled.systems.where("tx BETWEEN 0 AND 3 AND ty BETWEEN 0 AND 3").select(F.size("weights")).collect()]
    points = tiled.groups.where("k = 'a'").first()["points"]
    assert len(sizes) == 16 and max(sizes) < points
    a, b = ({(r.ix, r.iy): r.prediction for r in m.surface(ring, 40).collect()} for m in (one, tiled))
    assert a.keys() == b.keys() and len(a) == 1600
    apart = np.array([a[k] - b[k] for k in a])
    assert np.abs(apart).max() < 0.02 * np.ptp(list(a.values()))


def test_tile_without_points_is_level(spark):
    _, df, models = field(spark, 40)
    mapped = kriging.krige(df, models, ["k"], "x", "y", "z", cell=1.0, tile=2, halo=1)
    far = mapped.surface([(50, 50), (52, 50), (52, 52), (50, 52)], 2).collect()
    level = mapped.groups.where("k = 'a'").first()["level"]
    assert [r.prediction for r in far] == pytest.approx([level] * 4)


def test_quantiles_of_a_value_that_most_rows_share(spark):
    values = [0.0] * 9_000 + list(np.random.default_rng(4).normal(5, 2, 1_000))
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": values})).repartition(8)
    counts = ordered.value_counts(df, ["k"], "x")
    assert counts.count() == len(set(values))
    got = ordered.exact_quantiles(df, ["k"], "x", {"a": 0.25, "b": 0.95}).first()
    assert (got["a"], got["b"]) == pytest.approx(tuple(np.quantile(values, [0.25, 0.95])))
    interval = shortest_interval(df, ["k"], "x", 0.9).first()
    x = np.sort(values)
    width = x[9_000:] - x[:1_000]
    assert interval["upper"] - interval["lower"] == pytest.approx(width.min())


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("misled", [False, True])
def test_quantiles_by_selection(spark, monkeypatch, keys, misled):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, 30_000), np.full(15_000, 0.25), rng.pareto(1, 10_000), [math.inf, -math.inf]])
    table = pd.DataFrame({"k": pd.array(rng.integers(0, 3, len(x)), "Int64"), "x": x})
    table.loc[table.k == 2, "k"] = None
    df = spark.createDataFrame(table).withColumn("x", F.when(F.col("x") != 0.125, F.col("x"))).repartition(6)
    df = df.unionByName(spark.createDataFrame([(7, 5.0), (8, None)], "k long, x double"))
    if misled:  # intervals that miss their ranks
        right = ordered._intervals

        def wrong(*args):
            return right(*args).withColumns({"_low": F.transform("_low", lambda v: v + 1), "_high": F.transform("_high", lambda v: v + 1)})

        monkeypatch.setattr(ordered, "_intervals", wrong)
    shares = {"least": 0.0, "low": 0.025, "half": 0.5, "near": 0.5001, "high": 0.975}
    got = {r["k"] if keys else 0: r for r in ordered.exact_quantiles(df, keys, "x", shares).collect()}
    parts = {None if pd.isna(k) else k: p.x.to_numpy() for k, p in table.groupby("k", dropna=False)} | {7: [5.0]} if keys else {0: [*x, 5.0]}
    assert set(got) == set(parts)
    for k, part in parts.items():
        for name, p in shares.items():
            if name != "least" or np.isfinite(np.min(part)):
                assert got[k][name] == pytest.approx(np.quantile(part, p), rel=1e-12)


def test_selection_sorts_few_rows(spark):
    df = spark.range(400_000).select(F.rand(3).alias("x"))
    df = df.checkpoint()
    shares = [0.25, 0.5, 0.75]
    counts = ordered._selected_counts(df, [], "x", ordered._intervals(df, [], "x", shares), shares)
    assert counts.agg(F.sum("count")).first()[0] == 400_000
    assert counts.count() < 400_000 * 3 * 8 / ordered.SKETCH_ACCURACY


def test_moments_of_groups_far_apart(spark):
    rng = np.random.default_rng(1)
    parts = [pd.DataFrame({"k": k, "x": at + rng.normal(0, 0.3, 500), "w": 1.0}) for k, at in (("a", 1e9), ("b", -1e9))]
    parts = [p.assign(y=2 * (p.x - p.x.mean()) + rng.normal(0, 0.1, 500)) for p in parts]
    df = spark.createDataFrame(pd.concat(parts))
    for weight in (None, "w"):
        for row in cross_moments(df, ["k"], ["x", "y"], weight).collect():
            part = next(p for p in parts if p.k.iloc[0] == row["k"])
            assert row["cov"] == pytest.approx(np.cov(part.x, part.y, ddof=0)[np.triu_indices(2)], rel=1e-6)
            assert row["n"] == row["total"] == 500
    plan = cross_moments(df, ["k"], ["x", "y"])._jdf.queryExecution().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 6
    slopes = regression.coefficients(regression.fit_models(df, ["k"], [Model("y", ("x",))])).where("term = 'x'").collect()
    assert [r["estimate"] for r in slopes] == pytest.approx([2.0, 2.0], abs=0.05)


@pytest.mark.parametrize("held", [4096, 3])
def test_moments_by_any_key(spark, monkeypatch, held):
    from brackish.operators import moments

    monkeypatch.setattr(moments, "HELD", held)
    rng = np.random.default_rng(3)
    keys = [None, "a", "b", "c", "d", "e", "f"]
    rows = [(keys[k], float("nan") if k % 3 else 0.5, *map(float, rng.normal(size=5)), float(rng.random())) for k in rng.integers(0, 7, 600)]
    rows += [("a", 0.5, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double, a double, b double, c double, d double, e double, w double").repartition(5)
    table = pd.DataFrame(rows[:-1], columns=["k", "v", *"abcde", "w"])
    for weight in (None, "w"):
        for by in (["k", "v"], []):
            got = {tuple(repr(r[c]) for c in by): r for r in cross_moments(df, by, list("abcde"), weight, [(0, 3), (2, 2)]).collect()}
            groups = {tuple(repr(v) for v in (None if isinstance(k[0], float) else k[0], float(k[1]))): part for k, part in table.groupby(["k", "v"], dropna=False)} if by else {(): table}
            assert got.keys() == groups.keys()
            for key, part in groups.items():
                cov = np.cov(part[list("abcde")].T, ddof=0, aweights=part.w if weight else None)
                assert got[key]["cov"] == pytest.approx([cov[0, 3], cov[2, 2]])
                assert got[key]["n"] == len(part) and got[key]["total"] == pytest.approx(part.w.sum() if weight else len(part))
                assert got[key]["mean"] == pytest.approx(np.average(part[list("abcde")], axis=0, weights=part.w if weight else None))
    assert cross_moments(df.where("k = 'none'"), ["k"], ["a"]).count() == 0


def test_effect_curves_by_factor_and_at_means(spark):
    rng = np.random.default_rng(9)
    table = pd.DataFrame({"k": "a", "x": rng.uniform(0, 5, 80), "m": rng.normal(2, 1, 80), "f": rng.choice(["lo", "up"], 80)})
    table["y"] = 1 + 2 * table.x + table.m - 3 * (table.f == "up") * table.x + rng.normal(0, 0.3, 80)
    rows = [tuple(r) for r in table.itertuples(index=False)] + [("a", 99.0, None, "lo", 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, m double, f string, y double")
    model, factors = Model("y", ("x", "m", "f", "x:f")), {"f": ["lo", "up"]}
    fitted = regression.fit_models(df, ["k"], [model], factors)
    up = (table.f == "up").to_numpy(float)
    design = np.column_stack([np.ones(80), table.x, table.m, up, table.x * up])
    beta, rss = np.linalg.lstsq(design, table.y, rcond=None)[:2]
    cov = np.linalg.inv(design.T @ design) * rss[0] / 75
    got = effect_curves(df, fitted, ["k"], model, "x", by="f", factors=factors, points=5).collect()
    assert len(got) == 10 and {r.slice for r in got} == {"lo", "up"}
    for r in got:
        at = float(r.slice == "up")
        line = np.array([1, r.x, table.m.mean(), at, at * r.x])
        assert r.estimate == pytest.approx(line @ beta) and r.std_error == pytest.approx(np.sqrt(line @ cov @ line))
        assert r.upper - r.lower == pytest.approx(2 * 1.959964 * r.std_error, rel=1e-6)
    assert sorted({r.x for r in got if r.point in (0, 4)}) == pytest.approx([table.x.min(), table.x.max()])
    plain = effect_curves(df, fitted, ["k"], model, "x", factors=factors, points=5).collect()
    assert sorted(r.estimate for r in plain) == pytest.approx(sorted(r.estimate for r in got if r.slice == "lo"))
    with pytest.raises(ValueError):
        effect_curves(df, fitted, ["k"], model, "f", factors=factors)


def test_density_counts_rows_outside_its_window(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 50)], "x double")
    inside = density_curve(df, [], "x", 1.0, 0.0, 2.0, 3).orderBy("point").collect()
    assert {r["n"] for r in inside} == {4.0}
    peak = [sum(np.exp(-0.5 * (p - x) ** 2) for x in (0, 1, 2, 50)) / np.sqrt(2 * np.pi) / 4 for p in range(3)]
    assert [r["density"] for r in inside] == pytest.approx(peak)
    whole = density_curve(df, [], "x", 1.0, points=51).collect()
    assert (min(r["x"] for r in whole), max(r["x"] for r in whole)) == (0.0, 50.0)


@pytest.mark.parametrize(("exact", "depth"), [(1 << 16, 5), (4, 5), (0, 3)])
def test_variogram_counts_every_pair_at_its_distance(spark, monkeypatch, exact, depth):
    monkeypatch.setattr(variograms, "EXACT_PAIRS", exact)
    rng = np.random.default_rng(8)
    at = rng.random((120, 2)) * [40.0, 9.0]
    rows = [("a", float(x), float(y), float(1e6 + x / 9 + rng.random())) for x, y in at]
    rows += [("a", None, 1.0, 1.0), ("b", 2.0, 2.0, 1.0), ("b", 2.0, 2.0, 4.0), ("c", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double")
    got = {(r.k, r.lag): r for r in variograms.variogram(df, ["k"], "x", "y", "z", depth=depth).collect()}
    z = np.array([r[3] for r in rows[:120]])
    i, j = np.triu_indices(120, 1)
    distance, squares = np.hypot(*(at[i] - at[j]).T), (z[i] - z[j]) ** 2
    far = np.hypot(*np.ptp(at, axis=0))
    assert sum(r.pairs for (k, _), r in got.items() if k == "a") == len(i)
    if exact:
        for lag in range(3):
            near = np.minimum(distance * 3 // far, 2) == lag
            assert got["a", lag].pairs == near.sum()
            assert got["a", lag].distance == pytest.approx(np.sqrt((distance[near] ** 2).mean()))
            assert got["a", lag].gamma == pytest.approx(squares[near].mean() / 2, rel=1e-6)
    else:  # the last lattice's cells that straddle a limit go by their means
        limit = np.abs(distance[:, None] - far * np.array([1, 2]) / 3).min(1)
        doubtful = (limit < 2 * far / 2 ** (2 * depth + 1)).sum()
        for lag in range(3):
            assert abs(got["a", lag].pairs - (np.minimum(distance * 3 // far, 2) == lag).sum()) <= doubtful
    assert (got["b", 0].pairs, got["b", 0].distance, got["b", 0].gamma) == (1, 0.0, 4.5)
    assert not [k for k in got if k[0] == "c"]
    whole = variograms.variogram(df.where("k = 'a'"), [], "x", "y", "z").collect()
    assert sum(r.pairs for r in whole) == len(i)


def test_spherical_fit_finds_the_model(spark):
    model = (0.5, 6.0, 2.5)
    at = np.array([0.5, 1.5, 2.5, 4.0, 5.5, 7.0, 8.0])
    rows = [("a", float(d), 10, float(kriging.spherical(np.array([d]), *model)[0])) for d in at]
    rows += [("flat", float(d), 10, 1.0) for d in at] + [("falls", float(d), 10, float(9 - d)) for d in at] + [("one", 2.0, 5, 1.0)]
    lags = spark.createDataFrame(rows, "k string, distance double, pairs long, gamma double")
    got = {r.k: r for r in variograms.fit_spherical(lags, ["k"]).collect()}
    assert (got["a"].nugget, got["a"].range, got["a"].sill) == pytest.approx(model, rel=0.03)
    assert got["flat"].sill == pytest.approx(got["flat"].nugget) and got["falls"].sill < got["falls"].nugget
    assert "one" not in got
