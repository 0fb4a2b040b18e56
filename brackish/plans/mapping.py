"""Spatial operators; positions come from the first two embedding dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.operators.keys import attach
from brackish.operators.kriging import Kriging, krige
from brackish.operators.project import across
from brackish.operators.spatial import inside_box, inside_polygon, polygon_grid, ring_column
from brackish.operators.variograms import fit_spherical, variogram
from brackish.plans.catalog import Tables, query

# A concave survey area in embedding units.
RING = [(-0.2, -0.2), (0.2, -0.2), (0.25, 0.1), (0.05, 0.02), (-0.05, 0.25), (-0.25, 0.1)]
RING_SQL = """
    edges AS (
        SELECT * FROM (VALUES (-0.2, -0.2, 0.2, -0.2), (0.2, -0.2, 0.25, 0.1), (0.25, 0.1, 0.05, 0.02),
                              (0.05, 0.02, -0.05, 0.25), (-0.05, 0.25, -0.25, 0.1), (-0.25, 0.1, -0.2, -0.2)) e(ax, ay, bx, b_y)
    ), edge AS (SELECT CAST(ax AS DOUBLE) AS ax, CAST(ay AS DOUBLE) AS ay, CAST(bx AS DOUBLE) AS bx, CAST(b_y AS DOUBLE) AS b_y FROM edges)
"""
POINT_SQL = """
    points AS (SELECT vec_id, label % 2 AS season, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
                      CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
"""


def points(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.select(
        "vec_id",
        (F.col("label") % 2).alias("season"),
        *[e[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "z"))],
    )


@query(
    "x1_points_in_polygon",
    f"""
    WITH {RING_SQL}, {POINT_SQL}
    SELECT vec_id FROM points p, edge
    GROUP BY vec_id
    HAVING count(*) FILTER ((ay > y) <> (b_y > y) AND x < ax + (y - ay) / nullif(b_y - ay, 0) * (bx - ax)) % 2 = 1
    """,
)
def x1_points_in_polygon(t: Tables) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return points(t).where(inside_box(x, y, RING)).where(inside_polygon(x, y, ring_column(RING))).select("vec_id")


@query(
    "x1_grid_in_polygon",
    f"""
    WITH {RING_SQL}, m AS (SELECT avg(CAST(embedding[3] AS DOUBLE)) AS level FROM embeddings),
    g AS (SELECT ix, iy, -0.25 + (ix + 0.5) * (0.5 / 40) AS x, -0.2 + (iy + 0.5) * (0.45 / 40) AS y FROM range(40) a(ix), range(40) b(iy)),
    kept AS (
        SELECT ix, iy FROM g, edge GROUP BY ix, iy
        HAVING count(*) FILTER ((ay > y) <> (b_y > y) AND x < ax + (y - ay) / nullif(b_y - ay, 0) * (bx - ax)) % 2 = 1
    )
    SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, round(level, 8) AS level FROM kept, m
    """,
)
def x1_grid_in_polygon(t: Tables) -> DataFrame:
    grid = polygon_grid(t.spark, RING, 40).select("ix", "iy")
    return attach(grid, points(t).agg(F.round(F.avg("z"), 8).alias("level")), [])


def _lags_sql(rows: str, key: str) -> str:
    """Classes of a relation's pairs, by true distance; a third of the extent's diagonal each."""
    return f"""
    spans AS (SELECT {key}, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) AS far FROM {rows} GROUP BY {key}),
    pairs AS (
        SELECT {", ".join(f"a.{k.strip()}" for k in key.split(","))}, far, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2, (a.z - b.z) ** 2 AS sq
        FROM {rows} a JOIN {rows} b USING ({key}) JOIN spans USING ({key}) WHERE a.vec_id < b.vec_id
    ), lags AS (
        SELECT {key}, CAST(least(coalesce(floor(sqrt(d2) * 3 / nullif(far, 0)), 0), 2) AS INTEGER) AS lag, count(*) AS pairs,
               sqrt(avg(d2)) AS distance, avg(sq) / 2 AS gamma
        FROM pairs GROUP BY ALL
    )"""


def _fit_sql(key: str) -> str:
    """Least squares over 64 ranges, with nugget and sill solved for each."""
    return f"""
    tried AS (
        SELECT {key}, k, far, pairs AS w, gamma AS g, 1.5 * h - 0.5 * h * h * h AS f
        FROM (SELECT *, least(distance * 64 / (far * k), 1.0) AS h
              FROM (SELECT *, max(distance) OVER (PARTITION BY {key}) AS far, unnest(range(1, 65)) AS k FROM lags))
    ), sums AS (
        SELECT {key}, k, far, sum(w) AS w, sum(w * f) AS wf, sum(w * g) AS wg, sum(w * f * f) AS wff, sum(w * f * g) AS wfg, sum(w * g * g) AS wgg
        FROM tried GROUP BY ALL
    ), lines AS (
        SELECT *, (w * wfg - wf * wg) / (w * wff - wf * wf) AS b FROM sums WHERE w * wff - wf * wf > 1e-9 * w * wff
    ), solved AS (
        SELECT {key}, k, far, w, wf, wg, wff, wfg, wgg, greatest((wg - b * wf) / w, 0) AS c0,
               CASE WHEN wg - b * wf < 0 THEN wfg / wff ELSE b END AS c1
        FROM lines
    ), models AS (
        SELECT {key}, arg_min(c1, (round((wgg - 2 * c0 * wg - 2 * c1 * wfg + c0 * c0 * w + 2 * c0 * c1 * wf + c1 * c1 * wff) / wgg, 9), k)) AS rise
        FROM solved GROUP BY {key}
    )"""


@query(
    "x2_variogram",
    f"""
    WITH {POINT_SQL}, {_lags_sql("points", "season")}
    SELECT season, lag, pairs, round(distance, 8) AS distance, round(gamma, 8) AS gamma FROM lags
    """,
)
def x2_variogram(t: Tables) -> DataFrame:
    return across(variogram(points(t), ["season"], "x", "y", "z"), ["distance", "gamma"], lambda c: F.round(c, 8))


@query(
    "x2_variogram_all_pairs",
    f"""
    WITH {POINT_SQL}
    SELECT a.season, count(*) AS pairs, round(avg((a.z - b.z) ** 2) / 2, 8) AS gamma
    FROM points a JOIN points b ON a.season = b.season AND a.vec_id < b.vec_id GROUP BY 1
    """,
)
def x2_variogram_all_pairs(t: Tables) -> DataFrame:
    """Over all classes."""
    lags = variogram(points(t), ["season"], "x", "y", "z")
    pairs = F.sum("pairs")
    return lags.groupBy("season").agg(
        pairs.alias("pairs"), F.round(F.sum(F.col("gamma") * F.col("pairs")) / pairs, 8).alias("gamma")
    )


MAPPED_SQL = """
    places AS (
        SELECT vec_id, label % 2 AS season, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
               CAST(embedding[3] AS DOUBLE) AS e2 FROM embeddings
    ), mapped AS (
        SELECT vec_id, season, x, y, 'free' AS parameter, e2 AS z FROM places
        UNION ALL SELECT vec_id, season, x, y, 'sloped', x + y + e2 FROM places
        UNION ALL SELECT vec_id, season, x, y, 'domed', x * x + y * y + e2 * e2 FROM places
    )
"""


def _mapped(t: Tables) -> Kriging:
    """Three parameters per season: one that does not depend on the place, and two that do."""
    keys = ["season", "parameter"]
    x, y, z = (F.col(c) for c in "xyz")
    values = {"free": z, "sloped": x + y + z, "domed": x * x + y * y + z * z}
    named = [F.struct(F.lit(n).alias("parameter"), v.alias("z")) for n, v in values.items()]
    rows = points(t).select("season", "x", "y", F.inline(F.array(*named)))
    return krige(rows, fit_spherical(variogram(rows, keys, "x", "y", "z"), keys), keys, "x", "y", "z", cell=0.05)


@query("x3_kriging_surface")
def x3_kriging_surface(t: Tables) -> DataFrame:
    return _mapped(t).surface(RING, pixels=500)


@query(
    "x3_values_at_points",
    f"""
    WITH {MAPPED_SQL}, {_lags_sql("mapped", "season, parameter")}, {_fit_sql("season, parameter")},
    cells AS (
        SELECT season, parameter, CAST(floor(x / 0.05) AS BIGINT) AS cx, CAST(floor(y / 0.05) AS BIGINT) AS cy, round(avg(z), 6) AS prediction
        FROM mapped GROUP BY ALL
    )
    SELECT cells.* FROM cells JOIN models USING (season, parameter) WHERE rise > 0
    """,
)
def x3_values_at_points(t: Tables) -> DataFrame:
    """An interpolated surface goes through the points that it is made from."""
    return across(_mapped(t).at_cells(), ["prediction"], lambda c: F.round(c, 6))


@query(
    "x3_tile_sums",
    f"""
    WITH {RING_SQL}, {MAPPED_SQL}, {_lags_sql("mapped", "season, parameter")}, {_fit_sql("season, parameter")},
    grid AS (
        SELECT ix, iy, -0.25 + (ix + 0.5) * (0.5 / 500) AS x, -0.2 + (iy + 0.5) * (0.45 / 500) AS y FROM range(500) a(ix), range(500) b(iy)
    ), kept AS (
        SELECT ix, iy FROM grid, edge GROUP BY ix, iy
        HAVING count(*) FILTER ((ay > y) <> (b_y > y) AND x < ax + (y - ay) / nullif(b_y - ay, 0) * (bx - ax)) % 2 = 1
    )
    SELECT season, parameter, (SELECT count(*) FROM kept) AS pixels, 0.0::DOUBLE AS weights FROM models WHERE rise > 0
    """,
)
def x3_tile_sums(t: Tables) -> DataFrame:
    """Pixels of each surface, and what the weights of its tiles add up to at most."""
    mapped, keys = _mapped(t), ["season", "parameter"]
    drawn = mapped.surface(RING, pixels=500).groupBy(*keys).agg(F.count("prediction").alias("pixels"))
    total = F.abs(F.aggregate("weights", F.lit(0.0), lambda s, w: s + w["w"]))
    sums = mapped.systems.groupBy(*keys).agg(F.round(F.max(total), 8).alias("weights"))
    return attach(drawn, sums, keys)


@query(
    "x4_group_status",
    f"""
    WITH {POINT_SQL}, s AS (SELECT vec_id, CASE WHEN vec_id < 2 THEN 9 ELSE season END AS season, x, y, z FROM points),
    {_lags_sql("s", "season")}, {_fit_sql("season")},
    cells AS (SELECT season, count(DISTINCT (floor(x / 0.05), floor(y / 0.05))) AS n FROM s GROUP BY 1)
    SELECT season, CASE WHEN n < 3 THEN 'too few points' WHEN coalesce(rise, 0) <= 0 THEN 'no spatial structure' ELSE 'ok' END AS status,
           CAST(n AS INTEGER) AS points
    FROM cells LEFT JOIN models USING (season)
    """,
)
def x4_group_status(t: Tables) -> DataFrame:
    """One group has two points only: it reports so instead of failing the job."""
    rows = points(t).withColumn("season", F.when(F.col("vec_id") < 2, 9).otherwise(F.col("season")))
    models = fit_spherical(variogram(rows, ["season"], "x", "y", "z"), ["season"])
    groups = krige(rows, models, ["season"], "x", "y", "z", cell=0.05).groups
    return groups.select("season", "status", F.col("points").cast("int").alias("points"))
