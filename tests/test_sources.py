"""Ragged input files."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brackish.operators.reshape import hours_to_rows
from brackish.sources import tables
from brackish.sources.delimited import read_by_header, read_logger_folder, read_table
from brackish.sources.text import polygon_vertices, read_columns, read_polygons, read_tides
from brackish.streaming.feeds import open_feed, run_again
from brackish.streaming.late import closed_windows, keyed_state, late_rows, windows_and_late_rows


def test_logger_folder_with_a_header_only_file(spark, tmp_path):
    (tmp_path / "one.csv").write_text("date,Lux\n2022-06-03T07:50:00Z,3876\n2022-06-03T07:52:00Z,\n")
    (tmp_path / "two.csv").write_text("date,Lux\n")
    rows = read_logger_folder(spark, str(tmp_path), "date string, Lux int").collect()
    assert {(r["filename"], r["Lux"]) for r in rows} == {("one.csv", 3876), ("one.csv", None)} and len(rows) == 2


def test_blank_rows(spark, tmp_path):
    path = tmp_path / "cal.csv"
    path.write_text("day,t,mv\n6/14/2023,21.3,-82.5\n,,\n,,\n")
    rows = read_table(spark, str(path), "day string, t double, mv double").dropna(how="all")
    assert rows.count() == 1


def test_tides_with_preamble_and_ragged_tabs(spark, tmp_path):
    path = tmp_path / "tides.txt"
    path.write_text("Daily Tide Predictions\nFrom: 20220314 00:00\n\nDate \tDay\tTime\tPred\t\n"
                    "2022/03/14\tMon\t00:00\t0.22\t\n2022/03/14\tMon\t01:00\t0.20\t\n\t\n")
    rows = read_tides(spark, str(path), season="Wet").orderBy("date").collect()
    assert [(r["date"], r["tideheight"], r["season"]) for r in rows] == [
        (datetime(2022, 3, 14, 0), 0.22, "Wet"), (datetime(2022, 3, 14, 1), 0.2, "Wet")
    ]


def test_whitespace_columns_and_sentinel(spark, tmp_path):
    path = tmp_path / "profile.txt"
    path.write_text("  738000.5  2021   9999  1.5\n738001.5 2021 4 9999\n\n")
    rows = read_columns(spark, str(path), {"serial": 0, "a": 2, "b": 3}, sentinel=9999.0).orderBy("serial").collect()
    assert [tuple(r) for r in rows] == [(738000.5, None, 1.5), (738001.5, 4.0, None)]


def test_layouts_that_differ_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Test #,Full Date,Radon In Water [Dpm/L]\n76,8/4/2021 16:42,0.4\n77,8/4/2021 16:52,N/A\n")
    (tmp_path / "b.csv").write_text('Full Date,Note,Radon In Water [Dpm/L]\n8/9/2021 7:04,"x, y",0.3\n')
    rows = read_by_header(spark, str(tmp_path), {"full_date": "timestamp", "radon_in_water_dpm_l": "double"})
    assert sorted(map(tuple, rows.collect()), key=str) == [
        (datetime(2021, 8, 4, 16, 42), 0.4), (datetime(2021, 8, 4, 16, 52), None), (datetime(2021, 8, 9, 7, 4), 0.3)
    ]


def test_polygon_file(spark, tmp_path):
    path = tmp_path / "area.kml"
    path.write_text("<kml><Document><Placemark><name>P</name><Polygon><outerBoundaryIs><LinearRing><coordinates>\n"
                    " -1.5,-2.5,0 -1.0,-2.0,0\n -1.5,-2.5,0 \n</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>")
    rows = polygon_vertices(read_polygons(spark, str(path))).orderBy("corner").collect()
    assert [(r["name"], r["lon"], r["lat"]) for r in rows] == [("P", -1.5, -2.5), ("P", -1.0, -2.0), ("P", -1.5, -2.5)]


def test_day_hour_matrix(spark):
    hours = [f"{h:02d}h" for h in range(24)]
    df = spark.createDataFrame([("01.08.2021", *[" "] * 23, "4.5")], ["day", *hours])
    rows = hours_to_rows(df, "day", "rain").orderBy("date").collect()
    assert len(rows) == 24 and rows[0]["rain"] is None
    assert (rows[23]["date"], rows[23]["rain"]) == (datetime(2021, 8, 1, 23), 4.5)


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "one.csv").write_text("date,A,B\n2022-06-03,1,2\n")
    (tmp_path / "two.csv").write_text('B,note,date,A\r\n4,"x, ""y""",2022-06-04,3\r\n')
    rows = read_logger_folder(spark, str(tmp_path), "date date, A int, B int, note string").collect()
    got = sorted((r["filename"], str(r["date"]), r["A"], r["B"], r["note"]) for r in rows)
    assert got[0] == ("one.csv", "2022-06-03", 1, 2, None)
    assert got[1] == ("two.csv", "2022-06-04", 3, 4, 'x, "y"')


def test_files_of_any_width(spark, tmp_path):
    names = [f"c{i}" for i in range(400)]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(map(str, range(400))) + "\n")
    row = read_by_header(spark, str(tmp_path), {"c0": "int", "c399": "int"}).first()
    assert (row["c0"], row["c399"]) == (0, 399)


def test_ragged_tides_and_corners(spark, tmp_path):
    path = tmp_path / "tides.txt"
    path.write_text("2022/03/14\tMon\t00:00\n2022/03/14\tMon\t25:00\t0.2\t\n2022/03/14\tMon\t01:00\tx\n")
    rows = read_tides(spark, str(path)).collect()
    assert sorted(((r["date"], r["tideheight"]) for r in rows), key=str) == sorted(
        [(datetime(2022, 3, 14, 0), None), (None, 0.2), (datetime(2022, 3, 14, 1), None)], key=str
    )
    area = tmp_path / "area.kml"
    area.write_text("<kml><Placemark><name>P</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"
                    "1,2,0 bad 3</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></kml>")
    rows = polygon_vertices(read_polygons(spark, str(area))).orderBy("corner").collect()
    assert [(r["lon"], r["lat"]) for r in rows] == [(1.0, 2.0), (None, None), (3.0, None)]


def test_a_run_that_fails_leaves_the_result(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    rows = spark.range(1_000).select("id", (F.col("id") % 4).alias("site"), F.lit("first").alias("run"))
    tables.replace_partitions(rows, path, ["site"])
    second = rows.where("site < 2").withColumn("run", F.lit("second")).repartition(8)
    broken = second.withColumn("run", F.when(F.col("id") == 401, F.raise_error(F.lit("broken"))).otherwise(F.col("run")))

    def found():
        return {(r.site, r.run): r["count"] for r in spark.read.parquet(path).groupBy("site", "run").count().collect()}

    before = {(site, "first"): 250 for site in range(4)}
    with pytest.raises(Exception, match="broken"):
        tables.replace_partitions(broken, path, ["site"])
    assert found() == before
    for _ in range(2):
        tables.replace_partitions(second, path, ["site"])
        assert found() == {(0, "second"): 250, (1, "second"): 250, (2, "first"): 250, (3, "first"): 250}
    tables.replace_partitions(second.limit(0), path, ["site"])
    assert sum(found().values()) == 1_000
    with pytest.raises(ValueError):
        tables.replace_partitions(second, path, [])


def test_late_readings_and_windows_add_up(spark, tmp_path):
    at = lambda day, hour, minute=0: datetime(2024, 1, day, hour, minute)
    uploads = [
        [("a", at(1, 0), 1.0), ("a", at(1, 0, 30), 2.0), (None, at(1, 0, 59), 7.0), ("a", at(1, 5), 3.0), ("b", None, 4.0)],
        # the mark is 04:00: a window that ended then is over, the one that ends at 05:00 is not
        [("a", at(1, 0, 45), 9.0), ("a", at(1, 3, 59), 8.0), ("a", at(1, 4), None), ("a", at(1, 4), 6.0), ("b", at(1, 3), None)],
        [],
        [("a", at(2, 0), 5.0), ("a", at(1, 3), 1.5)],
    ]
    schema = "tag string, date timestamp_ntz, reading double, kind string"
    with keyed_state(spark):
        for rows in uploads:
            frame = spark.createDataFrame([(*r, "k") for r in rows], schema)
            frame.write.mode("append").parquet(str(tmp_path / "landing"))
            feed = open_feed(spark, str(tmp_path / "landing"), frame.schema)
            stream = windows_and_late_rows(feed.drop("kind"), ["tag"], "date", "reading", spread=3)
            written = run_again(stream, str(tmp_path / "rows"), str(tmp_path / "progress"))
    closed = {(r.tag, r.start): (r["mean"], r.n, r.n_rows) for r in closed_windows(written, ["tag"]).collect()}
    assert closed == {
        ("a", at(1, 0)): (1.5, 2, 2), (None, at(1, 0)): (7.0, 1, 1), ("a", at(1, 4)): (6.0, 1, 2), ("a", at(1, 5)): (3.0, 1, 1)
    }
    late = sorted((tuple(r) for r in late_rows(written, ["tag"]).collect()), key=str)
    assert late == sorted([
        ("a", at(1, 0), at(1, 1), at(1, 0, 45), 9.0), ("a", at(1, 3), at(1, 4), at(1, 3, 59), 8.0),
        ("a", at(1, 3), at(1, 4), at(1, 3), 1.5), ("b", at(1, 3), at(1, 4), at(1, 3), None),
    ], key=str)
