"""Sources and sinks: tables derived from the supplied ones, written as files, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.functions.times import floor_time, parse_time
from brackish.operators.keys import join_on
from brackish.operators.reshape import stack
from brackish.plans.catalog import Tables, query
from brackish.session import scratch_path
from brackish.sources.delimited import mixed_dates, read_by_header, read_logger_folder, read_table, unify_columns
from brackish.sources.tables import grid_slice, replace_partitions, sampling_times, through_table, write_results
from brackish.sources.text import polygon_vertices, read_columns, read_polygons, read_tides

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _logger_rows(t: Tables) -> DataFrame:
    return t.events.select(F.date_format("ts", ISO).alias("date"), "event_type", "value", "event_id")


@query(
    "s1_delimited_table",
    """
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value,
           min(date_trunc('second', ts)) AS first_date, max(date_trunc('second', ts)) AS last_date
    FROM events GROUP BY event_type
    """,
)
def s1_delimited_table(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    write_results(_logger_rows(t), path, fmt="csv")
    rows = read_table(t.spark, path, "date string, event_type string, value double, event_id bigint")
    return (
        rows.withColumn("date", parse_time(F.col("date")))
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg("value"), 6).alias("mean_value"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
    )


@query(
    "s2_logger_folder",
    "SELECT event_id, value, date_trunc('second', ts) AS date, TRUE AS tagged FROM events",
)
def s2_logger_folder(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "loggers")
    write_results(_logger_rows(t), path, ["event_type"], fmt="csv")
    rows = read_logger_folder(t.spark, path, "date string, value double, event_id bigint")
    return rows.select(
        "event_id", "value", parse_time(F.col("date")).alias("date"), F.col("filename").endswith(".csv").alias("tagged")
    )


@query(
    "s3_two_date_formats",
    """
    SELECT event_id,
           CASE WHEN event_type IN ('click', 'view') THEN date_trunc('minute', ts)
                ELSE date_trunc('second', ts) END AS date
    FROM events
    """,
)
def s3_two_date_formats(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type").isin("click", "view"), F.date_format("ts", "M/d/yyyy H:mm")).otherwise(
        F.date_format("ts", ISO)
    )
    rows = t.events.select("event_id", text.alias("date"))
    return mixed_dates(rows, "date", ["yyyy-MM-dd'T'HH:mm:ssX", "M/d/yyyy H:mm"])


@query(
    "s4_column_under_two_names",
    "SELECT event_id, ts AS date, value FROM events",
)
def s4_column_under_two_names(t: Tables) -> DataFrame:
    upper = t.events.where(F.col("event_type") == "click").select("event_id", F.col("ts").alias("Date_"), "value")
    lower = t.events.where(F.col("event_type") != "click").select("event_id", F.col("ts").alias("date"), "value")
    return unify_columns(stack(upper, lower), "date", ["date", "Date_"])


@query(
    "s5_tide_file",
    """
    SELECT date_trunc('hour', ts) AS date, round(avg(value), 6) AS tideheight, 'Dry' AS season
    FROM events GROUP BY 1
    """,
)
def s5_tide_file(t: Tables) -> DataFrame:
    hourly = t.events.groupBy(floor_time(F.col("ts"), "hour").alias("at")).agg(F.avg("value").alias("v"))
    at = F.col("at")
    lines = hourly.select(
        F.concat_ws(
            "\t",
            F.date_format(at, "yyyy/MM/dd"),
            F.date_format(at, "EEE"),
            F.date_format(at, "HH:mm"),
            F.round("v", 6).cast("string"),
            F.lit(""),
        ).alias("value")
    )
    preamble = t.region.select(F.concat(F.lit("Station: "), F.col("r_name")).alias("value"))
    path = scratch_path(t.spark, "tides")
    preamble.unionByName(lines).write.text(path)
    return read_tides(t.spark, path, season="Dry")


@query(
    "s6_whitespace_file",
    """
    SELECT nullif(CAST(l_orderkey AS DOUBLE), 9999) AS serial, l_quantity AS temperature,
           nullif(l_extendedprice, 9999) AS salinity, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS wave_height
    FROM lineitem
    """,
)
def s6_whitespace_file(t: Tables) -> DataFrame:
    gap = F.when(F.col("l_discount") == 0, 9999.0).otherwise(F.col("l_discount"))
    columns = ["l_orderkey", "l_tax", "l_quantity", "l_suppkey", "l_extendedprice"]
    line = F.concat_ws("   ", *[F.col(c).cast("string") for c in columns], gap.cast("string"))
    path = scratch_path(t.spark, "profiler")
    t.lineitem.select(F.concat(F.lit("  "), line).alias("value")).write.text(path)
    wanted = {"serial": 0, "temperature": 2, "salinity": 4, "wave_height": 5}
    return read_columns(t.spark, path, wanted, sentinel=9999.0)


@query(
    "s7_messy_headers",
    """
    SELECT date_trunc('minute', ts) AS full_date, value AS radon_in_water_dpm_l, event_id AS test_number
    FROM events
    """,
)
def s7_messy_headers(t: Tables) -> DataFrame:
    date = F.date_format("ts", "M/d/yyyy H:mm")
    click = F.col("event_type") == "click"
    short = t.events.where(click).select(
        F.col("event_id").alias("Test #"), date.alias("Full Date"), F.col("value").alias("Radon In Water [Dpm/L]")
    )
    wide = t.events.where(~click).select(
        F.col("event_id").alias("Test #"),
        F.col("user_id").alias("Pump Current [mA]"),
        date.alias("Full Date"),
        F.lit(0.5).alias("Radon In Water 2-Sigma Uncert. [Dpm/L]"),
        F.col("value").alias("Radon In Water [Dpm/L]"),
    )
    root = scratch_path(t.spark, "radon")
    write_results(short, f"{root}/short", fmt="csv")
    write_results(wide, f"{root}/wide", fmt="csv")
    wanted = {"full_date": "timestamp", "radon_in_water_dpm_l": "double", "test_number": "bigint"}
    return read_by_header(t.spark, root, wanted)


@query(
    "s8_polygon_file",
    """
    WITH box AS (
        SELECT c_mktsegment AS name, min(c_custkey) AS x0, max(c_custkey) AS x1,
               min(c_acctbal) AS y0, max(c_acctbal) AS y1
        FROM customer GROUP BY c_mktsegment
    )
    SELECT name, CAST(0 AS INTEGER) AS corner, CAST(x0 AS DOUBLE) AS lon, y0 AS lat FROM box
    UNION ALL SELECT name, 1, x1, y0 FROM box
    UNION ALL SELECT name, 2, x1, y1 FROM box
    UNION ALL SELECT name, 3, x0, y1 FROM box
    UNION ALL SELECT name, 4, x0, y0 FROM box
    """,
)
def s8_polygon_file(t: Tables) -> DataFrame:
    box = t.customer.groupBy("c_mktsegment").agg(
        F.min("c_custkey").alias("x0"),
        F.max("c_custkey").alias("x1"),
        F.min("c_acctbal").alias("y0"),
        F.max("c_acctbal").alias("y1"),
    )
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    text = F.concat_ws(" ", *[F.concat_ws(",", F.col(x), F.col(y), F.lit("0")) for x, y in corners])
    marks = box.select(
        F.col("c_mktsegment").alias("name"),
        F.struct(
            F.struct(F.struct(text.alias("coordinates")).alias("LinearRing")).alias("outerBoundaryIs")
        ).alias("Polygon"),
    )
    path = scratch_path(t.spark, "polygons")
    marks.write.format("xml").option("rootTag", "Document").option("rowTag", "Placemark").save(path)
    return polygon_vertices(read_polygons(t.spark, path))


@query(
    "s9_literal_table",
    """
    WITH sample(datetime, sample_type) AS (VALUES
        (TIMESTAMP '2024-01-02 05:00:00', 'All Sites'), (TIMESTAMP '2024-01-02 08:00:00', 'Seep Only'),
        (TIMESTAMP '2024-01-05 11:00:00', 'All Sites'), (TIMESTAMP '2024-01-09 14:00:00', 'Seep Only'),
        (TIMESTAMP '2030-01-01 00:00:00', 'Seep Only'))
    SELECT s.datetime, s.sample_type, count(e.event_id) AS n
    FROM sample s LEFT JOIN events e ON date_trunc('hour', e.ts) = s.datetime
    GROUP BY 1, 2
    """,
)
def s9_literal_table(t: Tables) -> DataFrame:
    times = ["2024-01-02 05:00:00", "2024-01-02 08:00:00", "2024-01-05 11:00:00", "2024-01-09 14:00:00", "2030-01-01 00:00:00"]
    sample = sampling_times(t.spark, times, ["All Sites", "Seep Only", "All Sites", "Seep Only", "Seep Only"])
    hourly = t.events.groupBy(floor_time(F.col("ts"), "hour").alias("datetime")).agg(F.count(F.lit(1)).alias("n"))
    return join_on(sample, hourly, ["datetime"], "left").fillna(0, ["n"])


@query(
    "s10_write_partitioned",
    """
    SELECT l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS quantity
    FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_linestatus
    """,
)
def s10_write_partitioned(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "results")
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_shipdate")
    write_results(rows, path, ["l_returnflag", "l_linestatus"])
    return (
        t.spark.read.parquet(path)
        .where(F.col("l_returnflag") == "R")
        .groupBy("l_linestatus")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))
    )


@query(
    "s10_rerun_replaces",
    """
    SELECT l_returnflag, count(*) AS n,
           round(sum(CASE WHEN l_returnflag = 'R' THEN 2 * l_quantity ELSE l_quantity END), 6) AS quantity
    FROM lineitem GROUP BY l_returnflag
    """,
)
def s10_rerun_replaces(t: Tables) -> DataFrame:
    """All partitions, then one of them twice again with corrected values."""
    path = scratch_path(t.spark, "replaced")
    rows = t.lineitem.select("l_returnflag", "l_quantity", "l_shipdate")
    replace_partitions(rows, path, ["l_returnflag"])
    corrected = rows.where(F.col("l_returnflag") == "R").withColumn("l_quantity", 2 * F.col("l_quantity"))
    for _ in range(2):
        replace_partitions(corrected, path, ["l_returnflag"])
    return (
        t.spark.read.parquet(path)
        .groupBy("l_returnflag")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))
    )


@query(
    "s11_chained_tables",
    """
    WITH hourly AS (
        SELECT event_type, date_trunc('hour', ts) AS date, avg(value) AS mean FROM events GROUP BY 1, 2
    )
    SELECT event_type, date_trunc('day', date) AS date, round(avg(mean), 9) AS mean, count(*) AS hours
    FROM hourly GROUP BY 1, 2
    """,
)
def s11_chained_tables(t: Tables) -> DataFrame:
    hourly = t.events.groupBy("event_type", floor_time(F.col("ts"), "hour").alias("date")).agg(F.avg("value").alias("mean"))
    stored = through_table(hourly, scratch_path(t.spark, "hourly"))
    return stored.groupBy("event_type", floor_time(F.col("date"), "day").alias("date")).agg(
        F.round(F.avg("mean"), 9).alias("mean"), F.count(F.lit(1)).alias("hours")
    )


@query(
    "s12_grid_slice",
    """
    WITH span AS (
        SELECT l_shipdate, l_suppkey, l_linenumber, l_quantity FROM lineitem
        WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'
    ), best AS (
        SELECT l_suppkey, l_linenumber FROM span
        ORDER BY (l_suppkey - 42.3) * (l_suppkey - 42.3) + (l_linenumber - 3.6) * (l_linenumber - 3.6),
                 l_suppkey, l_linenumber LIMIT 1
    )
    SELECT l_shipdate - INTERVAL 10 HOURS AS l_shipdate, l_suppkey, l_linenumber, l_quantity
    FROM span JOIN best USING (l_suppkey, l_linenumber)
    """,
)
def s12_grid_slice(t: Tables) -> DataFrame:
    grid = t.lineitem.select("l_shipdate", "l_suppkey", "l_linenumber", "l_quantity")
    return grid_slice(
        grid, "l_shipdate", "1996-01-01", "1998-12-31", "l_suppkey", "l_linenumber", (42.3, 3.6), hours_from_utc=-10
    )
