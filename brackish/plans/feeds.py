"""Streaming forms, run over the supplied events as a file source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.functions.times import floor_time
from brackish.operators.keys import join_on
from brackish.operators.project import across
from brackish.plans.catalog import Tables, query
from brackish.session import scratch_path
from brackish.streaming.feeds import enrich, open_feed, run_again, run_to_table, sliding_mean, tumbling_mean, with_open_windows
from brackish.streaming.late import closed_windows, keyed_state, late_rows, windows_and_late_rows


def feed(t: Tables) -> DataFrame:
    return open_feed(t.spark, t.path("events") + "*", t.events.schema)


@query(
    "t1_tumbling_mean",
    """
    WITH h AS (SELECT event_type, date_trunc('hour', ts) AS start, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT event_type, start, round(mean, 6) AS mean, n FROM h
    """,
)
def t1_tumbling_mean(t: Tables) -> DataFrame:
    """All windows: those the watermark has closed, and at the feed's end the open ones."""

    def build(rows: DataFrame) -> DataFrame:
        return tumbling_mean(rows, ["event_type"], "ts", "value")

    means = run_to_table(build(feed(t)), "tumbling")
    means = with_open_windows(means, t.events, ["event_type"], "ts", "2 HOURS", build)
    return means.select("event_type", "start", F.round("mean", 6).alias("mean"), "n")


@query(
    "t2_sliding_mean",
    """
    WITH m AS (SELECT event_type, date_trunc('minute', ts) AS minute, sum(value) AS s, count(*) AS n FROM events GROUP BY 1, 2),
    w AS (SELECT event_type, minute - to_minutes(CAST(k AS INTEGER)) AS start, sum(s) / sum(n) AS mean, CAST(sum(n) AS BIGINT) AS n
          FROM m, range(60) r(k) GROUP BY 1, 2)
    SELECT event_type, start, round(mean, 6) AS mean, n FROM w
    """,
)
def t2_sliding_mean(t: Tables) -> DataFrame:
    def build(rows: DataFrame) -> DataFrame:
        return sliding_mean(rows, ["event_type"], "ts", "value")

    means = run_to_table(build(feed(t)), "sliding")
    means = with_open_windows(means, t.events, ["event_type"], "ts", "122 MINUTES", build)
    return across(means.select("event_type", "start", "mean", "n"), ["mean"], lambda c: F.round(c, 6))


@query(
    "t3_stream_enrichment",
    """
    WITH tide AS (SELECT date_trunc('hour', ts) AS hour, round(avg(value), 6) AS height FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT event_id, ts, value, height FROM events LEFT JOIN tide ON date_trunc('hour', ts) = hour
    """,
)
def t3_stream_enrichment(t: Tables) -> DataFrame:
    tide = (
        t.events.where(F.col("event_type") == "error")
        .groupBy(floor_time(F.col("ts"), "hour").alias("ts"))
        .agg(F.round(F.avg("value"), 6).alias("height"))
    )
    rows = feed(t).select("event_id", "ts", "value")
    return run_to_table(enrich(rows, tide, [], "hour", "ts"), "enriched")


#: Uploads of the feed with late loggers.
UPLOADS = 4


def late_feed(t: Tables) -> DataFrame:
    """Events with the number of the upload they came in: every tenth user's loggers are a day late."""
    late = F.when(F.col("user_id") % 10 == 0, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    come = t.events.withColumn("_come", F.unix_micros((F.col("ts") + late).cast("timestamp")))
    first, last = (come.select(f("_come")).scalar() for f in (F.min, F.max))
    share = F.floor((F.col("_come") - first) * UPLOADS / (last - first + 1))
    return come.withColumn("upload", share.cast("int")).drop("_come")


@query(
    "t1_late_rows",
    """
    WITH come AS (SELECT *, epoch_us(ts + CASE WHEN user_id % 10 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END) AS c FROM events),
    ends AS (SELECT min(c) AS first, max(c) AS last FROM come),
    fed AS (SELECT event_type, ts, value, date_trunc('hour', ts) AS start, CAST(floor((c - first) * 4 / (last - first + 1)) AS INTEGER) AS upload
            FROM come, ends),
    marks AS (SELECT upload, max(max(ts)) OVER (ORDER BY upload ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS mark,
                     max(max(ts)) OVER () - INTERVAL 1 HOUR AS closing
              FROM fed GROUP BY upload),
    judged AS (SELECT event_type, start, value,
                      CASE WHEN start + INTERVAL 1 HOUR <= mark THEN 'late'
                           WHEN start + INTERVAL 1 HOUR <= closing THEN 'emitted' ELSE 'open' END AS kind
               FROM fed JOIN marks USING (upload))
    SELECT event_type, start, round(avg(value) FILTER (kind = 'emitted'), 6) AS mean, count(*) FILTER (kind = 'emitted') AS n_emitted,
           count(*) FILTER (kind = 'late') AS n_late, count(*) FILTER (kind = 'open') AS n_open
    FROM judged GROUP BY 1, 2
    """,
)
def t1_late_rows(t: Tables) -> DataFrame:
    """Per window: mean of what came in time, readings that came late, readings of open windows.

    The feed has a few readings per window, so a window is one state.
    """
    keys = ["event_type"]
    landing, out, progress = (scratch_path(t.spark, f"uploads-{part}") for part in ("landing", "rows", "progress"))
    uploads = late_feed(t)
    with keyed_state(t.spark):
        for upload in range(UPLOADS):
            uploads.where(F.col("upload") == upload).select("event_type", "ts", "value").write.mode("append").parquet(landing)
            feed = open_feed(t.spark, landing, uploads.select("event_type", "ts", "value").schema)
            written = run_again(windows_and_late_rows(feed, keys, "ts", "value", spread=1), out, progress)
    start = floor_time(F.col("ts"), "hour").alias("start")
    counts = [
        t.events.groupBy(*keys, start).agg(F.count(F.lit(1)).alias("n_rows")),
        closed_windows(written, keys).select(*keys, "start", "n_rows", "mean"),
        late_rows(written, keys).groupBy(*keys, "start").agg(F.count(F.lit(1)).alias("n_late")),
    ]
    whole, closed, late = counts
    joined = join_on(join_on(whole.withColumnRenamed("n_rows", "n"), closed, [*keys, "start"]), late, [*keys, "start"])
    emitted, came_late = (F.coalesce(c, F.lit(0)) for c in ("n_rows", "n_late"))
    return joined.select(
        *keys, "start", F.round("mean", 6).alias("mean"), emitted.alias("n_emitted"), came_late.alias("n_late"),
        (F.col("n") - emitted - came_late).alias("n_open"),
    )
