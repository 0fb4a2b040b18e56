"""Projection, typing and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.functions.nulls import clamp_below, log_offset, null_if, to_number
from brackish.functions.times import flag_at, season_by_cut, season_by_month
from brackish.operators.ordered import exact_quantiles, with_row_index
from brackish.operators.project import across, add_suffix, bin_by_edges, column_range, relocate
from brackish.operators.reshape import rank_levels, relabel
from brackish.plans.catalog import Tables, query


@query(
    "p1_select_rename_range",
    """
    SELECT l_orderkey AS sample, l_quantity AS quantity, l_extendedprice, l_discount, l_tax FROM lineitem
    """,
)
def p1_select_rename_range(t: Tables) -> DataFrame:
    kept = t.lineitem.select("l_orderkey", *column_range(t.lineitem, "l_quantity", "l_shipdate"))
    kept = kept.drop("l_returnflag", "l_linestatus", "l_shipdate")
    return kept.withColumnsRenamed({"l_orderkey": "sample", "l_quantity": "quantity"})


@query("p2_move_column", "SELECT o_orderdate, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def p2_move_column(t: Tables) -> DataFrame:
    return relocate(t.orders, ["o_orderdate"], before="o_orderkey")


@query(
    "p3_suffix_range",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS l_quantity_seep, l_extendedprice AS l_extendedprice_seep,
           l_discount AS l_discount_seep, l_tax AS l_tax_seep
    FROM lineitem
    """,
)
def p3_suffix_range(t: Tables) -> DataFrame:
    rows = t.lineitem.drop("l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")
    return add_suffix(rows, column_range(rows, "l_quantity", "l_tax"), "_seep")


@query(
    "p4_derived_columns",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 6) AS net,
           round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 8) AS gross
    FROM lineitem
    """,
)
def p4_derived_columns(t: Tables) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.withColumns({"net": F.round(net, 6), "gross": F.round(net * (1 + F.col("l_tax")), 8)}).select(
        "l_orderkey", "l_partkey", "l_suppkey", "net", "gross"
    )


@query(
    "p5_across_columns",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, round(ln(l_quantity + 0.001), 8) AS l_quantity,
           round(ln(l_extendedprice + 0.001), 8) AS l_extendedprice, round(ln(l_discount + 0.001), 8) AS l_discount,
           round(ln(l_tax + 0.001), 8) AS l_tax
    FROM lineitem
    """,
)
def p5_across_columns(t: Tables) -> DataFrame:
    columns = column_range(t.lineitem, "l_quantity", "l_tax")
    logged = across(t.lineitem, columns, lambda c: F.round(log_offset(c, 0.001), 8))
    return logged.select("l_orderkey", "l_partkey", "l_suppkey", *columns)


@query(
    "p6_multiway_conditional",
    """
    SELECT event_id, CASE WHEN event_type = 'click' THEN 'Day' WHEN event_type = 'view' THEN 'Night'
                          WHEN event_type IN ('error', 'signup') AND value > 50 THEN 'Night' ELSE NULL END AS day_night
    FROM events
    """,
)
def p6_multiway_conditional(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    label = (
        F.when(kind == "click", "Day")
        .when(kind == "view", "Night")
        .when(kind.isin("error", "signup") & (F.col("value") > 50), "Night")
    )
    return t.events.select("event_id", label.alias("day_night"))


@query(
    "p7_clamp_below_zero",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance FROM customer",
)
def p7_clamp_below_zero(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", clamp_below(F.col("c_acctbal")).alias("balance"))


@query(
    "p8_relabel",
    """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS status,
           CASE o_orderstatus WHEN 'F' THEN 'Dry Season' WHEN 'O' THEN 'Wet Season' END AS season
    FROM orders
    """,
)
def p8_relabel(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey",
        relabel(status, {"F": "Final", "O": "Open"}).alias("status"),
        relabel(status, {"F": "Dry Season", "O": "Wet Season"}, F.lit(None).cast("string")).alias("season"),
    )


@query(
    "p9_ordered_category",
    """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 WHEN 'O' THEN 3 END AS status_order
    FROM orders
    """,
)
def p9_ordered_category(t: Tables) -> DataFrame:
    return rank_levels(t.orders, "o_orderstatus", ["P", "F", "O"], "status_order").select("o_orderkey", "status_order")


@query(
    "p9_category_by_median",
    """
    WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY event_type)
    SELECT event_type, round(median, 6) AS median, CAST(row_number() OVER (ORDER BY median, event_type) AS INTEGER) AS level
    FROM m
    """,
)
def p9_category_by_median(t: Tables) -> DataFrame:
    medians = exact_quantiles(t.events, ["event_type"], "value", {"median": 0.5})
    ranked = with_row_index(medians, [], ["median", "event_type"], "_i")
    level = (F.col("_i") + 1).cast("int")
    return ranked.select("event_type", F.round("median", 6).alias("median"), level.alias("level"))


@query(
    "p10_sentinel_to_null",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, nullif(l_quantity, 10) AS l_quantity, nullif(l_linenumber, 10) AS l_linenumber
    FROM lineitem
    """,
)
def p10_sentinel_to_null(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber")
    return across(rows, ["l_quantity", "l_linenumber"], lambda c: null_if(c, 10))


@query(
    "p11_null_to_default",
    "SELECT l_orderkey, l_partkey, l_suppkey, coalesce(nullif(l_discount, 0.05), 0) AS l_discount FROM lineitem",
)
def p11_null_to_default(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", null_if(F.col("l_discount"), 0.05).alias("l_discount"))
    return rows.fillna(0.0, ["l_discount"])


@query(
    "p12_tolerant_cast",
    r"""
    SELECT event_id, TRY_CAST(trim(CASE WHEN event_type = 'click' THEN ' ' WHEN event_type = 'view' THEN 'N/A'
                                        ELSE ' ' || CAST(value AS VARCHAR) || ' ' END) AS DOUBLE) AS number
    FROM events
    """,
)
def p12_tolerant_cast(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    text = F.when(kind == "click", " ").when(kind == "view", "N/A").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
    return t.events.select("event_id", to_number(text).alias("number"))


@query(
    "p13_drop_nulls",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount FROM lineitem
    WHERE nullif(l_quantity, 10) IS NOT NULL AND nullif(l_discount, 0) IS NOT NULL
    """,
)
def p13_drop_nulls(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey",
        null_if(F.col("l_quantity"), 10.0).alias("l_quantity"), null_if(F.col("l_discount"), 0.0).alias("l_discount"),
    )
    return rows.dropna(subset=["l_quantity"]).dropna()


@query(
    "p14_time_windows",
    """
    SELECT event_id, ts FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-09'
       OR (ts >= TIMESTAMP '2024-01-21' AND ts <= TIMESTAMP '2024-01-22' AND event_type = 'view')
    """,
)
def p14_time_windows(t: Tables) -> DataFrame:
    def at(text: str):
        return F.lit(text).cast("timestamp_ntz")

    first = F.col("ts").between(at("2024-01-04"), at("2024-01-09"))
    second = (F.col("ts") >= at("2024-01-21")) & (F.col("ts") <= at("2024-01-22")) & (F.col("event_type") == "view")
    return t.events.where(first | second).select("event_id", "ts")


@query(
    "p15_membership_and_cuts",
    """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice < 400000 AND o_totalprice > 1500 AND o_orderstatus <> 'P'
    """,
)
def p15_membership_and_cuts(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    wanted = F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & (F.col("o_orderstatus") != "P")
    return t.orders.where(wanted & (price < 400000) & (price > 1500)).select("o_orderkey", "o_totalprice")


@query(
    "p16_numeric_bins",
    """
    SELECT p_partkey, CASE WHEN p_size <= 10 THEN '<10' ELSE '>10' END AS two,
           CASE WHEN p_retailprice < 920 THEN 'Low' WHEN p_retailprice < 960 THEN 'Mid' ELSE 'High' END AS three
    FROM part
    """,
)
def p16_numeric_bins(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        bin_by_edges(F.col("p_size"), [10], ["<10", ">10"]).alias("two"),
        bin_by_edges(F.col("p_retailprice"), [920, 960], ["Low", "Mid", "High"], right_closed=False).alias("three"),
    )


@query(
    "p17_season",
    """
    SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-02' THEN 'Dry' ELSE 'Wet' END AS by_cut,
           CASE WHEN month(o_orderdate) IN (12, 1, 2, 3, 4, 5) THEN 'Rainy' ELSE 'Dry' END AS by_month
    FROM orders
    """,
)
def p17_season(t: Tables) -> DataFrame:
    date = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        season_by_cut(date, "1998-01-02", "Dry", "Wet").alias("by_cut"),
        season_by_month(date, [12, 1, 2, 3, 4, 5], "Rainy", "Dry").alias("by_month"),
    )


@query(
    "p18_event_flag",
    """
    SELECT o_orderkey, CASE WHEN o_orderdate = TIMESTAMP '1998-03-21' THEN 'yes' ELSE 'no' END AS at_time,
           CASE WHEN o_orderdate = TIMESTAMP '1998-03-21' AND o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS with_status
    FROM orders
    """,
)
def p18_event_flag(t: Tables) -> DataFrame:
    at = flag_at(F.col("o_orderdate"), "1998-03-21")
    both = F.when((at == "yes") & (F.col("o_orderstatus") == "F"), "yes").otherwise("no")
    return t.orders.select("o_orderkey", at.alias("at_time"), both.alias("with_status"))


@query(
    "p19_constant_tags",
    "SELECT event_id, value, 'North' AS site, 'Dry' AS season FROM events",
)
def p19_constant_tags(t: Tables) -> DataFrame:
    return t.events.select("event_id", "value").withColumns({"site": F.lit("North"), "season": F.lit("Dry")})
