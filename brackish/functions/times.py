"""Time columns: parsing, rounding, zone shifts, seasons.

Results are wall-clock times without zone (``timestamp_ntz``); the session runs in UTC.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layouts logger and laboratory files use.
TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ssX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "M/d/yy H:mm:ss",
    "M/d/yy H:mm",
    "M/d/yy",
    "dd.MM.yyyy HH'h'",
    "yyyy/MM/dd HH:mm",
    "yyyyMMdd",
)
# Fixed value: day number of 1970-01-01 counted from year 0.
SERIAL_DAY_OF_EPOCH = 719529


# What each run of pattern letters looks like in the text.
_SHAPES = {
    "yyyy": r"\d{4}", "yy": r"\d{2}", "SSSSSS": r"\d{1,6}", "MM": r"\d{2}", "M": r"\d{1,2}", "dd": r"\d{2}", "d": r"\d{1,2}",
    "HH": r"\d{2}", "H": r"\d{1,2}", "mm": r"\d{2}", "ss": r"\d{2}", "X": r"(?:Z|[+-]\d{2}(?::?\d{2})?)",
}


def _shape(fmt: str) -> str:
    """Regular expression of the texts a layout can parse."""
    tokens = re.finditer(r"'([^']*)'|(([A-Za-z])\3*)|(.)", fmt)
    return "^" + "".join(_SHAPES[t[2]] if t[2] else re.escape(t[1] or t[4]) for t in tokens) + "$"


def parse_time(col: Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """Parse by the first layout whose shape the text has; NULL if none fits.

    The shape decides before parsing: a failed parse attempt costs far more than a match.
    """
    out = F.lit(None).cast("timestamp")
    for fmt in reversed(formats):
        out = F.when(col.rlike(_shape(fmt)), F.try_to_timestamp(col, F.lit(fmt))).otherwise(out)
    return out.cast("timestamp_ntz")


def floor_time(col: Column, unit: str) -> Column:
    return F.date_trunc(unit, col).cast("timestamp_ntz")


def round_time(col: Column, unit: str) -> Column:
    """Nearest hour or minute, halves up."""
    half = {"hour": "INTERVAL 30 MINUTES", "minute": "INTERVAL 30 SECONDS"}[unit]
    return floor_time(col + F.expr(half), unit)


def ceiling_time(col: Column, unit: str) -> Column:
    """Next full unit; a time already on the mark stays."""
    step = {"hour": "INTERVAL 1 HOUR", "minute": "INTERVAL 1 MINUTE"}[unit]
    return floor_time(col + F.expr(step) - F.expr("INTERVAL 0.000001 SECOND"), unit)


def shift_time(col: Column, **parts: int) -> Column:
    """``shift_time(ts, minutes=3)``; negative parts move back."""
    order = ("days", "hours", "mins", "secs")
    names = {"minutes": "mins", "seconds": "secs"}
    given = {names.get(k, k): v for k, v in parts.items()}
    return col + F.make_dt_interval(*[F.lit(given.get(p, 0)) for p in order])


def serial_day_to_time(col: Column) -> Column:
    """Fractional day number to a time, cut to the minute."""
    micros = F.round((col - SERIAL_DAY_OF_EPOCH) * 86400 * 1_000_000).cast("bigint")
    return floor_time(F.timestamp_micros(micros), "minute")


def epoch_micros(col: Column) -> Column:
    """Microseconds since 1970 (the session runs in UTC)."""
    return F.unix_micros(col.cast("timestamp"))


def season_by_cut(col: Column, cut: str, before: str, after: str) -> Column:
    return F.when(col < F.lit(cut).cast("timestamp_ntz"), before).when(col.isNotNull(), after)


def season_by_month(col: Column, months: Iterable[int], inside: str, outside: str) -> Column:
    month = F.month(col)
    return F.when(month.isin(list(months)), inside).when(month.isNotNull(), outside)


def flag_at(col: Column, moment: str) -> Column:
    """"yes" at one exact time, else "no"."""
    hit = col == F.lit(moment).cast("timestamp_ntz")
    return F.when(hit, "yes").when(col.isNotNull(), "no")


def year_month(col: Column) -> Column:
    """``2021-8`` style label."""
    return F.concat_ws("-", F.year(col).cast("string"), F.month(col).cast("string"))
