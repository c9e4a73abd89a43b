"""Date and time expressions. Timestamps carry no zone; text offsets are ignored."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE_PREFIX = r"^\s*\d{4}-\d{1,2}-\d{1,2}"


def at(moment: str | dt.datetime | Column) -> Column:
    """A fixed clock value as a zone-less timestamp."""
    if isinstance(moment, Column):
        return moment
    return F.lit(str(moment)).cast("timestamp_ntz")


def before(moment, *, days: int = 0, hours: int = 0) -> Column:
    """``moment`` minus a number of days and hours."""
    return at(moment) - F.make_dt_interval(F.lit(days), F.lit(hours))


def parse_timestamp(text: Column) -> Column:
    """ISO date or datetime text; NULL when it is neither."""
    return F.when(text.rlike(ISO_DATE_PREFIX), text.try_cast("timestamp_ntz"))


def parse_flexible(text: Column) -> Column:
    """ISO datetime, ISO date or ``dd-mm-YYYY``; NULL for anything else."""
    day_first = F.when(
        text.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"),
        F.concat_ws(
            "-",
            F.regexp_extract(text, r"-(\d{4})$", 1),
            F.regexp_extract(text, r"-(\d{1,2})-", 1),
            F.regexp_extract(text, r"^(\d{1,2})-", 1),
        ).try_cast("timestamp_ntz"),
    )
    return F.coalesce(parse_timestamp(text), day_first)


def whole_days_between(later, earlier: Column) -> Column:
    """Completed 24-hour periods between two moments, as an integer."""
    micros = F.timestamp_diff("MICROSECOND", earlier, at(later))
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def hour_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:00:00")


def iso_text(ts: Column) -> Column:
    """ISO text with a fraction only when the moment has one."""
    return F.when(
        F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
