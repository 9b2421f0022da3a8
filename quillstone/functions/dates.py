"""Column builders for time. Now is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1_000_000


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000


def age_days(as_of: Column, posted: Column) -> Column:
    """Whole days, rounded down, at least 0; null when unknown. Not a difference of calendar days."""
    return F.greatest(F.floor(days_between(as_of, posted)), F.lit(0)).cast("long")


def parsed(c: Column) -> Column:
    """A time from ISO text, slashed dates, or epoch seconds or milliseconds."""
    number = c.try_cast("double")
    return F.coalesce(
        F.when(number > 1e12, F.timestamp_millis(number.cast("long"))).when(number > 1e8, F.timestamp_seconds(number)),
        F.try_to_timestamp(F.regexp_replace(c, "Z$", "")),
        F.try_to_timestamp(c, F.lit("MM/dd/yyyy")),
        F.try_to_timestamp(c, F.lit("yyyyMMdd")),
    ).cast("timestamp_ntz")


def age_label(days: Column) -> Column:
    return (
        F.when(days.isNull(), "?")
        .when(days <= 0, "Today")
        .when(days < 7, F.concat(days.cast("string"), F.lit("d")))
        .when(days < 30, F.concat(F.floor(days / 7).cast("string"), F.lit("w")))
        .otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit("mo")))
    )


def week_label(c: Column) -> Column:
    """Year and week of the year, weeks starting on Monday, days before the first Monday in week 00."""
    first = F.trunc(c, "year")
    monday = F.next_day(F.date_sub(first, 1), "MON")
    week = F.when(c.cast("date") < monday, F.lit(0)).otherwise(F.floor(F.datediff(c.cast("date"), monday) / 7) + 1)
    return F.concat(F.year(c).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
