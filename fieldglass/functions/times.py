"""Local time, business dates and date windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUSINESS_ZONE = "America/Los_Angeles"


def business_date(instant: Column) -> Column:
    """Calendar day in the league's business zone, daylight saving included."""
    return F.to_date(F.from_utc_timestamp(instant, BUSINESS_ZONE))


def local_time_fields(instant: Column, zone: Column) -> dict[str, Column]:
    """Local start fields of a UTC instant; a missing zone keeps UTC.  Monday is day 0."""
    local = F.from_utc_timestamp(instant, F.coalesce(zone, F.lit("UTC")))
    return {
        "game_datetime_local": local,
        "local_start_hour": F.hour(local) + F.minute(local) / 60.0,
        "local_day_of_week": F.weekday(local),
        "local_month": F.month(local),
        "weekend_flag": (F.weekday(local) >= 5).cast("int"),
    }


def hour_on_circle(hour: Column) -> tuple[Column, Column]:
    angle = 2 * F.pi() * hour / 24.0
    return F.sin(angle), F.cos(angle)


def time_label(local: Column) -> Column:
    """`Sat Apr 5, 7:05 PM`"""
    return F.date_format(local, "EEE MMM d, h:mm a")


def window_bounds(last_day: Column, days: int) -> dict[str, Column]:
    """The inclusive window of `days` ending at `last_day`, and the one just before it."""
    return {
        "window_start": F.date_sub(last_day, days - 1),
        "window_end": last_day,
        "previous_window_start": F.date_sub(last_day, 2 * days - 1),
        "previous_window_end": F.date_sub(last_day, days),
    }
