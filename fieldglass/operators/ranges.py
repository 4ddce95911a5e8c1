"""Range joins against small control tables, as equi-joins on days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_days(ranges: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per covered day: at most a calendar's worth, however wide the ranges."""
    return ranges.select(
        *[F.col(c).alias(f"__r_{c}") for c in extra or []],
        F.explode(F.sequence("start_date", "end_date")).alias("__r_day"),
    ).distinct()


def in_ranges(df: DataFrame, ranges: DataFrame, day: Column, season: Column | None = None) -> DataFrame:
    """Semi join: keep rows whose day (and season) lies in an approved inclusive range."""
    return _by_day(df, ranges, day, season, "left_semi")


def outside_ranges(df: DataFrame, ranges: DataFrame, day: Column, season: Column | None = None) -> DataFrame:
    """Anti join twin of `in_ranges`."""
    return _by_day(df, ranges, day, season, "left_anti")


def _by_day(df, ranges, day, season, how):
    on = day == F.col("__r_day")
    if season is not None:
        on = on & (season == F.col("__r_season"))
    # Distinct calendar days (per season) bound this side, so broadcasting it is safe and
    # keeps the rows from being shuffled by their few dates.
    return df.join(F.broadcast(range_days(ranges, ["season"] if season is not None else [])), on, how)
