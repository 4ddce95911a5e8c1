"""Incremental builds: high-water marks, keyed upserts, late days, ledgers, date planning."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.ordered import latest_per_key

EPOCH = "1900-01-01"


def since_high_water(source: DataFrame, target: DataFrame | None, day: str) -> DataFrame:
    """Rows from the target's last day onward; that day is read again for late rows."""
    if target is None:
        return source
    mark = target.agg(F.coalesce(F.max(day), F.lit(EPOCH).cast("date"))).scalar()
    return source.filter(F.col(day) >= mark)


def upsert(target: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace rows with the same key; columns either side lacks become NULL.

    Running it twice with the same batch changes nothing.
    """
    kept = target.join(fresh.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def late_days(ledger: DataFrame, end: Column, refresh: int, day: str = "partition_date") -> DataFrame:
    """Partitions whose last day falls in the refresh window and must be read again."""
    return ledger.filter(F.col(day) >= F.date_sub(end, refresh - 1))


def weekly_compaction(ledger: DataFrame, day: str = "partition_date") -> DataFrame:
    """Daily partitions grouped by Monday week; a week with all seven days is ready to merge."""
    week = F.trunc(day, "week")
    return ledger.groupBy(week.alias("week_start")).agg(
        F.count_distinct(day).alias("days"), F.sum("row_count").alias("row_count")
    ).withColumns({"week_end": F.date_add("week_start", 6), "complete": F.col("days") == 7})


def chunk_plan(ranges: DataFrame) -> DataFrame:
    """Partitions to land: fixed chunks, or whole Monday weeks with loose days kept daily.

    `ranges(season, start_date, end_date, chunk_days, latest_complete_day)`.
    """
    c = F.col
    weekly = c("latest_complete_day") & (c("chunk_days") == 7)
    fixed = ranges.filter(~weekly).withColumn("chunk_start", F.explode(F.expr("sequence(start_date, end_date, make_dt_interval(chunk_days))"))).select(
        "season", "chunk_start", F.least(F.expr("date_add(chunk_start, chunk_days - 1)"), c("end_date")).alias("chunk_end"))
    days = ranges.filter(weekly).withColumn("d", F.explode(F.sequence("start_date", "end_date"))).withColumn("monday", F.trunc("d", "week"))
    whole = (c("monday") >= c("start_date")) & (F.date_add("monday", 6) <= c("end_date"))
    loose = days.select("season", F.when(whole, c("monday")).otherwise(c("d")).alias("chunk_start"), F.when(whole, F.date_add("monday", 6)).otherwise(c("d")).alias("chunk_end")).distinct()
    return fixed.unionByName(loose)


def clip_ranges(ranges: DataFrame, today: Column) -> DataFrame:
    """End ranges that follow the calendar at the last complete day; drop those not begun."""
    end = F.when(F.col("latest_complete_day"), F.least(F.col("end_date"), F.date_sub(today, 1))).otherwise(F.col("end_date"))
    return ranges.withColumn("end_date", end).filter(F.col("end_date") >= F.col("start_date"))


def missing_partitions(expected: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Planned partitions neither landed nor proven empty."""
    return expected.join(ledger.select(*keys), keys, "left_anti")


def status_rank(abstract: Column, detailed: Column) -> Column:
    a, d = F.lower(F.coalesce(abstract, F.lit(""))), F.lower(F.coalesce(detailed, F.lit("")))
    return F.when((a == "final") | (d == "final"), 3).when(a == "live", 2).when(d.contains("postpon") | d.contains("cancel"), 0).otherwise(1)


def resolve_duplicates(games: DataFrame, key: str, abstract: str, detailed: str, arrival: str) -> DataFrame:
    """One row per game: the most settled status, the first arrival on a tie."""
    return latest_per_key(games, [key], [status_rank(F.col(abstract), F.col(detailed)), -F.col(arrival)])


def earliest_forecast(archive: DataFrame, keys: list[str], made_at: str, source: str) -> DataFrame:
    """The first forecast ever archived for each key stands."""
    return archive.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in archive.columns if c not in keys]), F.struct(made_at, source)).alias("__r")).select(*keys, "__r.*")


def ledger_upsert(ledger: DataFrame, fresh: DataFrame, keys: list[str], digest: str, order: list[Column]) -> DataFrame:
    """Latest entry per partition, with a mark where the content hash changed."""
    newest = latest_per_key(fresh, keys, order)
    before = ledger.select(*keys, F.col(digest).alias("__old"))
    marked = newest.join(before, keys, "left").withColumn(
        "change", F.when(F.col("__old").isNull(), "new").when(F.col("__old") == F.col(digest), "same").otherwise("changed")
    ).drop("__old")
    return upsert(ledger.withColumn("change", F.lit("kept")), marked, keys)


def idempotent_requests(existing: DataFrame, asked: DataFrame, key: str, ident: str, order: list[Column]) -> DataFrame:
    """Existing requests plus the first request of every new key."""
    first = latest_per_key(asked, [key], order)
    return existing.unionByName(first.join(existing.select(key), key, "left_anti").select(*existing.columns))


# ---- driver-side date planning -----------------------------------------------------------

def date_chunks(start: dt.date, end: dt.date, days: int) -> Iterator[tuple[dt.date, dt.date]]:
    if days < 1:
        raise ValueError("chunk length must be at least 1")
    if start > end:
        raise ValueError("start must not be after end")
    for offset in range(0, (end - start).days + 1, days):
        first = start + dt.timedelta(days=offset)
        yield first, min(first + dt.timedelta(days=days - 1), end)
