"""Dashboard filters over summary rows that may carry `all` totals, and period selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FilterDefinition:
    id: str
    field: str
    through: bool = False
    query_ids: tuple[str, ...] | None = None
    default: str = "all"


def _is_all(field: str) -> Column:
    return F.coalesce(F.lower(F.col(field).cast("string")) == "all", F.lit(False))


def filter_rows(
    df: DataFrame,
    definitions: list[FilterDefinition],
    values: dict[str, str],
    query_id: str | None = None,
    breakdown: tuple[str, ...] = (),
) -> DataFrame:
    """Apply exact dimensions, then ranges, then the preference for `all` rows, then latest endpoints.

    A dimension left at `all` keeps its total rows when they exist, or its detail rows when it
    is broken down.  A range keeps only its latest value unless the field is broken down.
    """
    used = [d for d in definitions if d.query_ids is None or query_id in d.query_ids]
    chosen = {d.id: values.get(d.id, d.default) for d in used}
    rows, latest = df, []
    for d in sorted(used, key=lambda d: ".." in str(chosen[d.id])):
        value = chosen[d.id]
        if value == "all" or d.field not in df.columns:
            continue
        shown = F.col(d.field).cast("string")
        start, end = value.split("..") if ".." in value else (None, value)
        inside = shown <= end if start in (None, "") else shown.between(start, end)
        if d.through and d.field in breakdown:
            rows = rows.filter(inside)
        elif ".." in value:
            rows = rows.filter(inside)
            latest.append(d.field)
        else:
            rows = rows.filter(shown == value)
    open_fields = [d.field for d in used if chosen[d.id] == "all" and d.field in df.columns]
    for field in [f for f in open_fields if f in breakdown]:
        has_detail = rows.agg(F.coalesce(F.bool_or(~_is_all(field)), F.lit(False))).scalar()
        rows = rows.withColumn("__detail", has_detail).filter(~_is_all(field) | ~F.col("__detail")).drop("__detail")
    for field in [f for f in open_fields if f not in breakdown]:
        has_total = rows.agg(F.coalesce(F.bool_or(_is_all(field)), F.lit(False))).scalar()
        rows = rows.withColumn("__total", has_total).filter(_is_all(field) | ~F.col("__total")).drop("__total")
    for field in latest:
        rows = rows.filter(F.col(field).cast("string") == rows.agg(F.max(F.col(field).cast("string"))).scalar())
    return rows


def section_rows(df, page_definitions, page_values, definitions, values, query_id=None, breakdown=()):
    """Page and section filters in one pass; ids are namespaced so they cannot collide."""
    combined, chosen = [], {}
    for scope, group, given in (("page", page_definitions, page_values), ("section", definitions, values)):
        for i, d in enumerate(group):
            key = f"{scope}:{i}"
            combined.append(FilterDefinition(key, d.field, d.through, d.query_ids, d.default))
            chosen[key] = given.get(d.id, d.default)
    return filter_rows(df, combined, chosen, query_id, breakdown)


def previous_period_rows(df, definitions, values, query_id, period, current):
    """The same selection at the latest period before the current one."""
    open_values = {**values, **{d.id: "all" for d in definitions if d.field == period}}
    earlier = filter_rows(df, definitions, open_values, query_id).filter(F.col(period) < F.lit(current))
    return earlier.filter(F.col(period) == earlier.agg(F.max(period)).scalar())


def latest_period_rows(df: DataFrame, period: str) -> DataFrame:
    return df.filter(F.col(period) == df.agg(F.max(period)).scalar())
