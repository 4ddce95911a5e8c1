"""Joins with time tolerance, fallbacks and set reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.operators.ordered import join_null_safe


def with_fallback(df: DataFrame, dim: DataFrame, key: str, name: str, choices: list[Column], ) -> DataFrame:
    """Left lookup in a dimension; the first present choice names the row."""
    return df.join(dim, key, "left").withColumn(name, F.coalesce(*choices))


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    carried: list[str],
    tolerance_seconds: int,
    prefix: str = "nearest_",
    slots: int = 64,
) -> DataFrame:
    """Symmetric nearest-time join: the closest right row within a tolerance, ties to the earlier.

    Time is cut into slots, `slots` of them to a tolerance, and each task orders one (key, slot), so a busy
    key is as many tasks as it has slots.  The last right row before a slot and the first one after it are
    carried over a table of one row per key and slot; no pair list is built.  Rows of one key at one
    instant stay in a task.
    """
    width = tolerance_seconds * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    slot = F.floor(F.col("__t") / max(width // slots, 1)).alias("__b")
    marks = (
        right.select(*keys, micros(right_time).alias("__t"), F.struct(F.col(right_time).alias("time"), *carried).alias("__row"))
        .filter(F.col("__t").isNotNull())
        .groupBy(*keys, "__t")
        .agg(F.min("__row").alias("__row"))
    )
    asked = left.withColumn("__t", micros(left_time)).select(*keys, "__t", F.struct(*left.columns).alias("__ask"))
    both = asked.select(*keys, "__t", slot, "__ask", F.lit(None).cast(marks.schema["__row"].dataType).alias("__row")).unionByName(
        marks.select(*keys, "__t", slot, F.lit(None).cast(asked.schema["__ask"].dataType).alias("__ask"), "__row")
    )
    mark = F.when(F.col("__row").isNotNull(), F.struct("__t", "__row"))
    ends = both.select(*keys, "__b", "__t", mark.alias("__m")).groupBy(*keys, "__b").agg(
        F.max_by("__m", F.when(F.col("__m").isNotNull(), F.col("__t"))).alias("__last"), F.min_by("__m", F.when(F.col("__m").isNotNull(), F.col("__t"))).alias("__first"))
    # One row per key and slot of time: bounded by the calendar, not by the rows.
    line = Window.partitionBy(*keys).orderBy("__b")
    ends = ends.select(
        *keys, "__b", F.last("__last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.first("__first", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    backward = Window.partitionBy(*keys, "__b").orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    forward = Window.partitionBy(*keys, "__b").orderBy(F.col("__t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__prev", F.last(mark, ignorenulls=True).over(backward)).withColumn(
        "__next", F.last(mark, ignorenulls=True).over(forward)
    ).filter(F.col("__ask").isNotNull())
    found = join_null_safe(found, ends, [*keys, "__b"])
    found = found.withColumns({"__prev": F.coalesce("__prev", "__before"), "__next": F.coalesce("__next", "__after")})
    gap = lambda side: F.abs(F.col(f"{side}.__t") - F.col("__t"))
    near = F.when(
        F.col("__prev").isNotNull() & (F.col("__next").isNull() | (gap("__prev") <= gap("__next"))), F.col("__prev")
    ).otherwise(F.col("__next"))
    chosen = found.withColumn("__near", near)
    chosen = chosen.withColumn("__near", F.when(F.abs(F.col("__near.__t") - F.col("__t")) <= width, F.col("__near")))
    return chosen.select(
        "__ask.*",
        F.col("__near.__row.time").alias(f"{prefix}time"),
        *[F.col(f"__near.__row.{c}").alias(f"{prefix}{c}") for c in carried],
    )


def null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join where a missing key part equals a missing key part."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, on, "left").drop(*[f"__r_{k}" for k in keys])


def compare_counts(official: DataFrame, local: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Full set reconciliation of two counted key sets: one classified row per differing key."""
    a = official.select(*keys, F.col(count).alias("official"))
    b = local.select(*keys, F.col(count).alias("local"))
    kind = (
        F.when(F.col("local").isNull(), "missing").when(F.col("official").isNull(), "unexpected").when(F.col("official") != F.col("local"), "count_mismatch")
    )
    return a.join(b, keys, "full").withColumn("mismatch", kind).filter(F.col("mismatch").isNotNull())


def on_other_dates(missing: DataFrame, rows: DataFrame, key: str, day: str) -> DataFrame:
    """Keys missing on the audited day that appear on others, with their sorted dates."""
    dates = rows.select(key, day).distinct().groupBy(key).agg(F.array_sort(F.collect_set(day)).alias("dates"))
    return missing.select(key).distinct().join(dates, key)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows found in exactly one of two tables, each row once, labelled by side."""
    columns = a.columns
    left = a.subtract(b.select(*columns)).withColumn("side", F.lit("left"))
    right = b.select(*columns).subtract(a).withColumn("side", F.lit("right"))
    return left.unionByName(right)


def resolve_names(asked: DataFrame, known: DataFrame, name: str, ident: str, fold) -> DataFrame:
    """Ids of folded names held by exactly one known id; every other name stays unresolved.

    Copies of an asked name collapse before the join and are matched again by the folded key.
    """
    index = known.groupBy(fold(F.col(name)).alias("__key")).agg(
        F.count("*").alias("__holders"), F.min(ident).alias(ident)
    )
    keyed = asked.withColumn("__key", fold(F.col(name)))
    return keyed.join(index.filter(F.col("__holders") == 1).drop("__holders"), "__key", "left").drop("__key")
