"""Report arithmetic: rate decomposition, volume bridge, event comparison and feed checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.rates import count_where, safe_divide


def rate_decomposition(df: DataFrame, group: str, after: Column, numerator: str, denominator: str) -> DataFrame:
    """Change of a pooled rate split per group into a within part and a mix part.

    The symmetric split weights each part by the mean of both periods, so the parts add up
    to the change; the alternative split (earlier shares, later rates) is given beside it.
    A group that one period lacks has no rate there: it is not comparable and its parts are NULL.
    """
    late = F.coalesce(after, F.lit(False))
    part = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    g = df.groupBy(group).agg(
        part(numerator, ~late).alias("before_n"), part(denominator, ~late).alias("before_d"), part(numerator, late).alias("after_n"), part(denominator, late).alias("after_d")
    )
    total = g.agg(F.sum("before_d").alias("b"), F.sum("after_d").alias("a")).select(F.struct("*")).scalar()
    c = F.col
    rated = g.withColumn("__t", total).withColumns({
        "before_rate": safe_divide(c("before_n"), c("before_d")), "after_rate": safe_divide(c("after_n"), c("after_d")),
        "before_share": safe_divide(c("before_d"), c("__t.b")), "after_share": safe_divide(c("after_d"), c("__t.a")),
        "comparable": (c("before_d") > 0) & (c("after_d") > 0),
    })
    return rated.withColumns({
        "within_pp": 100 * (c("before_share") + c("after_share")) / 2 * (c("after_rate") - c("before_rate")),
        "mix_pp": 100 * (c("before_rate") + c("after_rate")) / 2 * (c("after_share") - c("before_share")),
        "fixed_share_within_pp": 100 * c("before_share") * (c("after_rate") - c("before_rate")),
        "later_rate_mix_pp": 100 * c("after_rate") * (c("after_share") - c("before_share")),
    }).drop("__t")


def decomposition_check(parts: DataFrame) -> DataFrame:
    """Total change beside both sums of parts; the differences must vanish."""
    change = 100 * (F.sum("after_n") / F.sum("after_d") - F.sum("before_n") / F.sum("before_d"))
    return parts.agg(
        change.alias("change_pp"), (F.sum("within_pp") + F.sum("mix_pp") - change).alias("symmetric_gap"),
        (F.sum("fixed_share_within_pp") + F.sum("later_rate_mix_pp") - change).alias("alternative_gap"),
    )


def volume_rate_bridge(df: DataFrame, stage: str, current: Column, late: Column) -> DataFrame:
    """Extra late rows per stage beyond what the earlier rate predicts at the current volume."""
    now = F.coalesce(current, F.lit(False))
    totals = df.agg(
        count_where(~now).alias("before_orders"), count_where(now).alias("orders"), count_where(~now & late).alias("before_late"), count_where(now & late).alias("late")
    ).select(F.struct("*")).scalar()
    staged = df.groupBy(stage).agg(count_where(~now & late).alias("before_late"), count_where(now & late).alias("current_late")).withColumn("__t", totals)
    c = F.col
    expected = safe_divide(c("before_late") * c("__t.orders"), c("__t.before_orders"))
    return staged.withColumns({
        "expected_at_current_volume": expected, "extra_late": c("current_late") - expected,
        "volume_extra": safe_divide((c("__t.orders") - c("__t.before_orders")) * c("__t.before_late"), c("__t.before_orders")), "total_change": c("__t.late") - c("__t.before_late"),
    }).drop("__t")


def event_comparison(df: DataFrame, day: str, value: str, event_day: Column, one_time: Column | None = None) -> DataFrame:
    """Level before and after an event, and whether removing a one-off returns it to the usual range."""
    on = F.col(day) == event_day
    amount = F.col(value).cast("double")
    once = one_time if one_time is not None else F.lit(0.0)
    row = df.agg(
        F.avg(F.when(F.col(day) < event_day, amount)).alias("mean_before"), F.avg(F.when(F.col(day) >= event_day, amount)).alias("mean_after"),
        count_where(F.col(day) < event_day).alias("before"), count_where(F.col(day) >= event_day).alias("after"),
        F.max(F.when(on, amount)).alias("event_value"), F.max(F.when(on, once)).alias("one_time"),
        F.max(F.when(~on, amount)).alias("other_max"), F.min(F.when(~on, amount)).alias("other_min"),
    )
    adjusted = F.col("event_value") - F.col("one_time")
    return row.withColumns({
        "level_up": (F.col("before") >= 2) & (F.col("after") >= 2) & (F.col("mean_after") > F.col("mean_before")), "adjusted_value": adjusted,
        "one_off": (F.col("one_time") > 0) & (F.col("event_value") > F.col("other_max")) & adjusted.between(F.col("other_min"), F.col("other_max")),
    })


def feed_checks(df: DataFrame, week: str, channel: str, numbers: list[str], funnel: list[str]) -> DataFrame:
    """Completeness of a week x channel feed: one row of violation counts."""
    bad = [F.col(n).isNull() | (F.col(n) < 0) | (F.col(n) != F.floor(n)) for n in numbers]
    invalid = sum((b.cast("int") for b in bad), F.lit(0))
    steps = [F.coalesce(F.col(b) > F.col(a), F.lit(False)) for a, b in zip(funnel, funnel[1:])]
    broken = F.lit(False)
    for s in steps:
        broken = broken | s
    missing = sum((F.col(c).isNull().cast("int") for c in [week, channel, *numbers]), F.lit(0))
    base = df.agg(
        F.count("*").alias("row_count"), F.count_distinct(week).alias("week_count"), F.count_distinct(channel).alias("channel_count"), F.sum(missing).alias("missing_cells"),
        (F.count("*") - F.count_distinct(F.struct(week, channel))).alias("duplicate_keys"),
        (F.count_distinct(week) * F.count_distinct(channel) - F.count_distinct(F.struct(week, channel))).alias("missing_week_channels"),
        F.sum(invalid).alias("invalid_numeric_cells"), count_where(broken).alias("funnel_violations"),
    )
    # Distinct weeks: a calendar-sized series.
    weeks = df.select(week).distinct().withColumn("__gap", F.datediff(week, F.lag(week).over(Window.orderBy(week))))
    return base.withColumn("non_weekly_gaps", weeks.agg(count_where(F.col("__gap") != 7)).scalar())


def bridge_check(drivers: DataFrame, period: str, driver: str, change: str) -> DataFrame:
    """Per period: recorded movements add up from the opening to the closing balance."""
    value = lambda name: F.sum(F.when(F.col(driver) == name, F.col(change)))
    once = F.count("*") == F.count_distinct(driver)
    summed = drivers.groupBy(period).agg(
        *[value(n).alias(n.lower()) for n in ("Before", "Activation", "Expansion", "Churn", "After")], (once & (F.count("*") == 5)).alias("complete")
    )
    c = F.col
    adds_up = c("before") + c("activation") + c("expansion") + c("churn") == c("after")
    signed = (c("activation") >= 0) & (c("expansion") >= 0) & (c("churn") <= 0)
    return summed.withColumn("bridge_valid", F.coalesce(c("complete") & adds_up & signed, F.lit(False)))


def priority_segment(df: DataFrame, period: str, segment: str, rate: str) -> DataFrame:
    """The segment with the lowest rate of each period, only where the lowest is unique."""
    lowest = df.groupBy(period).agg(F.min(rate).alias("__low"), F.min_by(segment, rate).alias("__seg"), F.count("*").alias("segments"))
    held = df.join(lowest, period).groupBy(period).agg(
        count_where(F.col(rate) == F.col("__low")).alias("__ties"), F.max("__seg").alias("__seg"), F.max("segments").alias("segments"), F.max("__low").alias("lowest_rate")
    )
    unique = (F.col("__ties") == 1) & (F.col("segments") >= 2)
    return held.select(period, "segments", "lowest_rate", F.when(unique, F.col("__seg")).alias("priority_segment"))
