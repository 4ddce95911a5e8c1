"""Dashboard views: re-aggregation of additive summary rows, never a mean of rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.rates import positive_rate



def _named(summary: DataFrame) -> DataFrame:
    known = [c for c in ("pitch_name", "pitch_type") if c in summary.columns]
    return summary.withColumn("pitch_name", F.coalesce(*known, F.lit("Unknown")))


def _sum(name: str) -> Column:
    return F.sum(name).cast("bigint")


def _measured(summary: DataFrame) -> str:
    return "measured_batted_ball_count" if "measured_batted_ball_count" in summary.columns else "batted_ball_count"


def _outside() -> Column:
    return F.sum(F.col("pitch_count") - F.col("in_zone_count")).cast("bigint")


def _velocity() -> Column:
    """Pooled speed over measured pitches only."""
    measured = F.sum(F.greatest(F.lit(0), F.col("pitch_count") - F.coalesce("missing_velocity_count", F.lit(0))))
    return F.round(positive_rate(F.sum("velocity_total"), measured), 1)


def leading_pitches(summary: DataFrame, keep: int) -> DataFrame:
    ranked = _named(summary).groupBy("pitch_name").agg(F.sum("pitch_count").alias("n"))
    return ranked.orderBy(F.col("n").desc(), "pitch_name").limit(keep).select("pitch_name")


def pitch_usage(summary: DataFrame) -> DataFrame:
    total = summary.agg(F.sum("pitch_count")).scalar()
    used = _named(summary).groupBy("pitch_name").agg(_sum("pitch_count").alias("pitch_count"))
    return used.withColumn("usage_rate", positive_rate(F.col("pitch_count"), total))


def outcome_rates(summary: DataFrame, keep: int = 8) -> DataFrame:
    kept = _named(summary).join(leading_pitches(summary, keep), "pitch_name", "left_semi")
    return kept.groupBy("pitch_name").agg(
        _sum("pitch_count").alias("pitch_count"),
        positive_rate(F.sum("whiff_count"), F.sum("swing_count")).alias("whiff_rate"),
        positive_rate(F.sum("chase_count"), _outside()).alias("chase_rate"),
        positive_rate(F.sum("hard_hit_count"), F.sum(_measured(summary))).alias("hard_hit_rate"),
    )


def count_strategy(summary: DataFrame, keep: int = 8) -> DataFrame:
    """Usage inside a count state; the denominator keeps the pitches outside the leading set."""
    totals = summary.groupBy("count_state").agg(F.sum("pitch_count").alias("__total"))
    kept = _named(summary).join(leading_pitches(summary, keep), "pitch_name", "left_semi")
    used = kept.groupBy("count_state", "pitch_name").agg(_sum("pitch_count").alias("pitch_count"))
    return used.join(totals, "count_state").withColumn("usage_rate", positive_rate(F.col("pitch_count"), F.col("__total"))).drop("__total")


def location(density: DataFrame) -> DataFrame:
    quarter = lambda c: F.floor(F.col(c) * 4 + 0.5) / 4 + 0.0
    boxed = density.filter(F.col("plate_x_bin").between(-2, 2) & F.col("plate_z_bin").between(0, 5))
    return boxed.groupBy(quarter("plate_x_bin").alias("plate_x_bin"), quarter("plate_z_bin").alias("plate_z_bin")).agg(_sum("pitch_count").alias("pitch_count"))


def season_mix(summary: DataFrame) -> DataFrame:
    season = F.coalesce(F.col("season").cast("string"), F.lit("Unknown")).alias("season")
    return _named(summary).groupBy(season, "pitch_name").agg(_sum("pitch_count").alias("pitch_count"))


def velocity_whiff(summary: DataFrame) -> DataFrame:
    pooled = _named(summary).groupBy(F.col("pitch_name").alias("name")).agg(
        F.min(F.coalesce("pitch_family", F.lit("Other"))).alias("pitch_family"),
        _sum("pitch_count").alias("pitch_count"),
        _velocity().alias("avg_velocity"),
        positive_rate(F.sum("whiff_count"), F.sum("swing_count")).alias("whiff_rate"),
    )
    return pooled.filter(F.col("avg_velocity").isNotNull() & F.col("whiff_rate").isNotNull())


def pitcher_table(summary: DataFrame, minimum: int = 0) -> DataFrame:
    pooled = summary.groupBy("pitcher_id").agg(
        F.coalesce(F.min("pitcher_name"), F.concat(F.lit("Pitcher "), F.min("pitcher_id").cast("string"))).alias("pitcher_name"),
        F.coalesce(F.min("pitcher_team"), F.lit("—")).alias("pitcher_team"),
        F.coalesce(F.min("pitcher_throws"), F.lit("—")).alias("pitcher_throws"),
        _sum("pitch_count").alias("pitch_count"),
        _velocity().alias("avg_velocity"),
        positive_rate(F.sum("in_zone_count"), F.sum("pitch_count")).alias("zone_rate"),
        positive_rate(F.sum("whiff_count"), F.sum("swing_count")).alias("whiff_rate"),
        positive_rate(F.sum("chase_count"), _outside()).alias("chase_rate"),
        positive_rate(F.sum("hard_hit_count"), F.sum(_measured(summary))).alias("hard_hit_rate"),
    )
    return pooled.filter(F.col("pitch_count") >= minimum)


def totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        _sum("pitch_count").alias("total_pitches"), _sum("in_zone_count").alias("in_zone"), _outside().alias("out_of_zone"),
        _sum("swing_count").alias("swings"), _sum("whiff_count").alias("whiffs"), _sum("chase_count").alias("chases"),
        _sum("batted_ball_count").alias("batted_balls"), _sum(_measured(summary)).alias("measured_batted_balls"),
        _sum("hard_hit_count").alias("hard_hits"), F.count_distinct("pitcher_id").alias("pitchers"),
        F.min("first_game_date").alias("first_date"), F.max("last_game_date").alias("last_date"),
    )
