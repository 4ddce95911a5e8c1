"""Summary marts, analysis queries and the pitch feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions import flags as fl
from fieldglass.functions.rates import count_where, safe_divide

PITCHER = ["pitcher_id", "pitcher_name", "pitcher_team"]
PITCH_TYPE_KEYS = [*PITCHER, "pitcher_throws", "batter_stand", "pitch_type", "pitch_name", "pitch_family"]
COUNT_KEYS = [*PITCHER, "batter_stand", "count_state", "pitch_type", "pitch_name"]


def _total(name: str) -> Column:
    return F.sum(name).cast("bigint")


def measured_balls() -> Column:
    return count_where((F.col("batted_ball_flag") == 1) & F.col("hard_hit_flag").isNotNull())


def base_counts() -> list[Column]:
    return [
        F.count("*").alias("pitch_count"),
        _total("swing_flag").alias("swing_count"),
        _total("whiff_flag").alias("whiff_count"),
        F.sum(fl.out_of_zone()).cast("bigint").alias("out_of_zone_pitch_count"),
        _total("chase_flag").alias("chase_count"),
    ]


def contact_counts() -> list[Column]:
    return [
        _total("batted_ball_flag").alias("batted_ball_count"),
        measured_balls().alias("measured_batted_ball_count"),
        _total("hard_hit_flag").alias("hard_hit_count"),
    ]


def _zone_total() -> Column:
    return _total("in_zone_flag").alias("__zone")


def _rates(df: DataFrame, names: list[str]) -> DataFrame:
    available = {
        "zone_rate": safe_divide(F.col("__zone"), F.col("pitch_count")),
        "swing_rate": safe_divide(F.col("swing_count"), F.col("pitch_count")),
        "whiff_rate": safe_divide(F.col("whiff_count"), F.col("swing_count")),
        "chase_rate": safe_divide(F.col("chase_count"), F.col("out_of_zone_pitch_count")),
    }
    if "hard_hit_rate" in names:
        available["hard_hit_rate"] = safe_divide(F.col("hard_hit_count"), F.col("measured_batted_ball_count"))
    return df.withColumns({n: available[n] for n in names}).drop("__zone")


def pitch_type_summary(fact: DataFrame) -> DataFrame:
    """Pitcher x pitch type x batter side: counts, averages and safe rates."""
    in_play = F.col("batted_ball_flag") == 1
    grouped = fact.groupBy(*PITCH_TYPE_KEYS).agg(
        *base_counts(),
        *contact_counts(),
        _zone_total(),
        F.avg("release_speed").alias("avg_velocity"),
        F.avg("release_spin_rate").alias("avg_spin_rate"),
        F.avg("horizontal_movement").alias("avg_horizontal_movement"),
        F.avg("vertical_movement").alias("avg_vertical_movement"),
        F.avg(F.when(in_play, F.col("launch_speed"))).alias("avg_exit_velocity"),
        F.avg(F.when(in_play, F.col("estimated_woba"))).alias("avg_estimated_woba"),
    )
    return _rates(grouped, ["zone_rate", "swing_rate", "whiff_rate", "chase_rate", "hard_hit_rate"])


def count_strategy_summary(fact: DataFrame) -> DataFrame:
    """Pitch usage inside (pitcher, batter side, count state), from aggregated rows."""
    grouped = fact.groupBy(*COUNT_KEYS).agg(*base_counts(), _zone_total(), F.avg("release_speed").alias("avg_velocity"))
    state = Window.partitionBy("pitcher_id", "batter_stand", "count_state")
    shared = grouped.withColumn(
        "usage_rate_within_count", safe_divide(F.col("pitch_count"), F.sum("pitch_count").over(state))
    )
    return _rates(shared, ["zone_rate", "whiff_rate", "chase_rate"])


def month_summary(fact: DataFrame) -> DataFrame:
    grouped = fact.groupBy(F.trunc("game_date", "month").alias("month"), *PITCHER).agg(
        *base_counts(), *contact_counts(), _zone_total(), F.avg("release_speed").alias("avg_velocity")
    )
    return _rates(grouped, ["zone_rate", "whiff_rate", "chase_rate", "hard_hit_rate"])


DETAIL_COLUMNS = [
    "pitch_id", "game_date", "game_pk", "pitcher_id", "pitcher_name", "pitcher_team", "pitcher_throws",
    "batter_stand", "pitch_type", "pitch_name", "pitch_family", "balls", "strikes", "count_state",
    "result_group", "release_speed", "release_spin_rate", "horizontal_movement", "vertical_movement",
    "plate_x", "plate_z", "zone", "in_zone_flag", "swing_flag", "whiff_flag", "chase_flag",
    "batted_ball_flag", "launch_speed", "launch_angle", "hard_hit_flag", "estimated_woba",
]


def pitch_detail(fact: DataFrame) -> DataFrame:
    return fact.select(*DETAIL_COLUMNS)


def league_pitch_mix(fact: DataFrame, minimum: int = 10) -> DataFrame:
    """Share of the grand total (before the minimum-sample filter) with basic rates."""
    grouped = fact.groupBy("pitch_name").agg(*base_counts(), F.avg("release_speed").alias("avg_velocity"))
    total = fact.agg(F.count("*")).scalar()
    rated = _rates(grouped.withColumn("usage_rate", safe_divide(F.col("pitch_count"), total)), ["whiff_rate", "chase_rate"])
    return rated.filter(F.col("pitch_count") >= minimum).select(
        "pitch_name", "pitch_count", "usage_rate", "avg_velocity", "whiff_rate", "chase_rate"
    )


def pitcher_count_mix(count_mart: DataFrame, pitcher_name: str, minimum: int = 5) -> DataFrame:
    return count_mart.filter((F.col("pitcher_name") == pitcher_name) & (F.col("pitch_count") >= minimum)).select(
        "pitcher_name", "count_state", "pitch_name", "pitch_count", "usage_rate_within_count", "whiff_rate", "chase_rate"
    )


def top_pitches_per_pitcher(type_mart: DataFrame, minimum: int = 20, keep: int = 3) -> DataFrame:
    """Re-aggregate the mart across sides, then dense-rank usage inside each pitcher."""
    qualified = (
        type_mart.groupBy("pitcher_name", "pitcher_team", "pitch_name")
        .agg(
            F.sum("pitch_count").alias("pitch_count"),
            safe_divide(F.sum("whiff_count"), F.sum("swing_count")).alias("whiff_rate"),
        )
        .filter(F.col("pitch_count") >= minimum)
    )
    usage = Window.partitionBy("pitcher_name").orderBy(F.col("pitch_count").desc())
    return qualified.withColumn("usage_rank", F.dense_rank().over(usage)).filter(F.col("usage_rank") <= keep)


SUMMARY_KEYS = [
    "season", "pitcher_id", "pitcher_name", "pitcher_team", "pitcher_throws", "batter_stand",
    "pitch_name", "pitch_family", "count_state",
]


def pitch_summary(fact: DataFrame) -> DataFrame:
    """Additive dashboard grain: every later view is a re-aggregation of these rows."""
    named = fact.withColumn("pitch_name", F.coalesce("pitch_name", "pitch_type", F.lit("Unknown")))
    return named.groupBy(*SUMMARY_KEYS).agg(
        F.count("*").alias("pitch_count"),
        _total("in_zone_flag").alias("in_zone_count"),
        _total("swing_flag").alias("swing_count"),
        _total("whiff_flag").alias("whiff_count"),
        _total("chase_flag").alias("chase_count"),
        *contact_counts(),
        F.round(F.sum("release_speed"), 2).alias("velocity_total"),
        count_where(F.col("release_speed").isNull()).alias("missing_velocity_count"),
        F.date_format(F.min("game_date"), "yyyy-MM-dd").alias("first_game_date"),
        F.date_format(F.max("game_date"), "yyyy-MM-dd").alias("last_game_date"),
    )


def location_density(fact: DataFrame) -> DataFrame:
    """Quarter-foot bins inside the plotted box."""
    boxed = fact.filter(F.col("plate_x").between(-2, 2) & F.col("plate_z").between(0, 5))
    return boxed.groupBy(
        "season", "batter_stand", "pitch_family", "count_state",
        (F.round(F.col("plate_x") * 4) / 4 + 0.0).alias("plate_x_bin"),
        (F.round(F.col("plate_z") * 4) / 4 + 0.0).alias("plate_z_bin"),
    ).agg(F.count("*").alias("pitch_count"))


# Columns that state or reveal the result of the pitch being modelled.
OUTCOME_COLUMNS = [
    "pitcher_name", "pitch_name", "pitch_description", "plate_appearance_event", "chase_flag", "result_group",
    "zone", "launch_speed", "launch_angle", "estimated_woba", "home_team", "away_team", "game_type",
    "source_start_date", "source_end_date", "loaded_at_utc",
]
CONTEXT_FEATURES = [
    "game_datetime_utc", "game_datetime_local", "local_start_hour", "local_start_hour_sin",
    "local_start_hour_cos", "local_day_of_week", "local_month", "weekend_flag", "day_night", "venue_id",
    "venue_name", "time_zone_id", "latitude", "longitude", "elevation_ft", "roof_type", "turf_type",
    "temperature_f", "weather_condition", "wind_speed_mph", "wind_direction", "wind_out_flag",
    "wind_in_flag", "crosswind_flag", "indoor_flag",
]


def pitch_model_features(fact: DataFrame, context: DataFrame) -> DataFrame:
    """Post-release features with in-game sequence and previous-pitch columns.

    Both windows sit inside one game, so no task holds more than a game's pitches.
    """
    carried = [c for c in CONTEXT_FEATURES if c in context.columns]
    renamed = {"latitude": "venue_latitude", "longitude": "venue_longitude"}
    side = context.select("game_pk", *[F.col(c).alias(renamed.get(c, c)) for c in carried])
    base = fact.drop(*OUTCOME_COLUMNS).join(side, "game_pk", "left")
    appearance = Window.partitionBy("game_pk", "at_bat_number").orderBy("pitch_number")
    outing = Window.partitionBy("game_pk", "pitcher_id").orderBy("at_bat_number", "pitch_number")
    earlier = ["pitch_number", "pitch_type", "pitch_family", "release_speed", "plate_x", "plate_z"]
    sequenced = base.withColumn("pitcher_pitch_number_in_game", F.row_number().over(outing)).withColumns(
        {f"previous_{c}": F.lag(c).over(appearance) for c in earlier}
    )
    return sequenced.withColumns(
        {f"{c}_change": F.col(c) - F.col(f"previous_{c}") for c in ("release_speed", "plate_x", "plate_z")}
    )


def benchmark_scan(fact: DataFrame) -> DataFrame:
    """Scan and grouped aggregate; the decimal average does not depend on row order."""
    return fact.groupBy("pitcher_id", "pitch_type").agg(
        F.count("*").alias("pitch_count"),
        _total("swing_flag").alias("swing_count"),
        _total("whiff_flag").alias("whiff_count"),
        F.round(F.avg(F.col("release_speed").cast("decimal(10,3)")).cast("double"), 3).alias("avg_release_speed"),
    )


def benchmark_recent(fact: DataFrame, days: int = 30) -> DataFrame:
    """The scan query over the last `days` days of the data itself."""
    latest = fact.agg(F.max("game_date")).scalar()
    return benchmark_scan(fact.filter(F.col("game_date") >= F.date_sub(latest, days - 1)))


def benchmark_context_join(fact: DataFrame, context: DataFrame) -> DataFrame:
    """Star join; the fact is reduced to (game, pitch type) before it meets the games."""
    per_game = fact.groupBy("game_pk", "pitch_type").agg(
        F.count("*").alias("n"), F.sum("swing_flag").alias("s"), F.sum("whiff_flag").alias("w")
    )
    joined = per_game.join(context.select("game_pk", "venue_id", "day_night"), "game_pk")
    return joined.groupBy("venue_id", "day_night", "pitch_type").agg(
        _total("n").alias("pitch_count"), _total("s").alias("swing_count"), _total("w").alias("whiff_count")
    )


def benchmark_window(fact: DataFrame, dates: int = 10) -> DataFrame:
    """Daily totals first, so each key's window holds one row per date."""
    from fieldglass.operators.ordered import trailing_sums

    daily = fact.groupBy("pitcher_id", "game_date").agg(
        F.count("*").alias("pitch_count"), _total("whiff_flag").alias("whiff_count")
    )
    names = {f"rolling_{dates}_date_pitch_count": "pitch_count", f"rolling_{dates}_date_whiff_count": "whiff_count"}
    return trailing_sums(daily, ["pitcher_id"], "game_date", names, dates)
