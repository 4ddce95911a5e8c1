"""Matchup planner: opponent and park context, weather, stream score, scenario fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import flags as fl
from fieldglass.functions import labels, times
from fieldglass.functions.rates import count_where, half_up, positive_rate, weighted_score
from fieldglass.functions.text import normalize_team, weather_condition, weather_risk
from fieldglass.operators.joins import nearest_in_time
from fieldglass.operators.ordered import average_rank_shares, unique_rank
from fieldglass.plans.radar import PROFILES
from fieldglass.session import cut_lineage

FORECAST_TOLERANCE_SECONDS = 2 * 3600


def _contact() -> list[Column]:
    event = F.col("plate_appearance_event")
    return [
        count_where(fl.finished_pa()).alias("plate_appearances"), count_where(event.isin(fl.STRIKEOUTS)).alias("strikeouts"), count_where(event == "walk").alias("walks"),
        count_where(event == "home_run").alias("home_runs"), F.sum("batted_ball_flag").cast("bigint").alias("batted_balls"),
        count_where((F.col("batted_ball_flag") == 1) & F.col("hard_hit_flag").isNotNull()).alias("measured_batted_balls"),
        F.coalesce(F.sum("hard_hit_flag"), F.lit(0)).cast("bigint").alias("hard_hits"),
    ]


def opponent_metrics(fact: DataFrame, start: Column, end: Column) -> DataFrame:
    """Recent lineup tendencies and their favourability to the opposing pitcher."""
    c = F.col
    grouped = fact.filter(c("game_date").between(start, end)).groupBy(normalize_team(c("batter_team")).alias("opponent_team")).agg(*_contact())
    rated = grouped.withColumns({
        "opponent_strikeout_rate": positive_rate(c("strikeouts"), c("plate_appearances")), "opponent_walk_rate": positive_rate(c("walks"), c("plate_appearances")),
        "opponent_hard_hit_rate": positive_rate(c("hard_hits"), c("measured_batted_balls")),
    })
    rated = average_rank_shares(cut_lineage(rated), ["opponent_team"], {
        "strikeout_favorability_percentile": ("opponent_strikeout_rate", True), "walk_favorability_percentile": ("opponent_walk_rate", False),
        "hard_hit_favorability_percentile": ("opponent_hard_hit_rate", False),
    })
    signal = 0.50 * c("strikeout_favorability_percentile") + 0.25 * c("walk_favorability_percentile") + 0.25 * c("hard_hit_favorability_percentile")
    return rated.withColumn("opponent_matchup_signal", 100.0 * signal)


def park_metrics(fact: DataFrame, context: DataFrame, minimum_balls: int = 500, minimum_pa: int = 1000) -> DataFrame:
    """Contact suppression of venues with enough history; games aggregate before the venue join."""
    c = F.col
    counts = ["plate_appearances", "strikeouts", "walks", "home_runs", "batted_balls", "measured_batted_balls", "hard_hits"]
    games = fact.groupBy("game_pk", "game_date").agg(*_contact())
    joined = games.join(context.select("game_pk", "venue_id", "venue_name"), "game_pk")
    parks = joined.groupBy("venue_id").agg(F.max_by("venue_name", F.struct("game_date", "game_pk")).alias("venue_name"), *[F.sum(n).cast("bigint").alias(f"park_{n}") for n in counts])
    kept = parks.filter((c("park_batted_balls") >= minimum_balls) & (c("park_plate_appearances") >= minimum_pa)).withColumns({
        "park_hard_hit_rate": positive_rate(c("park_hard_hits"), c("park_measured_batted_balls")), "park_home_run_rate": positive_rate(c("park_home_runs"), c("park_plate_appearances")),
    })
    kept = average_rank_shares(cut_lineage(kept), ["venue_id"], {"__a": ("park_hard_hit_rate", False), "__b": ("park_home_run_rate", False)})
    return kept.withColumn("park_contact_suppression_signal", 100.0 * (0.60 * c("__a") + 0.40 * c("__b"))).drop("__a", "__b", "park_strikeouts", "park_walks")


def with_weather(slots: DataFrame, forecast: DataFrame, venues: DataFrame) -> DataFrame:
    """Nearest forecast hour of the venue, within two hours, and the risk it implies."""
    fields = ["temperature_2m", "precipitation_probability", "weather_code", "wind_speed_10m", "wind_direction_10m"]
    near = nearest_in_time(slots, forecast, ["venue_id"], "game_datetime_utc", "forecast_time_utc", fields, FORECAST_TOLERANCE_SECONDS, prefix="fc_")
    placed = near.join(venues.select("venue_id", "roof_type", "time_zone_id"), "venue_id", "left")
    has = F.col("fc_time").isNotNull()
    local = F.from_utc_timestamp(F.col("game_datetime_utc").cast("timestamp"), F.coalesce("time_zone_id", F.lit("UTC")))
    return placed.withColumns({
        "roof_type": F.coalesce("roof_type", F.lit("Unknown")), "weather_risk": weather_risk(F.col("roof_type"), F.col("fc_precipitation_probability"), has),
        "weather_condition": weather_condition(F.col("fc_weather_code")), "temperature_f": F.col("fc_temperature_2m"),
        "precipitation_probability": F.col("fc_precipitation_probability"), "wind_speed_mph": F.col("fc_wind_speed_10m"),
        "wind_direction_degrees": F.col("fc_wind_direction_10m"), "game_datetime_local": local, "game_time_label": times.time_label(local),
    }).drop("time_zone_id", "fc_time", *[f"fc_{f}" for f in fields])


def stream_rows(slots: DataFrame, radar: DataFrame, opponents: DataFrame, parks: DataFrame) -> DataFrame:
    """Every slot under each profile, with its score over present parts, tier and rank."""
    names = F.array(*[F.struct(F.lit(k).alias("profile_key"), F.lit(label).alias("profile")) for k, (label, _) in PROFILES.items()])
    spread = slots.withColumn("__o", F.explode(names)).select("*", "__o.*").drop("__o")
    skill = radar.select("pitcher_id", "profile_key", "fantasy_signal", F.col("rank").alias("fantasy_rank"), F.col("trend_status").alias("fantasy_trend"), F.col("sample_strength").alias("fantasy_sample_strength"))
    against = opponents.select("opponent_team", F.col("plate_appearances").alias("opponent_plate_appearances"), "opponent_strikeout_rate", "opponent_walk_rate", "opponent_hard_hit_rate", "opponent_matchup_signal")
    place = parks.select("venue_id", "park_hard_hit_rate", "park_home_run_rate", "park_contact_suppression_signal")
    joined = spread.join(skill, ["pitcher_id", "profile_key"], "left").join(against, "opponent_team", "left").join(place, "venue_id", "left")
    score, coverage = weighted_score([(F.col("fantasy_signal"), 0.65), (F.col("opponent_matchup_signal"), 0.25), (F.col("park_contact_suppression_signal"), 0.10)])
    scored = joined.withColumns({"stream_score": score, "stream_score_coverage": coverage})
    scored = scored.withColumns({"stream_tier": labels.stream_tier(F.col("stream_score"), F.col("probable_status")), "__slot": F.col("game_pk") * 2 + (F.col("home_away") == "Home").cast("int")})
    return unique_rank(cut_lineage(scored), "stream_score", "__slot", "stream_rank", ["profile_key"]).drop("__slot")


def contract(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Violations of the planner's output contract, one count per rule."""
    n = slots.agg(F.count("*")).scalar()
    key = F.struct("game_pk", "pitcher_team", "profile_key")
    out = F.col("stream_score").isNotNull()
    return rows.agg(
        F.count("*").alias("rows"), (F.count("*") - F.count_distinct(key)).alias("duplicate_keys"), (F.lit(len(PROFILES)) - F.count_distinct("profile_key")).alias("missing_profiles"),
        count_where(out & ~F.col("stream_score").between(0, 100)).alias("scores_out_of_bounds"), count_where(out & (F.col("probable_status") == "TBD")).alias("scored_tbd"),
    ).withColumn("__n", n).withColumn("row_count_difference", F.col("rows") - len(PROFILES) * F.col("__n")).drop("__n", "rows")


def personal_fit(rows: DataFrame, profile: str, points_league: bool, appetite: str, horizon: int = 7) -> DataFrame:
    """One profile's rows in the first available dates, joined to the strikeout profile of the slot."""
    upside = rows.filter(F.col("profile_key") == "strikeout_upside").select("game_pk", "pitcher_team", F.col("stream_score").alias("__k"))
    mine = rows.filter(F.col("profile_key") == profile)
    dates = mine.filter(F.col("game_date").isNotNull()).select("game_date").distinct().orderBy("game_date").limit(horizon)
    joined = mine.join(dates, "game_date", "left_semi").join(upside, ["game_pk", "pitcher_team"], "left")
    fit, penalty = labels.fit_score(F.col("stream_score"), F.col("__k"), F.col("weather_risk"), F.col("fantasy_sample_strength"), F.col("fantasy_trend"), points_league, appetite)
    return joined.withColumns({"personalized_fit_score": half_up(fit, 1), "scenario_penalty": penalty, "strategy_action": labels.strategy_action(fit)}).drop("__k")
