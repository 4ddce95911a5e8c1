"""Typed, scoped, deduplicated facts and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions import flags as fl
from fieldglass.operators.ordered import latest_per_key
from fieldglass.operators.ranges import in_ranges
from fieldglass.schemas import PITCH_TYPE_DIM
from fieldglass.session import literal_table

# The governed pitch-type mapping.
PITCH_TYPES = [
    ("FF", "4-Seam Fastball", "Fastball"),
    ("SI", "Sinker", "Fastball"),
    ("FC", "Cutter", "Fastball"),
    ("SL", "Slider", "Breaking"),
    ("ST", "Sweeper", "Breaking"),
    ("CU", "Curveball", "Breaking"),
    ("KC", "Knuckle Curve", "Breaking"),
    ("SV", "Slurve", "Breaking"),
    ("CH", "Changeup", "Offspeed"),
    ("FS", "Split-Finger", "Offspeed"),
    ("FO", "Forkball", "Offspeed"),
    ("KN", "Knuckleball", "Other"),
    ("EP", "Eephus", "Other"),
    ("PO", "Pitchout", "Other"),
]

# Target column -> (source column, type) for values that are only typed and renamed.
_TYPED = {
    "game_pk": ("game_pk", "bigint"),
    "game_date": ("game_date", "date"),
    "season": ("game_year", "int"),
    "at_bat_number": ("at_bat_number", "int"),
    "pitch_number": ("pitch_number", "int"),
    "inning": ("inning", "int"),
    "inning_half": ("inning_topbot", "string"),
    "pitcher_id": ("pitcher", "bigint"),
    "pitcher_name": ("player_name", "string"),
    "batter_id": ("batter", "bigint"),
    "batter_stand": ("stand", "string"),
    "pitcher_throws": ("p_throws", "string"),
    "pitch_type": ("pitch_type", "string"),
    "balls": ("balls", "int"),
    "strikes": ("strikes", "int"),
    "pitch_description": ("description", "string"),
    "plate_appearance_event": ("events", "string"),
    "release_speed": ("release_speed", "double"),
    "effective_speed": ("effective_speed", "double"),
    "release_spin_rate": ("release_spin_rate", "double"),
    "spin_axis": ("spin_axis", "double"),
    "release_pos_x": ("release_pos_x", "double"),
    "release_pos_y": ("release_pos_y", "double"),
    "release_pos_z": ("release_pos_z", "double"),
    "release_extension": ("release_extension", "double"),
    "arm_angle": ("arm_angle", "double"),
    "horizontal_movement": ("pfx_x", "double"),
    "vertical_movement": ("pfx_z", "double"),
    "plate_x": ("plate_x", "double"),
    "plate_z": ("plate_z", "double"),
    "strike_zone_top": ("sz_top", "double"),
    "strike_zone_bottom": ("sz_bot", "double"),
    "zone": ("zone", "int"),
    "outs_when_up": ("outs_when_up", "int"),
    "times_through_order": ("n_thruorder_pitcher", "int"),
    "pitcher_days_rest": ("pitcher_days_since_prev_game", "double"),
    "batter_days_rest": ("batter_days_since_prev_game", "double"),
    "pitcher_age": ("age_pit", "double"),
    "batter_age": ("age_bat", "double"),
    "launch_speed": ("launch_speed", "double"),
    "launch_angle": ("launch_angle", "double"),
    "estimated_woba": ("estimated_woba_using_speedangle", "double"),
    "home_team": ("home_team", "string"),
    "away_team": ("away_team", "string"),
    "game_type": ("game_type", "string"),
    "source_start_date": ("source_start_date", "date"),
    "source_end_date": ("source_end_date", "date"),
    "loaded_at_utc": ("loaded_at_utc", "string"),
}


def pitch_type_dim(spark: SparkSession) -> DataFrame:
    return literal_table(spark, PITCH_TYPES, PITCH_TYPE_DIM)


def typed_pitches(raw: DataFrame, dim: DataFrame) -> DataFrame:
    """Cast, rename, name and classify landed pitches; absent columns become typed NULLs."""
    present = set(raw.columns)
    source = lambda c, t: (F.col(c) if c in present else F.lit(None)).cast(t)
    named = raw.join(dim, "pitch_type", "left")
    description, top = F.col("description"), F.col("inning_topbot") == "Top"
    zone, year = F.col("zone"), F.col("game_year")
    runner = lambda base: fl.as_flag(source(base, "bigint").isNotNull())
    return named.select(
        F.concat_ws("-", "game_pk", "at_bat_number", "pitch_number").alias("pitch_id"),
        *[source(c, t).alias(name) for name, (c, t) in _TYPED.items()],
        F.when(top, F.col("home_team")).otherwise(F.col("away_team")).alias("pitcher_team"),
        F.when(top, F.col("away_team")).otherwise(F.col("home_team")).alias("batter_team"),
        F.coalesce("pitch_name_standard", source("pitch_name", "string"), "pitch_type").alias("pitch_name"),
        F.coalesce("pitch_family", F.lit("Other")).alias("pitch_family"),
        fl.count_state(F.col("balls"), F.col("strikes")).alias("count_state"),
        fl.as_flag(description.isin(fl.SWINGS)).alias("swing_flag"),
        fl.as_flag(description.isin(fl.WHIFFS)).alias("whiff_flag"),
        fl.in_zone(zone).alias("in_zone_flag"),
        fl.chase(zone, description).alias("chase_flag"),
        fl.as_flag(description.isin(fl.IN_PLAY)).alias("batted_ball_flag"),
        fl.hard_hit(description, source("launch_speed", "double")).alias("hard_hit_flag"),
        fl.result_group(description).alias("result_group"),
        fl.zone_height(source("plate_z", "double"), source("sz_top", "double"), source("sz_bot", "double")).alias("normalized_plate_z"),
        runner("on_1b").alias("runner_on_first_flag"),
        runner("on_2b").alias("runner_on_second_flag"),
        runner("on_3b").alias("runner_on_third_flag"),
        (source("bat_score", "bigint") - source("fld_score", "bigint")).cast("int").alias("batter_score_diff"),
        fl.tracking_regime(year).alias("tracking_regime"),
    )


def scoped_pitches(raw: DataFrame, ranges: DataFrame) -> DataFrame:
    """Regular-season pitches with a full key and a pitch type, inside an approved range."""
    keyed = raw.filter(
        (F.col("game_type") == "R")
        & F.col("pitch_type").isNotNull()
        & F.col("game_pk").isNotNull()
        & F.col("at_bat_number").isNotNull()
        & F.col("pitch_number").isNotNull()
    )
    return in_ranges(keyed, ranges, F.to_date("game_date"), F.col("game_year").cast("int"))


def staged_pitches(raw: DataFrame, ranges: DataFrame) -> DataFrame:
    """One landed row per pitch key: the latest load wins."""
    return latest_per_key(
        scoped_pitches(raw, ranges), ["game_pk", "at_bat_number", "pitch_number"], [F.col("loaded_at_utc")]
    )


def fact_pitch(raw: DataFrame, ranges: DataFrame, dim: DataFrame) -> DataFrame:
    return typed_pitches(staged_pitches(raw, ranges), dim)


def dim_venue(raw_venue: DataFrame) -> DataFrame:
    """Latest row per venue; unrelated columns of the landing file are dropped."""
    from fieldglass.schemas import RAW_VENUE

    columns = [part.strip().split(" ") for part in RAW_VENUE.replace("\n", " ").split(",")]
    typed = raw_venue.select(*[F.col(n).cast(t).alias(n) for n, t in columns])
    return latest_per_key(typed, ["venue_id"], [F.col("loaded_at_utc")])


def fact_game_context(raw_context: DataFrame, venues: DataFrame) -> DataFrame:
    """Latest context row per game with venue attributes and the start hour on a circle."""
    typed = raw_context.withColumns({
        "game_pk": F.col("game_pk").cast("bigint"),
        "official_date": F.col("official_date").cast("date"),
        "game_datetime_utc": F.col("game_datetime_utc").cast("timestamp"),
        "local_start_hour": F.col("local_start_hour").cast("double"),
        "venue_id": F.col("venue_id").cast("bigint"),
    })
    latest = latest_per_key(typed, ["game_pk"], [F.col("loaded_at_utc")])
    angle = 2 * F.pi() * F.col("local_start_hour") / 24.0
    place = venues.select("venue_id", "time_zone_id", "latitude", "longitude", "elevation_ft", "roof_type", "turf_type")
    return latest.withColumns(
        {"local_start_hour_sin": F.sin(angle), "local_start_hour_cos": F.cos(angle)}
    ).join(place, "venue_id", "left")
