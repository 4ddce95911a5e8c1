"""Explicit schemas of the landed pitch feed, its context, and the nested source documents."""

from __future__ import annotations

RAW_PITCH = """
    pitch_type string, pitch_name string, game_date string, game_year bigint, game_pk bigint,
    at_bat_number bigint, pitch_number bigint, inning bigint, inning_topbot string,
    pitcher bigint, player_name string, batter bigint, stand string, p_throws string,
    home_team string, away_team string, balls bigint, strikes bigint, description string,
    events string, zone bigint, release_speed double, effective_speed double,
    release_spin_rate double, spin_axis double, release_pos_x double, release_pos_y double,
    release_pos_z double, release_extension double, arm_angle double, pfx_x double, pfx_z double,
    plate_x double, plate_z double, sz_top double, sz_bot double, outs_when_up bigint,
    on_1b bigint, on_2b bigint, on_3b bigint, bat_score bigint, fld_score bigint,
    n_thruorder_pitcher bigint, pitcher_days_since_prev_game bigint,
    batter_days_since_prev_game bigint, age_pit bigint, age_bat bigint, launch_speed double,
    launch_angle double, launch_speed_angle bigint, estimated_ba_using_speedangle double,
    estimated_woba_using_speedangle double, game_type string, source_start_date string,
    source_end_date string, loaded_at_utc string
"""

RAW_GAME_CONTEXT = """
    game_pk bigint, game_status string, official_date string, day_night string, venue_id bigint,
    venue_name string, game_datetime_utc timestamp, game_datetime_local string,
    local_start_hour double, local_day_of_week int, local_month int, weekend_flag int,
    temperature_f double, weather_condition string, wind_speed_mph double, wind_direction string,
    wind_out_flag int, wind_in_flag int, crosswind_flag int, indoor_flag int, source_url string,
    source_start_date string, source_end_date string, loaded_at_utc string
"""

RAW_VENUE = """
    venue_id bigint, venue_name string, city string, state string, country string,
    latitude double, longitude double, azimuth_angle double, elevation_ft double,
    time_zone_id string, roof_type string, turf_type string, source_url string,
    loaded_at_utc string
"""

PIPELINE_RANGES = "season int, start_date date, end_date date, chunk_days int, latest_complete_day boolean"

PITCH_TYPE_DIM = "pitch_type string, pitch_name_standard string, pitch_family string"

_TEAM = "struct<team:struct<id:bigint,name:string,abbreviation:string>,probablePitcher:struct<id:bigint,fullName:string>>"

SCHEDULE = f"""struct<dates:array<struct<date:string,games:array<struct<
    gamePk:bigint,gameType:string,gameDate:string,officialDate:string,dayNight:string,
    status:struct<abstractGameState:string,detailedState:string,startTimeTBD:boolean>,
    weather:struct<condition:string,temp:string,wind:string>,
    venue:struct<id:bigint,name:string>,
    teams:struct<home:{_TEAM},away:{_TEAM}>>>>>>""".replace("\n", "").replace("    ", "")

GAME_FEED = (
    "struct<gameData:struct<game:struct<pk:bigint>>,liveData:struct<plays:struct<allPlays:array<struct<"
    "about:struct<atBatIndex:bigint>,playEvents:array<struct<isPitch:boolean,type:string>>>>>>>"
)

_STAT = (
    "struct<plateAppearances:bigint,atBats:bigint,hits:bigint,runs:bigint,homeRuns:bigint,rbi:bigint,"
    "stolenBases:bigint,caughtStealing:bigint,baseOnBalls:bigint,strikeOuts:bigint,gamesPlayed:bigint>"
)

PLAYER_STATS = (
    "struct<stats:array<struct<totalSplits:bigint,splits:array<struct<"
    "player:struct<id:bigint,fullName:string>,team:struct<id:bigint>,"
    f"position:struct<abbreviation:string>,stat:{_STAT}>>>>>"
)

HOURLY_FORECAST = (
    "struct<hourly:struct<time:array<string>,temperature_2m:array<double>,"
    "precipitation_probability:array<double>,weather_code:array<int>,"
    "wind_speed_10m:array<double>,wind_direction_10m:array<double>>>"
)

ROSTER = (
    "struct<roster:array<struct<person:struct<id:bigint,fullName:string>,"
    "position:struct<abbreviation:string>>>>"
)

FORECAST_ARCHIVE = (
    "predictions array<struct<game_pk:bigint,pitcher_id:bigint,pitcher_name:string,pitcher_team:string,"
    "game_date:string,generated_at_utc:string,model_version:string,predicted_k:double,"
    "lower_k:int,upper_k:int>>"
)
