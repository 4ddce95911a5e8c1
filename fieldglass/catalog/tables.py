"""The driver's tables bound to the pitch schema.

Every registered query runs on whole tables: `raw_pitch` is one landed row per event (a
re-landed correction for each event worth 100 or more, so keys repeat), `context` one row
per derived game.  `BIND` states the same binding in SQL for the oracle.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.plans import silver
from fieldglass.session import literal_table, written_table

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Two approved date ranges (both inside the data, with a gap) scope the silver layer.
RANGES = [(2024, "2024-01-02", "2024-01-14"), (2024, "2024-01-16", "2024-01-30")]

_BASE = [
    "event_id", "ts", "user_id", "event_type", "value",
    "cast(get_json_object(props, '$.k') AS bigint) AS k",
    "cast(round(value * 100) AS bigint) AS c",
]

# A game is one day of two neighbouring users of the same last digit, so games grow with the data.
GAME = "cast(dayofyear(ts) * 1000000000L + floor(user_id / 20) * 10 + user_id % 10 AS bigint)"

_RAW = [
    "CASE WHEN c % 50 = 7 THEN NULL WHEN event_type = 'signup' THEN 'FF' WHEN event_type = 'view' THEN 'SL' "
    "WHEN event_type = 'click' THEN 'CH' WHEN event_type = 'purchase' THEN 'SI' ELSE 'XX' END AS pitch_type",
    "CASE WHEN event_type = 'error' THEN 'Mystery Pitch' ELSE event_type END AS pitch_name",
    "date_format(ts, 'yyyy-MM-dd') AS game_date",
    "cast(year(ts) AS bigint) AS game_year",
    GAME + " AS game_pk",
    "cast(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 600) + 1 AS bigint) AS at_bat_number",
    "event_id AS pitch_number",
    "cast(floor(hour(ts) / 3) + 1 AS bigint) AS inning",
    "CASE WHEN k % 2 = 0 THEN 'Top' ELSE 'Bot' END AS inning_topbot",
    "user_id AS pitcher",
    "concat('Player ', user_id) AS player_name",
    "1000 + k AS batter",
    "CASE WHEN k % 3 = 0 THEN 'L' ELSE 'R' END AS stand",
    "CASE WHEN user_id % 4 = 0 THEN 'L' ELSE 'R' END AS p_throws",
    "concat('T', user_id % 10) AS home_team",
    "concat('T', (user_id % 10 + 1 + dayofyear(ts) % 9) % 10) AS away_team",
    "k % 4 AS balls",
    "cast(floor(k / 4) AS bigint) % 3 AS strikes",
    "CASE c % 10 WHEN 0 THEN 'ball' WHEN 1 THEN 'blocked_ball' WHEN 2 THEN 'called_strike' "
    "WHEN 3 THEN 'swinging_strike' WHEN 4 THEN 'foul' WHEN 5 THEN 'hit_into_play' WHEN 6 THEN 'hit_into_play_no_out' "
    "WHEN 7 THEN 'swinging_strike_blocked' WHEN 8 THEN 'foul_tip' ELSE 'hit_into_play_score' END AS description",
    "CASE WHEN c % 97 = 0 THEN 'truncated_pa' "
    "WHEN c % 10 IN (5, 6, 9) THEN CASE k % 7 WHEN 0 THEN 'single' WHEN 1 THEN 'double' WHEN 2 THEN 'triple' "
    "WHEN 3 THEN 'home_run' WHEN 4 THEN 'sac_fly' ELSE 'field_out' END "
    "WHEN c % 10 IN (3, 7) AND k % 2 = 0 THEN 'strikeout' WHEN c % 10 = 2 AND k % 5 = 0 THEN 'strikeout_double_play' "
    "WHEN c % 10 IN (0, 1) AND k % 4 = 3 THEN 'walk' ELSE NULL END AS events",
    "CASE WHEN c % 11 = 0 THEN NULL ELSE k % 14 + 1 END AS zone",
    "CASE WHEN c % 37 = 0 THEN NULL ELSE 70 + (c % 300) / 10.0D END + copy AS release_speed",
    "69 + (c % 300) / 10.0D AS effective_speed",
    "1500.0D + c % 1200 AS release_spin_rate",
    "cast(c % 360 AS double) AS spin_axis",
    "(k - 50) / 20.0D AS release_pos_x",
    "54.0D AS release_pos_y",
    "5 + k / 50.0D AS release_pos_z",
    "6 + (k % 10) / 10.0D AS release_extension",
    "cast(k % 60 AS double) AS arm_angle",
    "(k - 50) / 50.0D AS pfx_x",
    "(c % 40 - 20) / 20.0D AS pfx_z",
    "(k - 50) / 25.0D AS plate_x",
    "(c % 50) / 10.0D AS plate_z",
    "CASE WHEN k = 13 THEN 1.6D ELSE 3.4D END AS sz_top",
    "1.6D AS sz_bot",
    "k % 3 AS outs_when_up",
    "CASE WHEN k % 3 = 0 THEN k ELSE NULL END AS on_1b",
    "CASE WHEN k % 5 = 0 THEN k ELSE NULL END AS on_2b",
    "CASE WHEN k % 7 = 0 THEN k ELSE NULL END AS on_3b",
    "k % 7 AS bat_score",
    "k % 5 AS fld_score",
    "k % 3 + 1 AS n_thruorder_pitcher",
    "c % 6 AS pitcher_days_since_prev_game",
    "c % 4 AS batter_days_since_prev_game",
    "20 + user_id % 20 AS age_pit",
    "20 + k % 20 AS age_bat",
    "CASE WHEN c % 10 IN (5, 6, 9) AND c % 13 <> 0 THEN 60 + k * 0.6D ELSE NULL END AS launch_speed",
    "CASE WHEN c % 10 IN (5, 6, 9) THEN cast(k - 40 AS double) ELSE NULL END AS launch_angle",
    "CASE WHEN c % 10 IN (5, 6, 9) AND c % 17 <> 0 THEN k % 6 + 1 ELSE NULL END AS launch_speed_angle",
    "CASE WHEN c % 10 IN (5, 6, 9) AND c % 7 <> 0 THEN k / 100.0D ELSE NULL END AS estimated_ba_using_speedangle",
    "CASE WHEN c % 10 IN (5, 6, 9) AND c % 9 <> 0 THEN k / 120.0D ELSE NULL END AS estimated_woba_using_speedangle",
    "CASE WHEN c % 101 = 0 THEN 'S' ELSE 'R' END AS game_type",
    "date_format(ts, 'yyyy-MM-dd') AS source_start_date",
    "date_format(ts, 'yyyy-MM-dd') AS source_end_date",
    "concat(date_format(ts, 'yyyy-MM-dd'), 'T', 10 + copy, ':00:00') AS loaded_at_utc",
]


def _duck(expression: str) -> str:
    """The oracle's spelling of a binding expression (function names and literals only)."""
    swaps = [
        ("date_format(ts, 'yyyy-MM-dd')", "strftime(ts, '%Y-%m-%d')"),
        ("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"),
    ]
    for ours, theirs in swaps:
        expression = expression.replace(ours, theirs)
    return re.sub(r"(\d+)L\b", r"\1", re.sub(r"(\d+\.\d+)D", r"\1::DOUBLE", expression))


CONTEXT_COLUMNS = [
    "game_pk",
    "to_date(game_date) AS official_date",
    "CASE WHEN game_pk % 29 = 0 THEN 'Postponed' WHEN game_pk % 31 = 0 THEN 'In Progress' "
    "WHEN game_pk % 7 = 0 THEN 'Game Over' ELSE 'Final' END AS game_status",
    "cast(game_pk % 10 AS bigint) + 100 AS venue_id",
    "concat('Park ', game_pk % 10) AS venue_name",
    "CASE WHEN game_pk % 2 = 0 THEN 'day' ELSE 'night' END AS day_night",
    "10 + game_pk % 12 + 0.5D AS local_start_hour",
    "cast(to_date(game_date) AS timestamp) + make_interval(0, 0, 0, 0, cast(12 + game_pk % 10 AS int), 0, 0) AS game_datetime_utc",
]

_CONTEXT_SQL = """
ctx AS (
  SELECT DISTINCT game_pk, CAST(game_date AS DATE) AS official_date,
    CASE WHEN game_pk % 29 = 0 THEN 'Postponed' WHEN game_pk % 31 = 0 THEN 'In Progress'
         WHEN game_pk % 7 = 0 THEN 'Game Over' ELSE 'Final' END AS game_status,
    game_pk % 10 + 100 AS venue_id, 'Park ' || (game_pk % 10) AS venue_name,
    CASE WHEN game_pk % 2 = 0 THEN 'day' ELSE 'night' END AS day_night,
    10 + game_pk % 12 + 0.5::DOUBLE AS local_start_hour,
    CAST(game_date AS TIMESTAMP) + to_hours(CAST(12 + game_pk % 10 AS INTEGER)) AS game_datetime_utc
  FROM raw_pitch
)"""

_SWING = (
    "('swinging_strike','swinging_strike_blocked','foul','foul_tip','hit_into_play','hit_into_play_no_out',"
    "'hit_into_play_score','foul_bunt','missed_bunt','bunt_foul_tip')"
)
_PLAY = "('hit_into_play','hit_into_play_no_out','hit_into_play_score')"

RAW_SQL = (
    "ev AS (SELECT " + ", ".join(_duck(x) for x in _BASE) + " FROM events),\n"
    "raw_pitch AS (SELECT " + ", ".join(_duck(x) for x in _RAW)
    + " FROM ev JOIN (VALUES (0), (1)) AS copies(copy) ON copy = 0 OR value >= 100)"
)
RAW_SQL = re.sub(r"floor\((.+?) / (\d+)\)", r"(\1 // \2)", RAW_SQL)

RANGES_SQL = "ranges(season, start_date, end_date) AS (VALUES " + ", ".join(
    f"({s}, DATE '{a}', DATE '{b}')" for s, a, b in RANGES
) + ")"

FACT_SQL = f"""
dim(pitch_type, std_name, family) AS (VALUES ('FF','4-Seam Fastball','Fastball'), ('SL','Slider','Breaking'),
  ('CH','Changeup','Offspeed'), ('SI','Sinker','Fastball')),
fact AS (
  SELECT game_pk || '-' || at_bat_number || '-' || pitch_number AS pitch_id, game_pk,
    CAST(game_date AS DATE) AS game_date, CAST(game_year AS INTEGER) AS season,
    CAST(at_bat_number AS INTEGER) AS at_bat_number, CAST(pitch_number AS INTEGER) AS pitch_number,
    inning_topbot AS inning_half, pitcher AS pitcher_id, player_name AS pitcher_name,
    CASE inning_topbot WHEN 'Top' THEN home_team ELSE away_team END AS pitcher_team, batter AS batter_id,
    CASE inning_topbot WHEN 'Top' THEN away_team ELSE home_team END AS batter_team,
    stand AS batter_stand, p_throws AS pitcher_throws, r.pitch_type,
    COALESCE(std_name, pitch_name, r.pitch_type) AS pitch_name, COALESCE(family, 'Other') AS pitch_family,
    CAST(balls AS INTEGER) AS balls, CAST(strikes AS INTEGER) AS strikes,
    CASE WHEN strikes = 2 THEN 'Two Strikes' WHEN balls + strikes = 0 THEN 'First Pitch'
         WHEN balls > strikes THEN 'Hitter Ahead' WHEN balls < strikes THEN 'Pitcher Ahead' ELSE 'Even' END AS count_state,
    description AS pitch_description, events AS plate_appearance_event,
    (description IN {_SWING})::INTEGER AS swing_flag,
    (description IN ('swinging_strike','swinging_strike_blocked','missed_bunt'))::INTEGER AS whiff_flag,
    COALESCE(zone <= 9, FALSE)::INTEGER AS in_zone_flag,
    (COALESCE(zone > 9, FALSE) AND description IN {_SWING})::INTEGER AS chase_flag,
    (description IN {_PLAY})::INTEGER AS batted_ball_flag,
    CASE WHEN description IN {_PLAY} THEN (launch_speed >= 95)::INTEGER ELSE 0 END AS hard_hit_flag,
    release_speed, release_spin_rate, pfx_x AS horizontal_movement, pfx_z AS vertical_movement, plate_x, plate_z,
    CASE WHEN sz_top > sz_bot THEN (plate_z - sz_bot) / (sz_top - sz_bot) END AS normalized_plate_z,
    CAST(zone AS INTEGER) AS zone, (on_1b IS NOT NULL)::INTEGER AS runner_on_first_flag,
    CAST(bat_score - fld_score AS INTEGER) AS batter_score_diff, launch_speed,
    estimated_woba_using_speedangle AS estimated_woba, loaded_at_utc
  FROM raw_pitch r LEFT JOIN dim USING (pitch_type)
  WHERE game_type = 'R' AND r.pitch_type IS NOT NULL AND EXISTS (SELECT 1 FROM ranges
    WHERE season = game_year AND CAST(game_date AS DATE) BETWEEN start_date AND end_date)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY game_pk, at_bat_number, pitch_number ORDER BY loaded_at_utc DESC) = 1
)"""

RAW = f"WITH {RAW_SQL}, {RANGES_SQL}"
BIND = f"WITH {RAW_SQL}, {RANGES_SQL}, {FACT_SQL}, {_CONTEXT_SQL}"

# Schemas of tables seen by this process: a stated schema spares the footer read of every later query.
_SCHEMAS: dict = {}


class Tables:
    """Lazy access to the tables of one scale-factor folder and to the pitch binding."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            path = f"{self.folder}/{name}.parquet"
            if path not in _SCHEMAS:
                _SCHEMAS[path] = self.spark.read.parquet(path).schema
            return self.spark.read.schema(_SCHEMAS[path]).parquet(path)
        raise AttributeError(name)

    @cached_property
    def ev(self) -> DataFrame:
        return self.events.selectExpr(*_BASE)

    @cached_property
    def raw_pitch(self) -> DataFrame:
        copies = F.when(F.col("value") >= 100, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return self.ev.withColumn("copy", F.explode(copies)).selectExpr(*_RAW)

    @cached_property
    def ranges(self) -> DataFrame:
        return literal_table(self.spark, RANGES, "season int, start_date date, end_date date")

    @cached_property
    def fact(self) -> DataFrame:
        return silver.fact_pitch(self.raw_pitch, self.ranges, silver.pitch_type_dim(self.spark))

    @cached_property
    def stored_fact(self) -> DataFrame:
        """The fact as a written table, for queries that read it more than once."""
        return written_table(self.fact)

    def store_fact(self, *columns: str) -> None:
        """Write only these columns of the fact, for a query that reads no others."""
        self.stored_fact = written_table(self.fact.select(*columns))

    @cached_property
    def context(self) -> DataFrame:
        return self.raw_pitch.select("game_pk", "game_date").distinct().selectExpr(*CONTEXT_COLUMNS)
