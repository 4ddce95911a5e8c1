"""Outcome classification of one pitch.  Unknown stays unknown: never coerced to zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabulary of the pitch feed.
IN_PLAY = ["hit_into_play", "hit_into_play_no_out", "hit_into_play_score"]
WHIFFS = ["swinging_strike", "swinging_strike_blocked", "missed_bunt"]
FOULS = ["foul", "foul_tip", "foul_bunt", "bunt_foul_tip"]
BALLS = ["ball", "blocked_ball", "pitchout", "hit_by_pitch"]
SWINGS = [
    "swinging_strike", "swinging_strike_blocked", "foul", "foul_tip", "hit_into_play",
    "hit_into_play_no_out", "hit_into_play_score", "foul_bunt", "missed_bunt", "bunt_foul_tip",
]
HITS = ["single", "double", "triple", "home_run"]
STRIKEOUTS = ["strikeout", "strikeout_double_play"]
NOT_AT_BAT = [
    "walk", "intent_walk", "hit_by_pitch", "sac_bunt", "sac_fly", "sac_fly_double_play",
    "catcher_interf", "sac_bunt_double_play",
]
HARD_HIT_SPEED = 95.0
FIRST_ABS_SEASON = 2026
COMPLETED = ["Final", "Game Over", "Completed Early"]


def as_flag(condition: Column) -> Column:
    """1 where the condition holds; 0 where it fails or is unknown."""
    return F.when(condition, 1).otherwise(0)


def is_in(column: Column | str, values: list[str]) -> Column:
    return as_flag((F.col(column) if isinstance(column, str) else column).isin(values))


def count_state(balls: Column, strikes: Column) -> Column:
    return (
        F.when((balls == 0) & (strikes == 0), "First Pitch")
        .when(strikes == 2, "Two Strikes")
        .when(strikes > balls, "Pitcher Ahead")
        .when(balls > strikes, "Hitter Ahead")
        .otherwise("Even")
    )


def in_zone(zone: Column) -> Column:
    return as_flag(zone.between(1, 9))


def chase(zone: Column, description: Column) -> Column:
    return as_flag(~zone.between(1, 9) & description.isin(SWINGS))


def hard_hit(description: Column, launch_speed: Column) -> Column:
    """NULL for an unmeasured ball in play, 0 for every pitch not put in play."""
    measured = F.when(launch_speed.isNotNull(), as_flag(launch_speed >= HARD_HIT_SPEED))
    return F.when(description.isin(IN_PLAY), measured).otherwise(0)


def result_group(description: Column) -> Column:
    return (
        F.when(description.isin(WHIFFS), "Whiff")
        .when(description == "called_strike", "Called Strike")
        .when(description.isin(FOULS), "Foul")
        .when(description.isin(IN_PLAY), "In Play")
        .when(description.isin(BALLS), "Ball")
        .otherwise("Other")
    )


def tracking_regime(season: Column) -> Column:
    return F.when(season >= FIRST_ABS_SEASON, "2026_ABS_ALIGNMENT").otherwise("PRE_2026_TRACKING")


def zone_height(plate_z: Column, top: Column, bottom: Column) -> Column:
    """Height as a share of the strike zone; NULL unless the zone has a positive extent."""
    return F.when(top > bottom, (plate_z - bottom) / (top - bottom))


def out_of_zone(flag: str = "in_zone_flag") -> Column:
    """The pitcher-path denominator: an unknown zone counts as outside."""
    return as_flag(F.col(flag) == 0)


def strictly_outside(zone: Column) -> Column:
    """The hitter-path denominator: an unknown zone is left out."""
    return zone.isNotNull() & ~zone.between(1, 9)


def finished_pa(event: str = "plate_appearance_event") -> Column:
    return F.col(event).isNotNull() & (F.col(event) != "truncated_pa")
