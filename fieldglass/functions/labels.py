"""Decision labels: ordered rules over scores, changes and sample sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldglass.functions.rates import clip
from fieldglass.functions.text import lookup


def decision_label(score: Column, change: Column) -> Column:
    rising = F.coalesce(change >= 5, F.lit(False))
    return (
        F.when((score >= 80) & rising, "High-skill, rising")
        .when(score >= 80, "High-skill")
        .when((score >= 65) & rising, "Trending stream")
        .when(score >= 65, "Streaming watch")
        .otherwise("Monitor")
    )


def trend_status(change: Column) -> Column:
    return (
        F.when(change.isNull(), "Newly qualified").when(change >= 5, "Rising").when(change <= -5, "Cooling").otherwise("Stable")
    )


def research_action(score: Column, change: Column, role: Column, gap_pp: Column) -> Column:
    rising = F.coalesce(change >= 5, F.lit(False))
    return (
        F.when((score >= 80) & rising, "Check availability")
        .when(score >= 80, "Roster fit review")
        .when((role == "Starter workload") & (score >= 65), "Streaming review")
        .when((score >= 60) & (gap_pp >= 3), "Buy-low review")
        .otherwise("Monitor")
    )


def role_hint(pitches_per_game: Column) -> Column:
    return (
        F.when(pitches_per_game >= 50, "Starter workload")
        .when(pitches_per_game >= 30, "Multi-inning workload")
        .otherwise("Relief workload")
    )


def sample_strength(multiple: Column) -> Column:
    return F.when(multiple >= 2.0, "Established sample").when(multiple >= 1.35, "Solid sample").otherwise("Qualified sample")


def stream_tier(score: Column, probable: Column) -> Column:
    return (
        F.when(F.coalesce(probable != "Confirmed probable", F.lit(True)), "Awaiting probable starter")
        .when(score.isNull(), "Insufficient recent sample")
        .when(score >= 80, "Priority stream research")
        .when(score >= 70, "Strong matchup research")
        .when(score >= 60, "League-context dependent")
        .otherwise("Low-priority matchup")
    )


# Points taken off a scenario score, by appetite for risk.
WEATHER_PENALTY = {
    "Low risk": {"Elevated rain risk": 8, "Roof decision": 4, "Weather watch": 3},
    "Balanced risk": {"Elevated rain risk": 4, "Roof decision": 2, "Weather watch": 1},
}
SAMPLE_PENALTY = {
    "Low risk": {"Qualified sample": 4, "Solid sample": 2},
    "Balanced risk": {"Qualified sample": 2, "Solid sample": 1},
}
COOLING_PENALTY = {"Low risk": 3, "Balanced risk": 1}


def fit_score(
    score: Column, strikeout_score: Column, weather: Column, sample: Column, trend: Column,
    points_league: bool, appetite: str,
) -> tuple[Column, Column]:
    """Scenario fit and the penalty inside it; an unscored row stays unscored, penalty 0."""
    basis = F.when(strikeout_score.isNotNull(), 0.6 * score + 0.4 * strikeout_score).otherwise(score) if points_league else score
    of = lambda table, key: (
        F.coalesce(lookup(table[appetite], key), F.lit(0)) if appetite in table else F.lit(0)
    )
    cooling = F.when(trend == "Cooling", COOLING_PENALTY.get(appetite, 0)).otherwise(0)
    penalty = of(WEATHER_PENALTY, weather) + of(SAMPLE_PENALTY, sample) + cooling
    return F.when(score.isNotNull(), clip(basis - penalty, 0, 100)), F.when(score.isNotNull(), penalty).otherwise(0)


def strategy_action(fit: Column) -> Column:
    return (
        F.when(fit.isNull(), "Wait for evidence").when(fit >= 80, "Priority shortlist").when(fit >= 70, "Shortlist").otherwise("Below threshold")
    )
