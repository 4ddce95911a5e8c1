"""Pitcher radar: windowed metrics, expected rates, percentiles, profiles and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import flags as fl
from fieldglass.functions import labels
from fieldglass.functions.rates import count_where, half_even, positive_rate
from fieldglass.operators.ordered import average_rank_shares, unique_rank
from fieldglass.session import cut_lineage, literal_table

# Sample minimums per window length and percentile weights per profile.
MINIMUMS = {
    7: {"pitches": 50, "batters_faced": 10, "expected_swings": 10, "expected_batted_balls": 5},
    14: {"pitches": 80, "batters_faced": 18, "expected_swings": 18, "expected_batted_balls": 8},
    30: {"pitches": 150, "batters_faced": 35, "expected_swings": 35, "expected_batted_balls": 15},
}
PROFILES = {
    "roto_balance": ("Roto balance", {"expected_whiff": 0.25, "expected_hard_hit_suppression": 0.25, "k_minus_bb": 0.25, "chase": 0.15, "walk_suppression": 0.10}),
    "strikeout_upside": ("Strikeout upside", {"expected_whiff": 0.40, "expected_hard_hit_suppression": 0.05, "k_minus_bb": 0.30, "chase": 0.20, "walk_suppression": 0.05}),
    "ratio_protection": ("Ratio protection", {"expected_whiff": 0.15, "expected_hard_hit_suppression": 0.35, "k_minus_bb": 0.20, "chase": 0.10, "walk_suppression": 0.20}),
}
PERCENTILES = [
    ("expected_whiff", "expected_whiff_rate", True), ("expected_hard_hit_suppression", "expected_hard_hit_rate", False),
    ("k_minus_bb", "k_minus_bb_rate", True), ("chase", "chase_rate", True), ("walk_suppression", "walk_rate", False),
]


def windows(last_day: Column, lengths: tuple[int, ...]) -> Column:
    """Current and previous window of every length, as an array to explode."""
    return F.array(*[
        F.struct(F.lit(n).alias("window_days"), F.lit(back).alias("back"), F.date_sub(last_day, n * (back + 1) - 1).alias("lo"), F.date_sub(last_day, n * back).alias("hi"))
        for n in lengths for back in (0, 1)
    ])


def _in_windows(df: DataFrame, last_day: Column, lengths: tuple[int, ...]) -> DataFrame:
    staged = df.withColumn("__last", last_day)
    reach = 2 * max(lengths) - 1
    recent = staged.filter(F.col("game_date").between(F.date_sub("__last", reach), F.col("__last")))
    spread = recent.withColumn("__w", F.explode(windows(F.col("__last"), lengths)))
    return spread.filter(F.col("game_date").between(F.col("__w.lo"), F.col("__w.hi"))).select("*", "__w.window_days", "__w.back").drop("__w", "__last")


def pitcher_metrics(fact: DataFrame, last_day: Column, lengths: tuple[int, ...]) -> DataFrame:
    """Per pitcher and window: one scan serves every window length and its predecessor.

    Pitches shrink to one row per pitcher, day and game before they are copied to windows.
    """
    event = F.col("plate_appearance_event")
    daily = fact.groupBy("pitcher_id", "game_date", "game_pk").agg(
        F.min("pitcher_name").alias("pitcher_name"), F.max_by("pitcher_team", F.struct("at_bat_number", "pitch_number")).alias("pitcher_team"),
        F.count("*").alias("pitches"), count_where(fl.finished_pa()).alias("batters_faced"), count_where(event.isin(fl.STRIKEOUTS)).alias("strikeouts"),
        count_where(event == "walk").alias("walks"), count_where(event.isin(fl.HITS)).alias("hits_allowed"), count_where(event == "home_run").alias("home_runs_allowed"),
        F.sum("swing_flag").alias("swings"), F.sum("whiff_flag").alias("whiffs"), F.sum("chase_flag").alias("chases"),
        F.sum(fl.out_of_zone()).alias("out_of_zone_pitches"), F.sum("batted_ball_flag").alias("batted_balls"),
        count_where((F.col("batted_ball_flag") == 1) & F.col("hard_hit_flag").isNotNull()).alias("measured_batted_balls"),
        F.coalesce(F.sum("hard_hit_flag"), F.lit(0)).alias("hard_hits"), F.sum("release_speed").alias("__vs"), F.count("release_speed").alias("__vn"),
    )
    summed = ["pitches", "batters_faced", "strikeouts", "walks", "hits_allowed", "home_runs_allowed", "swings", "whiffs", "chases", "out_of_zone_pitches", "batted_balls", "measured_batted_balls", "hard_hits"]
    newest = F.struct("game_date", "game_pk")
    return _in_windows(daily, last_day, lengths).groupBy("pitcher_id", "window_days", "back").agg(
        F.max_by("pitcher_name", newest).alias("pitcher_name"), F.max_by("pitcher_team", newest).alias("pitcher_team"), F.count_distinct("game_pk").alias("games"),
        *[F.sum(c).cast("bigint").alias(c) for c in summed], (F.sum("__vs") / F.nullif(F.sum("__vn"), F.lit(0))).alias("avg_velocity"),
        F.min("game_date").alias("first_game_date"), F.max("game_date").alias("last_game_date"),
    )


def expected_metrics(predictions: dict[str, DataFrame], last_day: Column, lengths: tuple[int, ...]) -> DataFrame:
    """Mean predicted probability per pitcher and window; either target may be absent."""
    names = {"whiff": ("expected_swings", "expected_whiff_rate"), "hard_hit": ("expected_batted_balls", "expected_hard_hit_rate")}
    parts = []
    for key, (count, rate) in names.items():
        daily = predictions[key].groupBy("pitcher_id", "game_date").agg(F.count("*").alias("n"), F.sum("predicted_probability").alias("s"))
        parts.append(_in_windows(daily, last_day, lengths).groupBy("pitcher_id", "window_days", "back").agg(
            F.sum("n").alias(count), (F.sum("s") / F.sum("n")).alias(rate)))
    return parts[0].join(parts[1], ["pitcher_id", "window_days", "back"], "full")


def qualify(metrics: DataFrame, expected: DataFrame, minimums: dict[int, dict[str, int]] = MINIMUMS) -> DataFrame:
    """Apply the sample gates, then rates and average-rank percentiles inside each window."""
    keys = ["pitcher_id", "window_days", "back"]
    rows = [(days, *[m[c] for c in ("pitches", "batters_faced", "expected_swings", "expected_batted_balls")]) for days, m in minimums.items()]
    gates = literal_table(metrics.sparkSession, rows, "window_days int, min_pitches int, min_bf int, min_swings int, min_balls int")
    c = F.col
    joined = metrics.join(expected, keys, "left").join(gates, "window_days").filter(
        (c("pitches") >= c("min_pitches")) & (c("batters_faced") >= c("min_bf")) & (c("expected_swings") >= c("min_swings")) & (c("expected_batted_balls") >= c("min_balls"))
    )
    rated = joined.withColumns({
        "strikeout_rate": positive_rate(c("strikeouts"), c("batters_faced")), "walk_rate": positive_rate(c("walks"), c("batters_faced")),
        "whiff_rate": positive_rate(c("whiffs"), c("swings")), "chase_rate": positive_rate(c("chases"), c("out_of_zone_pitches")),
        "hard_hit_rate_allowed": positive_rate(c("hard_hits"), c("measured_batted_balls")),
        "traffic_rate": positive_rate(c("hits_allowed") + c("walks"), c("batters_faced")), "pitches_per_game": positive_rate(c("pitches"), c("games")),
        "sample_strength_multiple": F.least(c("pitches") / c("min_pitches"), c("batters_faced") / c("min_bf"), c("expected_swings") / c("min_swings"), c("expected_batted_balls") / c("min_balls")),
    }).withColumn("k_minus_bb_rate", c("strikeout_rate") - c("walk_rate"))
    rated = rated.withColumns({"role_hint": labels.role_hint(c("pitches_per_game")), "sample_strength": labels.sample_strength(c("sample_strength_multiple"))})
    return rated


def percentiles(rated: DataFrame) -> DataFrame:
    columns = {f"{name}_percentile": (source, ascending) for name, source, ascending in PERCENTILES}
    return average_rank_shares(rated, ["pitcher_id", "window_days", "back"], columns, ["window_days", "back"])


def profile_scores(scored: DataFrame) -> DataFrame:
    """Each row once per profile with its weighted signal on a 0-100 scale."""
    options = F.array(*[
        F.struct(F.lit(key).alias("profile_key"), F.lit(label).alias("profile"),
                 half_even(100.0 * sum((F.col(f"{p}_percentile") * w for p, w in weights.items()), F.lit(0.0)), 1).alias("fantasy_signal"))
        for key, (label, weights) in PROFILES.items()
    ])
    return scored.withColumn("__o", F.explode(options)).select("*", "__o.*").drop("__o")


def radar(fact: DataFrame, predictions: dict[str, DataFrame], lengths: tuple[int, ...] = (7, 14, 30), minimums: dict[int, dict[str, int]] = MINIMUMS) -> DataFrame:
    """Current windows with their signal, change from the previous window, gaps, labels and rank.

    The qualified and the scored rows (one per pitcher and window) are each read by several
    branches, so they are written out once.
    """
    last = fact.agg(F.max("game_date")).scalar()
    qualified = cut_lineage(qualify(pitcher_metrics(fact, last, lengths), expected_metrics(predictions, last, lengths), minimums))
    scored = cut_lineage(profile_scores(percentiles(qualified)))
    keys = ["pitcher_id", "profile_key", "window_days"]
    previous = scored.filter(F.col("back") == 1).select(*keys, F.col("fantasy_signal").alias("previous_signal"))
    c = F.col
    current = scored.filter(c("back") == 0).drop("back").join(previous, keys, "left").withColumn("signal_change", c("fantasy_signal") - c("previous_signal"))
    current = current.withColumns({
        "expected_whiff_gap_pp": 100.0 * (c("expected_whiff_rate") - c("whiff_rate")),
        "expected_hard_hit_suppression_gap_pp": 100.0 * (c("hard_hit_rate_allowed") - c("expected_hard_hit_rate")),
    }).withColumn("underlying_skill_gap_pp", 0.5 * (c("expected_whiff_gap_pp") + c("expected_hard_hit_suppression_gap_pp")))
    current = current.withColumns({
        "trend_status": labels.trend_status(c("signal_change")), "decision_label": labels.decision_label(c("fantasy_signal"), c("signal_change")),
        "research_action": labels.research_action(c("fantasy_signal"), c("signal_change"), c("role_hint"), c("underlying_skill_gap_pp")),
    })
    dated = current.withColumn("window_end", last).withColumns({
        "window_start": F.expr("date_sub(window_end, window_days - 1)"), "previous_window_end": F.expr("date_sub(window_end, window_days)"),
        "previous_window_start": F.expr("date_sub(window_end, 2 * window_days - 1)"), "window_label": F.format_string("Last %d days", "window_days"),
    })
    return unique_rank(cut_lineage(dated), "fantasy_signal", "pitcher_id", keys=["window_days", "profile_key"])
