"""Hitter evidence: contact quality, usage, shrunken pace, eligibility, plans and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import flags as fl
from fieldglass.functions.rates import count_where, positive_rate, safe_divide, smooth
from fieldglass.functions.text import normalize_team
from fieldglass.operators.ordered import latest_per_key
from fieldglass.operators.shape import finite

# Counting statistics, rate keys and category weights.
COUNTS = ["pa", "ab", "h", "r", "hr", "rbi", "sb", "cs", "bb", "k", "games"]
RATE_KEYS = ["r", "hr", "rbi", "sb", "h", "ab"]
PRIORITIES = {
    "balanced": {"r": 1, "hr": 1, "rbi": 1, "sb": 1, "avg": 1},
    "power": {"r": 1, "hr": 3, "rbi": 2, "sb": 0, "avg": 1},
    "speed": {"r": 1, "hr": 0, "rbi": 0, "sb": 3, "avg": 1},
    "average": {"r": 1, "hr": 0, "rbi": 0, "sb": 0, "avg": 3},
    "runs": {"r": 3, "hr": 1, "rbi": 0, "sb": 1, "avg": 1},
}
LEAGUE_PRIOR, PLAYER_PRIOR = 200.0, 100.0
BARREL_CLASS = 6


def denominator(key: str) -> str:
    return "ab" if key == "h" else "pa"


def hitter_pitches(raw: DataFrame, start: Column, end: Column) -> DataFrame:
    """Latest landed pitch rows of regular games in a window, untyped pitches included."""
    day = F.to_date("game_date")
    keyed = raw.filter(
        (F.col("game_type") == "R") & day.between(start, end) & F.col("game_pk").isNotNull() & F.col("batter").isNotNull() & F.col("at_bat_number").isNotNull()
    )
    top = F.col("inning_topbot") == "Top"
    slim = keyed.select(
        "game_pk", day.alias("game_date"), "at_bat_number", "pitch_number", F.col("batter").alias("batter_id"), F.col("pitcher").alias("pitcher_id"),
        "p_throws", "stand", "events", "description", normalize_team(F.when(top, F.col("away_team")).otherwise(F.col("home_team"))).alias("batter_team"),
        "home_team", "away_team", "zone", "launch_speed", "launch_speed_angle", F.col("estimated_ba_using_speedangle").alias("xba"),
        F.col("estimated_woba_using_speedangle").alias("xwoba"), "loaded_at_utc",
    )
    return latest_per_key(slim, ["game_pk", "at_bat_number", "pitch_number"], [F.col("loaded_at_utc")]).drop("loaded_at_utc")


def terminal_rows(pitches: DataFrame) -> DataFrame:
    """The last completed-event row of each plate appearance."""
    return latest_per_key(pitches.filter(fl.finished_pa("events")), ["game_pk", "at_bat_number"], [F.col("pitch_number")])


def contact_metrics(pitches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Contact and discipline per batter; each measure keeps its own measured denominator.

    Plate-appearance measures need only the terminal rows and pitch measures only the
    pitches, so the two aggregate apart and meet on the batter.
    """
    keys = keys or ["batter_id"]
    play = F.col("description").isin(fl.IN_PLAY)
    measured, classified = play & F.col("launch_speed").isNotNull(), play & F.col("launch_speed_angle").isNotNull()
    at_bat = ~F.col("events").isin(fl.NOT_AT_BAT)
    covered = at_bat & (F.col("xba").isNotNull() | F.col("events").isin(fl.STRIKEOUTS))
    hands = []
    for hand in ("L", "R"):
        faced = play & (F.col("p_throws") == hand) & F.col("xwoba").isNotNull()
        hands += [count_where(faced).alias(f"con_{hand}_n"), safe_divide(F.sum(F.when(faced, F.col("xwoba"))), count_where(faced)).alias(f"con_{hand}_xwoba")]
    ends = terminal_rows(pitches).groupBy(*keys).agg(
        F.count("*").alias("statcast_pa"), count_where(play).alias("bbe"), count_where(measured).alias("measured_bbe"), count_where(classified).alias("classified_bbe"),
        count_where(covered).alias("covered_ab"), count_where(at_bat).alias("statcast_ab"), safe_divide(count_where(covered), count_where(at_bat)).alias("coverage"),
        safe_divide(count_where(measured & (F.col("launch_speed") >= fl.HARD_HIT_SPEED)), count_where(measured)).alias("hard_hit"),
        safe_divide(count_where(classified & (F.col("launch_speed_angle") == BARREL_CLASS)), count_where(classified)).alias("barrel"),
        F.avg(F.when(measured, F.col("launch_speed"))).alias("ev"),
        safe_divide(count_where(covered & F.col("events").isin(fl.HITS)), count_where(covered)).alias("covered_avg"),
        safe_divide(F.sum(F.when(covered, F.coalesce("xba", F.lit(0.0)))), count_where(covered)).alias("covered_xba"),
        *hands,
    )
    swing, outside = F.col("description").isin(fl.SWINGS), fl.strictly_outside(F.col("zone"))
    seen = pitches.groupBy(*keys).agg(
        safe_divide(count_where(F.col("description").isin(fl.WHIFFS)), count_where(swing)).alias("whiff"),
        safe_divide(count_where(swing & outside), count_where(outside)).alias("chase"),
    )
    counted = ["statcast_pa", "bbe", "measured_bbe", "classified_bbe", "covered_ab", "statcast_ab", "con_L_n", "con_R_n"]
    return seen.join(ends, keys, "left").na.fill(0, counted)


def league_rates(stats: DataFrame) -> DataFrame:
    """One row of league rates per plate appearance (hits per at-bat), 0 when undefined."""
    rate = lambda k: F.coalesce(safe_divide(F.sum(k), F.sum(denominator(k))), F.lit(0.0))
    return stats.agg(*[rate(k).alias(k) for k in RATE_KEYS])


def pace_rates(season: DataFrame, recent: DataFrame, league: Column, ident: str = "batter_id") -> DataFrame:
    """Recent rate over a player prior, itself the season without the recent window over the league.

    A season smaller than its own recent window is a contradiction and gives `reconciles` false.
    """
    a = season.select(ident, *[F.col(c).alias(f"s_{c}") for c in COUNTS])
    b = recent.select(ident, *[F.col(c).alias(f"r_{c}") for c in COUNTS])
    joined = a.join(b, ident).withColumn("__l", league)
    ok, rates = F.lit(True), {}
    for key in RATE_KEYS:
        d = denominator(key)
        n, y = F.col(f"s_{d}") - F.col(f"r_{d}"), F.col(f"s_{key}") - F.col(f"r_{key}")
        ok = ok & (n >= 0) & (y >= 0)
        prior = smooth(y, n, F.col(f"__l.{key}"), LEAGUE_PRIOR)
        rates[f"pace_{key}"] = smooth(F.col(f"r_{key}"), F.col(f"r_{d}"), prior, PLAYER_PRIOR)
    return joined.withColumns({**rates, "reconciles": ok}).select(ident, *rates, "reconciles")


def usage(pitches: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Team games, and plate appearances per team game, in three windows ending at the cutoff.

    Bench days count: the denominator is the team's games, not the player's.
    """
    spans = {"14": (13, 0), "7": (6, 0), "prev7": (13, 7)}
    dated = pitches.withColumn("__cut", cutoff)
    inside = {k: F.col("game_date").between(F.date_sub("__cut", a), F.date_sub("__cut", b)) for k, (a, b) in spans.items()}
    games = dated.groupBy("game_pk").agg(F.min("game_date").alias("game_date"), F.min("home_team").alias("h"), F.min("away_team").alias("a"), F.min("__cut").alias("__cut"))
    sides = games.select("game_pk", "game_date", "__cut", F.explode(F.array(normalize_team(F.col("h")), normalize_team(F.col("a")))).alias("team"))
    teams = sides.groupBy("team").agg(*[F.count_distinct(F.when(c, F.col("game_pk"))).alias(f"team_games_{k}") for k, c in inside.items()])
    per_game = terminal_rows(pitches).withColumn("__cut", cutoff).groupBy("batter_id", F.col("batter_team").alias("team"), "game_pk", "game_date", "__cut").agg(F.count("*").alias("n"))
    players = per_game.groupBy("batter_id", "team").agg(
        *[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(f"__pa_{k}") for k, c in inside.items()],
        *[count_where(c & (F.col("n") >= 3)).alias(f"games_3pa_{k}") for k, c in inside.items()],
    )
    used = players.join(teams, "team").withColumns(
        {f"pa_per_team_game_{k}": F.coalesce(positive_rate(F.col(f"__pa_{k}"), F.col(f"team_games_{k}")), F.lit(0.0)) for k in spans}
    )
    return used.drop(*[f"__pa_{k}" for k in spans]), teams


def eligible(active: Column, cutoff: Column) -> Column:
    """Active, sampled, used recently, and recorded plate appearances that match the official count."""
    coverage = F.coalesce(safe_divide(F.col("statcast_pa_30"), F.col("pa_30")), F.lit(0.0))
    rule = (
        active & (F.col("pa_30") >= 30) & (F.col("pa_season") >= 100) & (F.col("team_games_14") >= 5)
        & (F.coalesce("pa_per_team_game_14", F.lit(0.0)) >= 2) & (F.datediff(cutoff, F.col("last_seen")) <= 4) & coverage.between(0.95, 1.05)
    )
    return F.coalesce(rule, F.lit(False))


def box_stats(pitches: DataFrame, start: Column, end: Column) -> DataFrame:
    """Counting statistics from recorded plate appearances, for a date window."""
    ends = terminal_rows(pitches.filter(F.col("game_date").between(start, end)))
    event = F.col("events")
    at_bat = ~event.isin(fl.NOT_AT_BAT)
    return ends.groupBy("batter_id").agg(
        F.count("*").alias("pa"), count_where(at_bat).alias("ab"), count_where(event.isin(fl.HITS)).alias("h"),
        count_where(event == "home_run").alias("r"), count_where(event == "home_run").alias("hr"), count_where(event.isin("home_run", "sac_fly")).alias("rbi"),
        count_where(event == "triple").alias("sb"), count_where(event == "double").alias("cs"), count_where(event == "walk").alias("bb"),
        count_where(event.isin(fl.STRIKEOUTS)).alias("k"), F.count_distinct("game_pk").alias("games"),
    )


def radar(stats: dict[str, DataFrame], skill: dict[str, DataFrame], pitches: DataFrame, cutoff: Column, active: DataFrame | None = None, schedule: DataFrame | None = None) -> DataFrame:
    """One row per recent hitter: windows of statistics and contact, pace, usage, eligibility."""
    row = stats["30"].select("batter_id")
    for label, table in stats.items():
        cast = table.select("batter_id", *[F.col(c).alias(f"{c}_{label}") for c in COUNTS])
        row = row.join(cast, "batter_id", "left").na.fill(0, [f"{c}_{label}" for c in COUNTS])
        row = row.withColumns({
            f"avg_{label}": safe_divide(F.col(f"h_{label}"), F.col(f"ab_{label}")),
            f"k_rate_{label}": safe_divide(F.col(f"k_{label}"), F.col(f"pa_{label}")),
            f"bb_rate_{label}": safe_divide(F.col(f"bb_{label}"), F.col(f"pa_{label}")),
        })
    for label, table in skill.items():
        row = row.join(table.select("batter_id", *[F.col(c).alias(f"{c}_{label}") for c in table.columns if c != "batter_id"]), "batter_id", "left")
    league = league_rates(stats["season"]).select(F.struct("*")).scalar()
    row = row.join(pace_rates(stats["season"], stats["30"], league), "batter_id", "left")
    row = row.withColumns({f"season_rate_{k}": safe_divide(F.col(f"{k}_season"), F.col(f"{denominator(k)}_season")) for k in RATE_KEYS})
    last = pitches.groupBy("batter_id").agg(F.max_by("batter_team", F.struct("game_date", "game_pk", "at_bat_number")).alias("team"), F.max("game_date").alias("last_seen"))
    row = row.join(last, "batter_id", "left").withColumn("active_mlb", F.lit(active is None))
    if active is not None:
        now = active.select("batter_id", F.col("team").alias("__team"), F.lit(True).alias("__on"))
        row = row.join(now, "batter_id", "left").withColumns({"team": F.coalesce("__team", "team", F.lit("Unknown")), "active_mlb": F.coalesce("__on", F.lit(False))}).drop("__team", "__on")
    players, teams = usage(pitches, cutoff)
    own = players.drop(*[c for c in players.columns if c.startswith("team_games")])
    row = row.join(teams, "team", "left").join(own, ["batter_id", "team"], "left")
    counts = [c for c in row.columns if c.startswith(("team_games_", "games_3pa_", "pa_per_team_game_"))]
    row = row.na.fill(0, counts).withColumn("__cut", cutoff)
    row = row.withColumn("pa_coverage_30", safe_divide(F.coalesce("statcast_pa_30", F.lit(0)), F.col("pa_30")))
    row = row.withColumn("eligible", eligible(F.col("active_mlb"), F.col("__cut"))).drop("__cut")
    if schedule is not None:
        row = row.join(schedule_json(schedule), "team", "left")
    return row


def schedule_json(games: DataFrame) -> DataFrame:
    """A team's open games as one JSON text; a week's schedule bounds the list."""
    packed = F.struct("starts_at_utc", *[c for c in games.columns if c not in ("team", "starts_at_utc")])
    return games.groupBy("team").agg(F.to_json(F.array_sort(F.collect_list(packed))).alias("schedule_json"))


def open_games(games: DataFrame, now: Column) -> DataFrame:
    return games.filter(~F.coalesce("time_tbd", F.lit(False)) & (F.col("starts_at_utc").cast("timestamp") > now))


def plan_hitters(rows: DataFrame, games: DataFrame, dates: list[str], now: Column, target_average: float = 0.260, recent: bool = False) -> DataFrame:
    """Planned volume and categories over the selected open dates; NULL where not eligible."""
    chosen = open_games(games, now).filter(F.col("game_date").cast("string").isin(*dates))
    planned = chosen.groupBy("team").agg(F.count("*").alias("planned_games"))
    out = rows.join(planned, "team", "left").na.fill(0, ["planned_games"])
    valid = F.col("eligible") & finite(F.col("pa_per_team_game_14")) & (F.col("pa_per_team_game_14") >= 0)
    out = out.withColumn("planned_pa", F.when(valid, F.least(F.lit(5.0), F.col("pa_per_team_game_14")) * F.col("planned_games")))
    prefix = "pace_" if recent else "season_rate_"
    out = out.withColumns({f"planned_{k}": F.col("planned_pa") * F.col(f"{prefix}{k}") for k in ("r", "hr", "rbi", "sb", "ab")})
    out = out.withColumn("planned_h", F.col("planned_ab") * F.col(f"{prefix}h"))
    impact = F.col("planned_h") - target_average * F.col("planned_ab") if 0 <= target_average <= 1 else F.lit(None).cast("double")
    return out.withColumns({"planned_avg": positive_rate(F.col("planned_h"), F.col("planned_ab")), "planned_avg_impact": impact})


def weighted_z(df: DataFrame, weights: dict[str, float], name: str, pool: Column | None = None) -> DataFrame:
    """Weighted mean of population z-scores over a fixed pool; a constant column scores 0."""
    used = {c: max(0.0, float(w)) for c, w in weights.items()}
    inside = pool if pool is not None else F.lit(True)
    moments = [F.struct(F.avg(F.when(inside, F.col(c))).alias("m"), F.stddev_pop(F.when(inside, F.col(c))).alias("s")).alias(c) for c in used]
    stats = df.agg(*moments).select(F.struct("*")).scalar()
    staged = df.withColumn("__z", stats)
    total = sum(used.values())
    z = lambda c: F.when(F.col(f"__z.{c}.s") > 0, (F.col(c) - F.col(f"__z.{c}.m")) / F.col(f"__z.{c}.s")).otherwise(0.0)
    score = sum((z(c) * w for c, w in used.items()), F.lit(0.0)) / total if total > 0 else F.lit(None).cast("double")
    return staged.withColumn(name, F.when(inside, score)).drop("__z")


def rank_hitters(plans: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Priority score against every plannable hitter, whatever the later search or filter."""
    fields = {k: "planned_avg_impact" if k == "avg" else f"planned_{k}" for k in weights}
    pool = F.col("eligible") & (F.col("planned_games") > 0)
    for c in fields.values():
        pool = pool & finite(F.col(c))
    return weighted_z(plans, {fields[k]: w for k, w in weights.items()}, "priority_score", pool)


def replacement_delta(plans: DataFrame, incumbent: DataFrame) -> DataFrame:
    """Every candidate's planned totals minus the incumbent's (one row)."""
    fields = [f"planned_{k}" for k in ("r", "hr", "rbi", "sb", "ab", "h", "avg_impact", "pa")]
    base = incumbent.limit(1).select(F.struct(*fields)).scalar()
    return plans.withColumn("__i", base).select("batter_id", *[(F.col(f) - F.col(f"__i.{f}")).alias(f.replace("planned_", "delta_")) for f in fields])


def combined_average(hits: float, at_bats: float) -> Column:
    """Season-to-date average after the plan is added; NULL for impossible inputs."""
    if not (at_bats > 0 and 0 <= hits <= at_bats):
        return F.lit(None).cast("double")
    return (F.lit(float(hits)) + F.col("planned_h")) / (F.lit(float(at_bats)) + F.col("planned_ab"))


def signals() -> Column:
    """All rules a hitter's row meets, or `steady`."""
    c = F.col
    change = c("pa_per_team_game_7") - c("pa_per_team_game_prev7")
    seen = (c("team_games_7") >= 3) & (c("team_games_prev7") >= 3)
    contact = (
        (c("measured_bbe_14") >= 20) & (c("measured_bbe_prev14") >= 20) & (c("hard_hit_14") - c("hard_hit_prev14") >= 0.1)
        & (c("pa_14") >= 30) & (c("pa_prev14") >= 30) & (c("k_rate_14") <= c("k_rate_prev14") + 0.03)
    )
    covered = (c("covered_ab_30") >= 50) & (c("coverage_30") >= 0.9) & c("pa_coverage_30").between(0.95, 1.05)
    gap = c("covered_xba_30") - c("covered_avg_30")
    rules = [
        ("inactive", ~c("active_mlb")), ("limited", ~c("eligible")), ("short_season", c("eligible") & (c("pa_season") < 200)),
        ("role_up", seen & (change >= 0.8)), ("role_down", seen & (change <= -0.8)), ("contact_up", contact),
        ("under_contact", covered & (gap >= 0.04)), ("over_contact", covered & (-gap >= 0.04)), ("steal_activity", c("sb_30") >= 3),
    ]
    met = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return F.when(F.size(met) > 0, met).otherwise(F.array(F.lit("steady")))


def rate_diagnostic(pitches: DataFrame, cutoff: Column, offsets: tuple[int, ...] = (35, 21, 7), minimum_season: int = 100, minimum_recent: int = 30) -> DataFrame:
    """Error of pace and of the plain season rate on the next week, over several origins.

    All origins run in one pass: each plate appearance is copied to the origins it informs.
    """
    ends = terminal_rows(pitches).withColumn("__cut", cutoff)
    origin = F.explode(F.array(*[F.lit(o) for o in offsets]))
    spread = ends.withColumn("origin", origin).withColumn("__end", F.expr("date_sub(__cut, origin)"))
    after = F.datediff("game_date", "__end")
    part = F.when(after.between(1, 7), "future").when(after <= 0, "past")
    spread = spread.withColumn("__part", part).filter(F.col("__part").isNotNull()).withColumn("__recent", after.between(-29, 0))
    event = F.col("events")
    marks = {
        "pa": F.lit(True), "ab": ~event.isin(fl.NOT_AT_BAT), "h": event.isin(fl.HITS), "r": event == "home_run", "hr": event == "home_run",
        "rbi": event.isin("home_run", "sac_fly"), "sb": event == "triple",
    }
    past = F.col("__part") == "past"
    grouped = spread.groupBy("origin", "batter_id").agg(
        *[count_where(past & m).alias(f"s_{k}") for k, m in marks.items()],
        *[count_where(past & F.col("__recent") & m).alias(f"r_{k}") for k, m in marks.items()],
        *[count_where(~past & m).alias(f"f_{k}") for k, m in marks.items()],
    )
    league = grouped.groupBy("origin").agg(
        *[F.coalesce(safe_divide(F.sum(f"s_{k}"), F.sum(f"s_{denominator(k)}")), F.lit(0.0)).alias(f"l_{k}") for k in RATE_KEYS]
    )
    used = grouped.filter((F.col("s_pa") >= minimum_season) & (F.col("r_pa") >= minimum_recent) & (F.col("f_pa") > 0)).join(league, "origin")
    rows = []
    for key in ("r", "hr", "rbi", "sb", "h"):
        d = denominator(key)
        prior = smooth(F.col(f"s_{key}") - F.col(f"r_{key}"), F.col(f"s_{d}") - F.col(f"r_{d}"), F.col(f"l_{key}"), LEAGUE_PRIOR)
        pace = smooth(F.col(f"r_{key}"), F.col(f"r_{d}"), prior, PLAYER_PRIOR)
        simple = F.coalesce(safe_divide(F.col(f"s_{key}"), F.col(f"s_{d}")), F.lit(0.0))
        miss = lambda rate: F.abs(rate * F.col(f"f_{d}") - F.col(f"f_{key}"))  # noqa: B023, E731
        rows.append(F.struct(F.lit(key.upper()).alias("metric"), miss(pace).alias("a"), miss(simple).alias("b")))
    return used.select(F.explode(F.array(*rows)).alias("x")).groupBy("x.metric").agg(
        F.count("*").alias("player_weeks"), F.avg("x.a").alias("smoothed_mae"), F.avg("x.b").alias("season_mae")
    )


