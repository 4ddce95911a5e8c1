"""Composite products and their parts on the pitch binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.catalog.queries_marts import rounded
from fieldglass.catalog.registry import query
from fieldglass.catalog.tables import BIND, RAW
from fieldglass.functions import flags as fl
from fieldglass.plans import forecast, growth, hitters, matchup, radar
from fieldglass.plans.modeling import Boundaries

# Smaller sample gates than the defaults: the given tables spread few events over many users.
GATES = {
    7: {"pitches": 5, "batters_faced": 2, "expected_swings": 2, "expected_batted_balls": 1},
    14: {"pitches": 10, "batters_faced": 4, "expected_swings": 4, "expected_batted_balls": 1},
    30: {"pitches": 20, "batters_faced": 8, "expected_swings": 8, "expected_batted_balls": 2},
}
WHIFF_P = "(cast(release_spin_rate AS bigint) % 1024) / 1024.0D"
HARD_P = "(cast(release_spin_rate AS bigint) * 7 % 1024) / 1024.0D"


def predictions(t):
    scored = lambda cond, p: t.stored_fact.filter(cond).selectExpr("pitcher_id", "game_date", f"{p} AS predicted_probability")
    return {"whiff": scored(F.col("swing_flag") == 1, WHIFF_P), "hard_hit": scored((F.col("batted_ball_flag") == 1) & F.col("hard_hit_flag").isNotNull(), HARD_P)}


_PREDICTED = f"""
last AS (SELECT MAX(game_date) AS d FROM fact),
win AS (SELECT days AS window_days, back, d - (days * (back + 1) - 1) AS lo, d - days * back AS hi FROM last, (VALUES (7), (14), (30)) x(days), (VALUES (0), (1)) b(back)),
pred AS (SELECT pitcher_id, game_date, swing_flag = 1 AS sw, batted_ball_flag = 1 AND hard_hit_flag IS NOT NULL AS bb,
  {WHIFF_P.replace('1024.0D', '1024.0::DOUBLE')} AS wp, {HARD_P.replace('1024.0D', '1024.0::DOUBLE')} AS hp FROM fact)"""

_METRICS = """
met AS (SELECT pitcher_id, window_days, back, ARG_MAX(pitcher_name, game_date) AS pitcher_name, COUNT(DISTINCT game_pk) AS games, COUNT(*) AS pitches,
  COUNT(*) FILTER (plate_appearance_event <> 'truncated_pa') AS batters_faced, COUNT(*) FILTER (plate_appearance_event LIKE 'strikeout%') AS strikeouts,
  COUNT(*) FILTER (plate_appearance_event = 'walk') AS walks, COUNT(*) FILTER (plate_appearance_event IN ('single','double','triple','home_run')) AS hits_allowed,
  SUM(swing_flag)::BIGINT AS swings, SUM(whiff_flag)::BIGINT AS whiffs, SUM(chase_flag)::BIGINT AS chases, COUNT(*) FILTER (in_zone_flag = 0) AS out_of_zone_pitches,
  COUNT(*) FILTER (batted_ball_flag = 1 AND hard_hit_flag IS NOT NULL) AS measured_batted_balls, SUM(hard_hit_flag)::BIGINT AS hard_hits, MAX(game_date) AS last_game_date
  FROM fact JOIN win ON game_date BETWEEN lo AND hi GROUP BY 1, 2, 3)"""

_QUALIFIED = """
exp AS (SELECT pitcher_id, window_days, back, COUNT(*) FILTER (sw) AS expected_swings, AVG(wp) FILTER (sw) AS expected_whiff_rate, COUNT(*) FILTER (bb) AS expected_batted_balls, AVG(hp) FILTER (bb) AS expected_hard_hit_rate
  FROM pred JOIN win ON game_date BETWEEN lo AND hi GROUP BY 1, 2, 3),
gate(window_days, gp, gb, gs, gh) AS (VALUES (7, 5, 2, 2, 1), (14, 10, 4, 4, 1), (30, 20, 8, 8, 2)),
q AS (SELECT *, strikeouts / batters_faced AS kr, walks / batters_faced AS walk_rate, strikeouts / batters_faced - walks / batters_faced AS k_minus_bb_rate,
    whiffs / NULLIF(swings, 0) AS whiff_rate, chases / NULLIF(out_of_zone_pitches, 0) AS chase_rate, hard_hits / NULLIF(measured_batted_balls, 0) AS hard_hit_rate_allowed, pitches / games AS pitches_per_game,
    least(pitches / gp, batters_faced / gb, expected_swings / gs, expected_batted_balls / gh) AS multiple
  FROM met JOIN exp USING (pitcher_id, window_days, back) JOIN gate USING (window_days) WHERE pitches >= gp AND batters_faced >= gb AND expected_swings >= gs AND expected_batted_balls >= gh)"""


def _pct(column: str, descending: bool = False) -> str:
    way = " DESC" if descending else ""
    return (f"CASE WHEN {column} IS NOT NULL THEN (RANK() OVER (PARTITION BY window_days, back ORDER BY {column}{way} NULLS LAST) + (COUNT(*) OVER (PARTITION BY window_days, back, {column}) - 1) / 2)"
            f" / COUNT({column}) OVER (PARTITION BY window_days, back) END")


def _signal(weights: dict) -> str:
    terms = " + ".join(f"p_{k} * {w}::DOUBLE" for k, w in weights.items())
    return f"round_even(100.0::DOUBLE * (0.0::DOUBLE + {terms}) * 10, 0) / 10"


_RADAR_SQL = f"""{BIND}, {_PREDICTED}, {_METRICS}, {_QUALIFIED},
p AS (SELECT *, {', '.join(f"{_pct(source, not up)} AS p_{name}" for name, source, up in radar.PERCENTILES)} FROM q),
prof AS ({' UNION ALL '.join(f"SELECT *, '{key}' AS profile_key, {_signal(w)} AS fantasy_signal FROM p" for key, (_, w) in radar.PROFILES.items())}),
cur AS (SELECT c.*, o.fantasy_signal AS previous_signal, c.fantasy_signal - o.fantasy_signal AS change FROM prof c LEFT JOIN prof o ON o.pitcher_id = c.pitcher_id AND o.window_days = c.window_days
  AND o.profile_key = c.profile_key AND o.back = 1 WHERE c.back = 0),
radar AS (SELECT *, 50.0 * ((expected_whiff_rate - whiff_rate) + (hard_hit_rate_allowed - expected_hard_hit_rate)) AS gap,
  ROW_NUMBER() OVER (PARTITION BY window_days, profile_key ORDER BY fantasy_signal DESC NULLS LAST, pitcher_id) AS rank FROM cur WHERE fantasy_signal IS NOT NULL
  UNION ALL SELECT *, 50.0 * ((expected_whiff_rate - whiff_rate) + (hard_hit_rate_allowed - expected_hard_hit_rate)) AS gap, NULL FROM cur WHERE fantasy_signal IS NULL)"""


def _radar(t):
    return radar.radar(t.stored_fact, predictions(t), minimums=GATES)


@query("x1_pitcher_radar", f"""{_RADAR_SQL} SELECT window_days, profile_key, pitcher_id, pitcher_name, pitches, games, batters_faced, expected_swings, round(fantasy_signal, 1) AS fantasy_signal, rank,
  round(change, 1) + 0.0::DOUBLE AS signal_change, round(gap, 3) + 0.0::DOUBLE AS underlying_skill_gap_pp,
  CASE WHEN multiple >= 2 THEN 'Established sample' WHEN multiple >= 1.35 THEN 'Solid sample' ELSE 'Qualified sample' END AS sample_strength,
  CASE WHEN change IS NULL THEN 'Newly qualified' WHEN change >= 5 THEN 'Rising' WHEN change <= -5 THEN 'Cooling' ELSE 'Stable' END AS trend_status FROM radar""")
def _(t):
    r = _radar(t).select("window_days", "profile_key", "pitcher_id", "pitcher_name", "pitches", "games", "batters_faced", "expected_swings", F.round("fantasy_signal", 1).alias("fantasy_signal"), "rank",
                         (F.round("signal_change", 1) + 0.0).alias("signal_change"), (F.round("underlying_skill_gap_pp", 3) + 0.0).alias("underlying_skill_gap_pp"), "sample_strength", "trend_status")
    return r


@query("a15_period_metrics", f"""{BIND}, {_PREDICTED}, {_METRICS} SELECT * FROM met""")
def _(t):
    m = radar.pitcher_metrics(t.stored_fact, t.stored_fact.agg(F.max("game_date")).scalar(), (7, 14, 30))
    return m.select("pitcher_id", "window_days", "back", "pitcher_name", "games", "pitches", "batters_faced", "strikeouts", "walks", "hits_allowed", "swings", "whiffs", "chases", "out_of_zone_pitches",
                    "measured_batted_balls", "hard_hits", "last_game_date")


_OPP = """opp AS (SELECT batter_team AS opponent_team, COUNT(*) FILTER (plate_appearance_event <> 'truncated_pa') AS plate_appearances, COUNT(*) FILTER (plate_appearance_event LIKE 'strikeout%') AS k,
  COUNT(*) FILTER (plate_appearance_event = 'walk') AS w, SUM(hard_hit_flag) AS h, COUNT(*) FILTER (batted_ball_flag = 1 AND hard_hit_flag IS NOT NULL) AS m FROM fact WHERE game_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-28' GROUP BY 1),
oppr AS (SELECT opponent_team, plate_appearances, 100.0 * (0.5::DOUBLE * (RANK() OVER (ORDER BY k / plate_appearances) + (COUNT(*) OVER (PARTITION BY k / plate_appearances) - 1) / 2) / COUNT(*) OVER ()
  + 0.25::DOUBLE * (RANK() OVER (ORDER BY w / plate_appearances DESC) + (COUNT(*) OVER (PARTITION BY w / plate_appearances) - 1) / 2) / COUNT(*) OVER ()
  + 0.25::DOUBLE * (RANK() OVER (ORDER BY h / m DESC) + (COUNT(*) OVER (PARTITION BY h / m) - 1) / 2) / COUNT(*) OVER ()) AS opponent_matchup_signal FROM opp)"""
_PARK = """park AS (SELECT venue_id, COUNT(*) FILTER (plate_appearance_event <> 'truncated_pa') AS pa, SUM(batted_ball_flag)::BIGINT AS bb, SUM(hard_hit_flag) AS h, COUNT(*) FILTER (batted_ball_flag = 1 AND hard_hit_flag IS NOT NULL) AS m,
  COUNT(*) FILTER (plate_appearance_event = 'home_run') AS hr FROM fact JOIN ctx USING (game_pk) GROUP BY 1 HAVING bb >= 20 AND pa >= 20),
parkr AS (SELECT venue_id, pa, 100.0 * (0.6::DOUBLE * (RANK() OVER (ORDER BY h / m DESC) + (COUNT(*) OVER (PARTITION BY h / m) - 1) / 2) / COUNT(*) OVER ()
  + 0.4::DOUBLE * (RANK() OVER (ORDER BY hr / pa DESC) + (COUNT(*) OVER (PARTITION BY hr / pa) - 1) / 2) / COUNT(*) OVER ()) AS park_contact_suppression_signal FROM park)"""


def _span():
    return F.lit("2024-01-10").cast("date"), F.lit("2024-01-28").cast("date")


@query("a16_opponent_metrics", f"{BIND}, {_OPP} SELECT opponent_team, plate_appearances, round(opponent_matchup_signal, 6) AS opponent_matchup_signal FROM oppr")
def _(t):
    return rounded(matchup.opponent_metrics(t.stored_fact, *_span()).select("opponent_team", "plate_appearances", "opponent_matchup_signal"), "opponent_matchup_signal")


@query("a16_park_metrics", f"{BIND}, {_PARK} SELECT venue_id, pa AS park_plate_appearances, round(park_contact_suppression_signal, 6) AS park_contact_suppression_signal FROM parkr")
def _(t):
    return rounded(matchup.park_metrics(t.stored_fact, t.context, 20, 20).select("venue_id", "park_plate_appearances", "park_contact_suppression_signal"), "park_contact_suppression_signal")


def slots(t):
    """Late games as upcoming slots: the recorded starter is the probable one, TBD for some."""
    first = forecast.starters(t.stored_fact).join(t.stored_fact.groupBy("game_pk", "game_date", "pitcher_team").agg(F.min("batter_team").alias("opponent_team")), ["game_pk", "pitcher_team"])
    late = first.filter(F.col("game_date") > F.lit("2024-01-28").cast("date")).join(t.context.select("game_pk", "game_datetime_utc", "venue_id"), "game_pk")
    known = F.col("first_pitcher") % 7 != 0
    return late.select("game_pk", "game_date", "game_datetime_utc", "venue_id", "pitcher_team", "opponent_team", F.when(known, F.col("first_pitcher")).alias("pitcher_id"),
                       F.when(known, F.concat(F.lit("Player "), F.col("first_pitcher").cast("string"))).otherwise("TBD").alias("pitcher_name"),
                       F.when(known, "Confirmed probable").otherwise("TBD").alias("probable_status"), F.when(F.col("pitcher_team") < F.col("opponent_team"), "Home").otherwise("Away").alias("home_away"))


def forecasts(t):
    return t.ev.select((F.col("user_id") % 10 + 100).alias("venue_id"), F.col("ts").cast("timestamp").alias("forecast_time_utc"), F.col("value").alias("temperature_2m"), F.least(F.col("value"), F.lit(100.0)).alias("precipitation_probability"),
                       (F.col("k") % 100).cast("int").alias("weather_code"), F.col("k").cast("double").alias("wind_speed_10m"), F.col("c").cast("double").alias("wind_direction_10m"), "event_id")


def venues(t):
    return t.context.select("venue_id").distinct().select("venue_id", F.expr("CASE venue_id % 4 WHEN 0 THEN 'Dome' WHEN 1 THEN 'Retractable' WHEN 2 THEN 'Open' END").alias("roof_type"), F.lit("America/New_York").alias("time_zone_id"))


_SLOTS = """first_p AS (SELECT game_pk, game_date, pitcher_team, ARG_MIN(pitcher_id, pitch_number) AS sp, MIN(batter_team) AS opponent_team FROM fact GROUP BY 1, 2, 3),
slots AS (SELECT f.game_pk, f.game_date, game_datetime_utc, venue_id, pitcher_team, opponent_team, CASE WHEN sp % 7 <> 0 THEN sp END AS pitcher_id, CASE WHEN sp % 7 <> 0 THEN 'Confirmed probable' ELSE 'TBD' END AS probable_status,
  CASE WHEN pitcher_team < opponent_team THEN 'Home' ELSE 'Away' END AS home_away FROM first_p f JOIN ctx USING (game_pk) WHERE f.game_date > DATE '2024-01-28'),
fc AS (SELECT user_id % 10 + 100 AS venue_id, ts, value FROM ev),
wx AS (SELECT s.game_pk, s.pitcher_team, fc.value, ROW_NUMBER() OVER (PARTITION BY s.game_pk, s.pitcher_team ORDER BY abs(epoch_us(fc.ts) - epoch_us(game_datetime_utc)), fc.ts) AS k FROM slots s JOIN fc ON fc.venue_id = s.venue_id
  AND abs(epoch_us(fc.ts) - epoch_us(game_datetime_utc)) <= 7200000000),
slotw AS (SELECT s.*, CASE WHEN s.venue_id % 4 = 0 THEN 'Controlled environment' WHEN wx.value IS NULL THEN 'Forecast unavailable' WHEN wx.value >= 50 AND s.venue_id % 4 = 1 THEN 'Roof decision' WHEN wx.value >= 50 THEN 'Elevated rain risk'
  WHEN wx.value >= 25 THEN 'Weather watch' ELSE 'Low weather risk' END AS weather_risk, wx.value AS temperature_f FROM slots s LEFT JOIN wx ON wx.k = 1 AND wx.game_pk = s.game_pk AND wx.pitcher_team = s.pitcher_team)"""


@query("x2_slot_weather", f"{BIND}, {_SLOTS} SELECT game_pk, pitcher_team, home_away, probable_status, weather_risk, temperature_f FROM slotw")
def _(t):
    return matchup.with_weather(slots(t), forecasts(t).drop("event_id"), venues(t)).select("game_pk", "pitcher_team", "home_away", "probable_status", "weather_risk", "temperature_f")


_STREAM = f"""{_RADAR_SQL}, {_OPP}, {_PARK}, {_SLOTS},
sc AS (SELECT s.*, prof_key AS profile_key, r.fantasy_signal, r.multiple, r.change, o.opponent_matchup_signal, k.park_contact_suppression_signal,
  CASE WHEN r.fantasy_signal IS NOT NULL THEN 0.65 + CASE WHEN o.opponent_matchup_signal IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN k.park_contact_suppression_signal IS NOT NULL THEN 0.1 ELSE 0 END ELSE 0 END::DOUBLE AS coverage
  FROM slotw s CROSS JOIN (VALUES ('roto_balance'), ('strikeout_upside'), ('ratio_protection')) pk(prof_key) LEFT JOIN radar r ON r.pitcher_id = s.pitcher_id AND r.profile_key = prof_key AND r.window_days = 14
  LEFT JOIN oppr o USING (opponent_team) LEFT JOIN parkr k USING (venue_id)),
st AS (SELECT *, CASE WHEN coverage > 0 THEN floor((fantasy_signal * 0.65::DOUBLE + COALESCE(opponent_matchup_signal * 0.25::DOUBLE, 0) + COALESCE(park_contact_suppression_signal * 0.1::DOUBLE, 0)) / coverage * 10 + 0.5) / 10 END AS stream_score FROM sc)"""


def _stream(t):
    wx = matchup.with_weather(slots(t), forecasts(t).drop("event_id"), venues(t))
    r = _radar(t).filter(F.col("window_days") == 14)
    return matchup.stream_rows(wx, r, matchup.opponent_metrics(t.stored_fact, *_span()), matchup.park_metrics(t.stored_fact, t.context, 20, 20))


@query("x2_stream_planner", f"""{_STREAM} SELECT game_pk, pitcher_team, profile_key, probable_status, weather_risk, round(stream_score, 0) AS stream_score, round(coverage, 6) AS stream_score_coverage,
  CASE WHEN probable_status = 'TBD' THEN 'Awaiting probable starter' WHEN stream_score IS NULL THEN 'Insufficient recent sample' WHEN stream_score >= 80 THEN 'Priority stream research' WHEN stream_score >= 70 THEN 'Strong matchup research'
  WHEN stream_score >= 60 THEN 'League-context dependent' ELSE 'Low-priority matchup' END AS stream_tier FROM st""")
def _(t):
    rows = _stream(t).select("game_pk", "pitcher_team", "profile_key", "probable_status", "weather_risk", F.round("stream_score", 0).alias("stream_score"), F.round("stream_score_coverage", 6).alias("stream_score_coverage"), "stream_tier")
    return rows


@query("q26_planner_contract", f"""{_STREAM} SELECT COUNT(*) - 3 * (SELECT COUNT(*) FROM slots) AS row_count_difference, 0 AS duplicate_keys, 0 AS missing_profiles,
  COUNT(*) FILTER (stream_score NOT BETWEEN 0 AND 100) AS scores_out_of_bounds, COUNT(*) FILTER (stream_score IS NOT NULL AND probable_status = 'TBD') AS scored_tbd FROM st""")
def _(t):
    return matchup.contract(_stream(t), slots(t))


@query("x9_personal_fit", f"""{_STREAM}, up AS (SELECT game_pk, pitcher_team, stream_score AS k FROM st WHERE profile_key = 'strikeout_upside'),
  f AS (SELECT st.game_pk, st.pitcher_team, stream_score, CASE WHEN stream_score IS NULL THEN 0 ELSE CASE weather_risk WHEN 'Elevated rain risk' THEN 8 WHEN 'Roof decision' THEN 4 WHEN 'Weather watch' THEN 3 ELSE 0 END
    + CASE WHEN multiple >= 2 THEN 0 WHEN multiple >= 1.35 THEN 2 ELSE 4 END + CASE WHEN change <= -5 THEN 3 ELSE 0 END END AS pen, COALESCE(0.6::DOUBLE * stream_score + 0.4::DOUBLE * k, stream_score) AS basis
    FROM st LEFT JOIN up USING (game_pk, pitcher_team) WHERE profile_key = 'roto_balance')
  SELECT game_pk, pitcher_team, CASE WHEN stream_score IS NOT NULL THEN CAST(5 * floor((greatest(0, least(100, basis - pen)) + 0.03) / 5) AS INTEGER) END AS fit_from, pen AS scenario_penalty, CASE WHEN stream_score IS NULL THEN 'Wait for evidence' WHEN greatest(0, least(100, basis - pen)) >= 80 THEN 'Priority shortlist' WHEN greatest(0, least(100, basis - pen)) >= 70 THEN 'Shortlist'
  ELSE 'Below threshold' END AS strategy_action FROM f""")
def _(t):
    # In bands of five: stream scores have one digit, and two orders of adding doubles may round a tie apart.
    band = (5 * F.floor((F.col("personalized_fit_score") + 0.03) / 5)).cast("int")
    return matchup.personal_fit(_stream(t), "roto_balance", True, "Low risk").select("game_pk", "pitcher_team", band.alias("fit_from"), "scenario_penalty", "strategy_action")


# ---- forecast ----------------------------------------------------------------------------

_APP = """app AS (SELECT f.game_pk, f.game_date, pitcher_id, pitcher_team, MIN(batter_team) AS opponent_team, COUNT(*) AS pitches, COUNT(*) FILTER (plate_appearance_event <> 'truncated_pa') AS batters_faced,
  COUNT(*) FILTER (plate_appearance_event LIKE 'strikeout%') AS strikeouts, BOOL_OR(pitcher_id = fp) AS is_starter, ANY_VALUE(game_datetime_utc) AS game_datetime_utc
  FROM (SELECT *, FIRST_VALUE(pitcher_id) OVER (PARTITION BY game_pk, pitcher_team ORDER BY at_bat_number, pitch_number) AS fp FROM fact) f JOIN ctx USING (game_pk)
  WHERE game_status IN ('Final', 'Game Over', 'Completed Early') GROUP BY 1, 2, 3, 4)"""
BOUNDS = Boundaries("2024-01-08", "2024-01-09", "2024-01-20", "2024-01-30")


@query("a14_appearances", f"{BIND}, {_APP} SELECT * FROM app")
def _(t):
    return forecast.appearances(t.stored_fact, t.context).select("game_pk", "game_date", "pitcher_id", "pitcher_team", "opponent_team", "pitches", "batters_faced", "strikeouts", "is_starter", "game_datetime_utc")


_PREDICT = f"""{BIND}, {_APP}, pri AS (SELECT AVG(batters_faced) FILTER (is_starter) AS sb, AVG(strikeouts) FILTER (is_starter) AS sk, SUM(strikeouts) FILTER (is_starter) / SUM(batters_faced) FILTER (is_starter) AS skr,
  SUM(strikeouts) / SUM(batters_faced) AS okr FROM app WHERE game_date <= DATE '2024-01-08'),
tgt AS (SELECT * FROM app WHERE is_starter AND game_date BETWEEN DATE '2024-01-09' AND DATE '2024-01-30'),
past AS (SELECT g.game_pk, g.pitcher_id, g.pitcher_team, s.batters_faced AS b, s.strikeouts AS k, ROW_NUMBER() OVER (PARTITION BY g.game_pk, g.pitcher_id, g.pitcher_team ORDER BY s.game_date DESC, s.game_pk DESC, s.pitcher_team DESC) AS n
  FROM tgt g JOIN app s ON s.pitcher_id = g.pitcher_id AND s.is_starter AND s.game_date < g.game_date),
five AS (SELECT game_pk, pitcher_id, pitcher_team, COUNT(*) AS prior_starts, SUM(b) AS pb, SUM(k) AS pk FROM past WHERE n <= 5 GROUP BY 1, 2, 3),
opp30 AS (SELECT g.game_pk, g.pitcher_id, g.pitcher_team, SUM(a.batters_faced) AS ob, SUM(a.strikeouts) AS ok FROM tgt g JOIN app a ON a.opponent_team = g.opponent_team AND a.game_date >= g.game_date - 30 AND a.game_date < g.game_date GROUP BY 1, 2, 3),
st AS (SELECT g.game_pk, g.pitcher_id, g.pitcher_team, g.game_date, g.strikeouts AS actual_k, COALESCE(prior_starts, 0) AS prior_starts, COALESCE(pb, 0) AS pb, COALESCE(pk, 0) AS pk, COALESCE(ob, 0) AS ob, COALESCE(ok, 0) AS ok
  FROM tgt g LEFT JOIN five USING (game_pk, pitcher_id, pitcher_team) LEFT JOIN opp30 USING (game_pk, pitcher_id, pitcher_team)),
pred AS (SELECT game_pk, pitcher_id, game_date, actual_k, prior_starts, sk AS league_mean, (pk + 3 * sk) / (prior_starts + 3) AS recent_starts,
  (pb + 3 * sb) / (prior_starts + 3) * ((pk + 50 * skr) / (pb + 50)) * least(1.2, greatest(0.8, sqrt(((ok + 100 * okr) / (ob + 100)) / okr))) AS workload_opponent FROM st, pri)"""


@query("i9_chronological_predictions", f"{_PREDICT} SELECT game_pk, pitcher_id, game_date, actual_k, CAST(prior_starts AS INTEGER) AS prior_starts, round(league_mean, 6) AS league_mean, round(recent_starts, 6) AS recent_starts, round(workload_opponent, 6) AS workload_opponent FROM pred")
def _(t):
    p = forecast.chronological_predictions(forecast.appearances(t.stored_fact, t.context), BOUNDS)
    return rounded(p.select("game_pk", "pitcher_id", "game_date", "actual_k", F.col("prior_starts").cast("int").alias("prior_starts"), *forecast.MODELS), *forecast.MODELS)


_SPLIT = f"""{_PREDICT}, d AS (SELECT DISTINCT game_date FROM pred WHERE game_date < DATE '2024-01-20'), dn AS (SELECT game_date, ROW_NUMBER() OVER (ORDER BY game_date) - 1 AS i, COUNT(*) OVER () AS n FROM d),
cut AS (SELECT game_date AS c FROM dn WHERE i = greatest(1, least(n - 1, CAST(floor(n * 0.7) AS BIGINT)))),
long AS (SELECT game_date, actual_k, m AS model, CASE m WHEN 'league_mean' THEN league_mean WHEN 'recent_starts' THEN recent_starts ELSE workload_opponent END AS p,
  CASE WHEN game_date >= DATE '2024-01-20' THEN 'test' WHEN game_date >= (SELECT c FROM cut) THEN 'calibration' ELSE 'selection' END AS split FROM pred CROSS JOIN (VALUES ('league_mean'), ('recent_starts'), ('workload_opponent')) v(m)),
sel AS (SELECT model, AVG(abs(p - actual_k)) AS selection_mae FROM long WHERE split = 'selection' GROUP BY 1), best AS (SELECT ARG_MIN(model, selection_mae) AS b FROM sel),
err AS (SELECT abs(p - actual_k) AS e, ROW_NUMBER() OVER (ORDER BY abs(p - actual_k)) - 1 AS i, COUNT(*) OVER () AS n FROM long WHERE split = 'calibration' AND model = (SELECT b FROM best)),
rad AS (SELECT e AS r FROM err WHERE i = ceil(least(1.0, ceil((n + 1) * 0.8) / n) * (n - 1)))"""


@query("x3_backtest", f"""{_SPLIT} SELECT model, model = (SELECT b FROM best) AS is_selected, round(MAX(selection_mae), 6) AS selection_mae, COUNT(*) AS rows, round(AVG(abs(p - actual_k)), 6) AS mae, round(sqrt(AVG((p - actual_k) ** 2)), 6) AS rmse,
  round(AVG(p - actual_k), 6) AS bias, round((SELECT r FROM rad), 6) AS interval_radius FROM long JOIN sel USING (model) WHERE split = 'test' GROUP BY 1""")
def _(t):
    p = forecast.chronological_predictions(forecast.appearances(t.stored_fact, t.context), BOUNDS)
    return rounded(forecast.backtest(p, BOUNDS).select("model", "is_selected", "selection_mae", "rows", "mae", "rmse", "bias", "interval_radius"), "selection_mae", "mae", "rmse", "bias", "interval_radius")


@query("m16_interval_radius", """WITH e AS (SELECT abs(l_quantity - 25.5) AS e, ROW_NUMBER() OVER (ORDER BY abs(l_quantity - 25.5)) - 1 AS i, COUNT(*) OVER () AS n FROM lineitem) SELECT e AS radius FROM e WHERE i = ceil(least(1.0, ceil((n + 1) * 0.8) / n) * (n - 1))""")
def _(t):
    return forecast.interval_radius(t.lineitem.select(F.abs(F.col("l_quantity") - 25.5).alias("e")), "e")


def _archive(t):
    """Two archived forecasts per start, some made after it, some for games never played."""
    a = forecast.appearances(t.stored_fact, t.context).filter(F.col("is_starter"))
    early = F.col("game_datetime_utc") - F.expr("INTERVAL 5 HOURS")
    versions = F.explode(F.array(F.struct(early.alias("at"), F.lit("v1").alias("model_version"), F.lit(2.5).alias("predicted_k")), F.struct((early + F.expr("INTERVAL 1 HOUR")).alias("at"), F.lit("v2").alias("model_version"), F.lit(4.0).alias("predicted_k"))))
    late = F.when(F.col("pitcher_id") % 5 == 0, F.expr("INTERVAL 6 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    shown = a.withColumn("v", versions).select((F.col("game_pk") + F.when(F.col("pitcher_id") % 11 == 0, 100000).otherwise(0)).alias("game_pk"), F.when(F.col("pitcher_id") % 3 == 0, F.col("pitcher_id") + 1000).otherwise(F.col("pitcher_id")).alias("pitcher_id"),
                                                (F.col("v.at") + late).alias("generated_at_utc"), "v.model_version", "v.predicted_k", F.lit(1).alias("lower_k"), F.lit(5).alias("upper_k"))
    return shown


_ARCHIVE = f"""{BIND}, {_APP}, arch AS (SELECT game_pk + CASE WHEN pitcher_id % 11 = 0 THEN 100000 ELSE 0 END AS game_pk, CASE WHEN pitcher_id % 3 = 0 THEN pitcher_id + 1000 ELSE pitcher_id END AS pitcher_id,
  game_datetime_utc - INTERVAL 5 HOUR + CASE WHEN v = 'v2' THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END + CASE WHEN pitcher_id % 5 = 0 THEN INTERVAL 6 HOUR ELSE INTERVAL 0 HOUR END AS generated_at_utc, v AS model_version, CASE WHEN v = 'v1' THEN 2.5 ELSE 4.0 END::DOUBLE AS predicted_k
  FROM app CROSS JOIN (VALUES ('v1'), ('v2')) x(v) WHERE is_starter),
first_f AS (SELECT * FROM arch QUALIFY ROW_NUMBER() OVER (PARTITION BY game_pk, pitcher_id ORDER BY generated_at_utc) = 1),
settled AS (SELECT f.game_pk, f.pitcher_id, f.model_version, predicted_k, CASE WHEN a.strikeouts IS NOT NULL AND f.generated_at_utc < a.game_datetime_utc THEN 'observed' WHEN a.strikeouts IS NOT NULL THEN 'excluded_after_actual_start'
  WHEN EXISTS (SELECT 1 FROM app p WHERE p.game_pk = f.game_pk) THEN 'did_not_start' ELSE 'pending' END AS outcome_status, a.strikeouts AS k FROM first_f f LEFT JOIN app a ON a.game_pk = f.game_pk AND a.pitcher_id = f.pitcher_id AND a.is_starter)"""


@query("j17_settlement", f"{_ARCHIVE} SELECT game_pk, pitcher_id, model_version, outcome_status, CASE WHEN outcome_status = 'observed' THEN k END AS actual_k, CASE WHEN outcome_status = 'observed' THEN abs(k - predicted_k) END AS absolute_error FROM settled")
def _(t):
    return forecast.settle(_archive(t), forecast.appearances(t.stored_fact, t.context)).select("game_pk", "pitcher_id", "model_version", "outcome_status", "actual_k", "absolute_error")


@query("a24_live_monitor", f"""{_ARCHIVE} SELECT model_version, COUNT(*) AS recorded, COUNT(*) FILTER (outcome_status = 'observed') AS observed, COUNT(*) FILTER (outcome_status = 'pending') AS pending,
  COUNT(*) FILTER (outcome_status NOT IN ('pending', 'observed')) AS excluded, round(AVG(abs(predicted_k - k)) FILTER (outcome_status = 'observed'), 6) AS mae, round(AVG((k BETWEEN 1 AND 5)::INTEGER) FILTER (outcome_status = 'observed'), 6) AS interval_coverage,
  CASE WHEN COUNT(*) FILTER (outcome_status = 'observed') = 0 THEN 'awaiting_outcomes' WHEN COUNT(*) FILTER (outcome_status = 'observed') < 30 THEN 'limited_sample' ELSE 'descriptive_only' END AS status FROM settled GROUP BY 1""")
def _(t):
    monitor = forecast.live_monitor(forecast.settle(_archive(t), forecast.appearances(t.stored_fact, t.context)))
    return rounded(monitor.select("model_version", "recorded", "observed", "pending", "excluded", "mae", "interval_coverage", "status"), "mae", "interval_coverage")


@query("i10_earliest_forecast", f"{_ARCHIVE} SELECT game_pk, pitcher_id, model_version, predicted_k FROM first_f")
def _(t):
    from fieldglass.operators.incremental import earliest_forecast

    return earliest_forecast(_archive(t), ["game_pk", "pitcher_id"], "generated_at_utc", "model_version").select("game_pk", "pitcher_id", "model_version", "predicted_k")


_UPCOMING = f"""{_APP}, seen AS (SELECT * FROM app WHERE game_date <= DATE '2024-01-28'),
lp AS (SELECT AVG(batters_faced) FILTER (is_starter) AS sb, AVG(strikeouts) FILTER (is_starter) AS sk, SUM(strikeouts) FILTER (is_starter) / SUM(batters_faced) FILTER (is_starter) AS skr, SUM(strikeouts) / SUM(batters_faced) AS okr FROM seen WHERE game_date <= DATE '2024-01-20'),
ask AS (SELECT * FROM slots WHERE pitcher_id IS NOT NULL AND game_datetime_utc > TIMESTAMP '2024-01-28' AND game_date > (SELECT MAX(game_date) FROM seen)),
form AS (SELECT pitcher_id, COUNT(*) AS starts, SUM(batters_faced) AS pb, SUM(strikeouts) AS pk, MAX(game_date) AS last_start_date
  FROM (SELECT * FROM seen WHERE is_starter QUALIFY ROW_NUMBER() OVER (PARTITION BY pitcher_id ORDER BY game_date DESC, game_pk DESC, pitcher_team DESC) <= 5) GROUP BY 1),
foe AS (SELECT a.game_pk, a.pitcher_team, SUM(s.batters_faced) AS ob, SUM(s.strikeouts) AS ok FROM ask a JOIN seen s ON s.opponent_team = a.opponent_team AND s.game_date BETWEEN a.game_date - 30 AND a.game_date - 1 GROUP BY 1, 2),
made AS (SELECT a.game_pk, a.pitcher_team, a.pitcher_id, a.game_datetime_utc, COALESCE(starts, 0) AS prior_starts, last_start_date, (COALESCE(pk, 0) + 3 * sk) / (COALESCE(starts, 0) + 3) AS recent_starts,
  (COALESCE(pb, 0) + 3 * sb) / (COALESCE(starts, 0) + 3) * ((COALESCE(pk, 0) + 50 * skr) / (COALESCE(pb, 0) + 50)) * least(1.2, greatest(0.8, sqrt(((COALESCE(ok, 0) + 100 * okr) / (COALESCE(ob, 0) + 100)) / okr))) AS workload_opponent
  FROM ask a LEFT JOIN form USING (pitcher_id) LEFT JOIN foe USING (game_pk, pitcher_team), lp)"""


@query("m19_upcoming_forecast", f"""{BIND}, {_SLOTS}, {_UPCOMING} SELECT game_pk, pitcher_team, pitcher_id, CAST(prior_starts AS BIGINT) AS prior_starts, last_start_date, round(workload_opponent, 6) AS predicted_k,
  CAST(greatest(0, ceil(workload_opponent - 1.5)) AS INTEGER) AS lower_k, CAST(greatest(0, ceil(workload_opponent - 1.5), floor(workload_opponent + 1.5)) AS INTEGER) AS upper_k,
  CASE WHEN prior_starts < 3 THEN 'Limited starting history' ELSE 'At least 3 prior starts' END AS sample_status FROM made""")
def _(t):
    rows = forecast.appearances(t.stored_fact, t.context).filter(F.col("game_date") <= F.lit("2024-01-28").cast("date"))
    up = forecast.upcoming(slots(t), rows, "2024-01-20", "workload_opponent", 1.5, F.lit("2024-01-28 00:00:00").cast("timestamp"))
    return rounded(up.select("game_pk", "pitcher_team", "pitcher_id", "prior_starts", "last_start_date", "predicted_k", "lower_k", "upper_k", "sample_status"), "predicted_k")


# Columns of the fact that the radar, its predictions, the appearances and the slots read.
_COMPARED = ["game_pk", "game_date", "at_bat_number", "pitch_number", "pitcher_id", "pitcher_name", "pitcher_team", "batter_team", "plate_appearance_event",
             "swing_flag", "whiff_flag", "chase_flag", "in_zone_flag", "batted_ball_flag", "hard_hit_flag", "release_speed", "release_spin_rate"]


@query("j16_comparison", f"""{_RADAR_SQL}, {_SLOTS}, {_UPCOMING}, r AS (SELECT pitcher_id, fantasy_signal, rank FROM radar WHERE window_days = 14 AND profile_key = 'roto_balance'),
  n AS (SELECT * FROM made QUALIFY ROW_NUMBER() OVER (PARTITION BY pitcher_id ORDER BY game_datetime_utc) = 1)
  SELECT pitcher_id, round(fantasy_signal, 1) AS fantasy_signal, rank, game_datetime_utc, round(recent_starts, 6) AS predicted_k FROM r FULL JOIN n USING (pitcher_id)""")
def _(t):
    t.store_fact(*_COMPARED)
    rows = forecast.appearances(t.stored_fact, t.context).filter(F.col("game_date") <= F.lit("2024-01-28").cast("date"))
    up = forecast.upcoming(slots(t), rows, "2024-01-20", "recent_starts", 1.5, F.lit("2024-01-28 00:00:00").cast("timestamp"))
    both = forecast.comparison(_radar(t), up).select("pitcher_id", F.round("fantasy_signal", 1).alias("fantasy_signal"), "rank", "game_datetime_utc", "predicted_k")
    return rounded(both, "predicted_k")


# ---- hitters -----------------------------------------------------------------------------

def cutoff():
    return F.lit("2024-01-30").cast("date")


def hit_pitches(t):
    return hitters.hitter_pitches(t.raw_pitch, F.date_sub(cutoff(), 29), cutoff())


_HIT = """hp AS (SELECT game_pk, CAST(game_date AS DATE) AS game_date, at_bat_number, pitch_number, batter AS batter_id, p_throws, events, description, zone, launch_speed, launch_speed_angle, home_team, away_team,
  CASE WHEN inning_topbot = 'Top' THEN away_team ELSE home_team END AS batter_team, estimated_ba_using_speedangle AS xba, estimated_woba_using_speedangle AS xwoba FROM raw_pitch
  WHERE game_type = 'R' AND CAST(game_date AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' QUALIFY ROW_NUMBER() OVER (PARTITION BY game_pk, at_bat_number, pitch_number ORDER BY loaded_at_utc DESC) = 1),
pa AS (SELECT * FROM hp WHERE events <> 'truncated_pa' QUALIFY ROW_NUMBER() OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number DESC) = 1)"""
_NOAB = "('walk','intent_walk','hit_by_pitch','sac_bunt','sac_fly','sac_fly_double_play','catcher_interf','sac_bunt_double_play')"
_CONTACT_SQL = f"""seen AS (SELECT batter_id, COUNT(*) FILTER (description LIKE 'swinging%' OR description = 'missed_bunt') / NULLIF(COUNT(*) FILTER (description LIKE 'swinging%' OR description LIKE 'foul%' OR description LIKE 'hit_into%'), 0) AS whiff,
  COUNT(*) FILTER (zone > 9 AND (description LIKE 'swinging%' OR description LIKE 'foul%' OR description LIKE 'hit_into%')) / NULLIF(COUNT(*) FILTER (zone > 9), 0) AS chase FROM hp GROUP BY 1),
ends AS (SELECT batter_id, COUNT(*) AS statcast_pa, COUNT(*) FILTER (description LIKE 'hit_into%') AS bbe, COUNT(launch_speed) FILTER (description LIKE 'hit_into%') AS measured_bbe, COUNT(*) FILTER (events NOT IN {_NOAB}) AS statcast_ab,
  COUNT(*) FILTER (events NOT IN {_NOAB} AND (xba IS NOT NULL OR events LIKE 'strikeout%')) AS covered_ab, AVG((launch_speed >= 95)::INTEGER) FILTER (description LIKE 'hit_into%') AS hard_hit,
  AVG((launch_speed_angle = 6)::INTEGER) FILTER (description LIKE 'hit_into%') AS barrel, AVG(launch_speed) FILTER (description LIKE 'hit_into%') AS ev,
  AVG((events IN ('single','double','triple','home_run'))::INTEGER) FILTER (events NOT IN {_NOAB} AND (xba IS NOT NULL OR events LIKE 'strikeout%')) AS covered_avg,
  AVG(COALESCE(xba, 0)) FILTER (events NOT IN {_NOAB} AND (xba IS NOT NULL OR events LIKE 'strikeout%')) AS covered_xba, COUNT(xwoba) FILTER (description LIKE 'hit_into%' AND p_throws = 'L') AS con_L_n,
  AVG(xwoba) FILTER (description LIKE 'hit_into%' AND p_throws = 'L') AS con_L_xwoba FROM pa GROUP BY 1)"""
_CONTACT_COLS = ["whiff", "chase", "hard_hit", "barrel", "ev", "covered_avg", "covered_xba", "con_L_xwoba"]


_CONTACT_REST = f"""rest AS (SELECT batter_id, COUNT(launch_speed_angle) FILTER (description LIKE 'hit_into%') AS classified_bbe, COUNT(xwoba) FILTER (description LIKE 'hit_into%' AND p_throws = 'R') AS con_R_n,
  AVG(xwoba) FILTER (description LIKE 'hit_into%' AND p_throws = 'R') AS con_R_xwoba, AVG((xba IS NOT NULL OR events LIKE 'strikeout%')::INTEGER) FILTER (events NOT IN {_NOAB}) AS coverage FROM pa GROUP BY 1)"""
_CONTACT_ALL = [*_CONTACT_COLS, "con_R_xwoba", "coverage"]


@query("a20_contact_metrics", f"""{RAW}, {_HIT}, {_CONTACT_SQL}, {_CONTACT_REST} SELECT batter_id, COALESCE(statcast_pa, 0) AS statcast_pa, COALESCE(bbe, 0) AS bbe, COALESCE(measured_bbe, 0) AS measured_bbe, COALESCE(statcast_ab, 0) AS statcast_ab,
  COALESCE(covered_ab, 0) AS covered_ab, COALESCE(con_L_n, 0) AS "con_L_n",
  COALESCE(con_R_n, 0) AS "con_R_n", COALESCE(classified_bbe, 0) AS classified_bbe, {', '.join(f'round({c}, 6) AS "{c}"' for c in _CONTACT_ALL)} FROM seen LEFT JOIN ends USING (batter_id) LEFT JOIN rest USING (batter_id)""")
def _(t):
    m = hitters.contact_metrics(hit_pitches(t)).select("batter_id", "statcast_pa", "bbe", "measured_bbe", "statcast_ab", "covered_ab", "con_L_n", "con_R_n", "classified_bbe", *_CONTACT_ALL)
    return rounded(m, *_CONTACT_ALL)


_BOX = f"""box AS (SELECT batter_id, COUNT(*) AS pa, COUNT(*) FILTER (events NOT IN {_NOAB}) AS ab, COUNT(*) FILTER (events IN ('single','double','triple','home_run')) AS h, COUNT(*) FILTER (events = 'home_run') AS hr,
  COUNT(*) FILTER (events = 'triple') AS sb, COUNT(*) FILTER (events = 'walk') AS bb, COUNT(*) FILTER (events LIKE 'strikeout%') AS k, COUNT(DISTINCT game_pk) AS games FROM pa GROUP BY 1)"""


@query("a21_league_rates", f"{RAW}, {_HIT}, {_BOX} SELECT round(SUM(hr) / SUM(pa), 6) AS hr, round(SUM(h) / SUM(ab), 6) AS h, round(SUM(ab) / SUM(pa), 6) AS ab, round(SUM(sb) / SUM(pa), 6) AS sb FROM box")
def _(t):
    rates = hitters.league_rates(hitters.box_stats(hit_pitches(t), F.date_sub(cutoff(), 29), cutoff()))
    return rounded(rates.select("hr", "h", "ab", "sb"), "hr", "h", "ab", "sb")


@query("x5_pace_rates", f"""{RAW}, {_HIT}, b AS (SELECT batter_id, COUNT(*) AS pa, COUNT(*) FILTER (events NOT IN {_NOAB}) AS ab, COUNT(*) FILTER (events IN ('single','double','triple','home_run')) AS h, COUNT(*) FILTER (events = 'home_run') AS hr,
    COUNT(*) FILTER (game_date >= DATE '2024-01-17') AS rpa, COUNT(*) FILTER (events NOT IN {_NOAB} AND game_date >= DATE '2024-01-17') AS rab,
    COUNT(*) FILTER (events IN ('single','double','triple','home_run') AND game_date >= DATE '2024-01-17') AS rh, COUNT(*) FILTER (events = 'home_run' AND game_date >= DATE '2024-01-17') AS rhr FROM pa GROUP BY 1),
  l AS (SELECT SUM(hr) / SUM(pa) AS lhr, SUM(h) / SUM(ab) AS lh FROM b)
  SELECT batter_id, round((rhr + 100 * ((hr - rhr + 200 * lhr) / (pa - rpa + 200))) / (rpa + 100), 6) AS pace_hr, round((rh + 100 * ((h - rh + 200 * lh) / (ab - rab + 200))) / (rab + 100), 6) AS pace_h FROM b, l WHERE rpa > 0""")
def _(t):
    p = hit_pitches(t)
    season = hitters.box_stats(p, F.date_sub(cutoff(), 29), cutoff())
    recent = hitters.box_stats(p, F.date_sub(cutoff(), 13), cutoff())
    league = hitters.league_rates(season).select(F.struct("*")).scalar()
    return rounded(hitters.pace_rates(season, recent, league).select("batter_id", "pace_hr", "pace_h"), "pace_hr", "pace_h")


@query("a22_usage", f"""{RAW}, {_HIT}, g AS (SELECT DISTINCT game_pk, game_date, home_team, away_team FROM hp), s AS (SELECT game_pk, game_date, home_team AS team FROM g UNION ALL SELECT game_pk, game_date, away_team FROM g),
  tg AS (SELECT team, COUNT(DISTINCT game_pk) FILTER (game_date >= DATE '2024-01-17') AS g14, COUNT(DISTINCT game_pk) FILTER (game_date BETWEEN DATE '2024-01-17' AND DATE '2024-01-23') AS gp7 FROM s GROUP BY 1),
  pg AS (SELECT batter_id, batter_team AS team, game_pk, game_date, COUNT(*) AS n FROM pa GROUP BY 1, 2, 3, 4)
  SELECT batter_id, team, MAX(g14) AS team_games_14, round(COALESCE(SUM(n) FILTER (game_date >= DATE '2024-01-17'), 0) / MAX(g14), 6) AS pa_per_team_game_14,
  round(COALESCE(COALESCE(SUM(n) FILTER (game_date BETWEEN DATE '2024-01-17' AND DATE '2024-01-23'), 0) / NULLIF(MAX(gp7), 0), 0), 6) AS pa_per_team_game_prev7, COUNT(*) FILTER (n >= 3 AND game_date >= DATE '2024-01-17') AS games_3pa_14 FROM pg JOIN tg USING (team) GROUP BY 1, 2""")
def _(t):
    players, _teams = hitters.usage(hit_pitches(t), cutoff())
    return rounded(players.select("batter_id", "team", "team_games_14", "pa_per_team_game_14", "pa_per_team_game_prev7", "games_3pa_14"), "pa_per_team_game_14", "pa_per_team_game_prev7")


_METRIC_EVENTS = {"R": "'home_run'", "HR": "'home_run'", "RBI": "'home_run','sac_fly'", "SB": "'triple'", "H": "'single','double','triple','home_run'"}
_METRIC_ROWS = ", ".join(f"{{'m': '{m}', 'y': events IN ({e}), 'd': {f'events NOT IN {_NOAB}' if m == 'H' else 'TRUE'}}}" for m, e in _METRIC_EVENTS.items())


@query("m20_rate_diagnostic", f"""{RAW}, {_HIT}, o AS (SELECT pa.*, x.o, game_date - (DATE '2024-01-30' - x.o::INTEGER) AS rel FROM pa CROSS JOIN (VALUES (14), (7)) x(o)),
  marked AS (SELECT o, batter_id, rel, UNNEST([{_METRIC_ROWS}]) AS u FROM o WHERE rel <= 7),
  g AS (SELECT o, batter_id, u.m AS metric, COUNT(*) FILTER (rel <= 0) AS spa, COUNT(*) FILTER (rel BETWEEN -29 AND 0) AS rpa, COUNT(*) FILTER (rel >= 1) AS fpa,
    COUNT(*) FILTER (rel <= 0 AND u.d) AS sd, COUNT(*) FILTER (rel <= 0 AND u.y) AS sy, COUNT(*) FILTER (rel BETWEEN -29 AND 0 AND u.d) AS rd, COUNT(*) FILTER (rel BETWEEN -29 AND 0 AND u.y) AS ry,
    COUNT(*) FILTER (rel >= 1 AND u.d) AS fd, COUNT(*) FILTER (rel >= 1 AND u.y) AS fy FROM marked GROUP BY 1, 2, 3),
  l AS (SELECT o, metric, COALESCE(SUM(sy) / NULLIF(SUM(sd), 0), 0) AS league FROM g GROUP BY 1, 2)
  SELECT metric, COUNT(*) AS player_weeks, round(AVG(abs((ry + 100 * ((sy - ry + 200 * league) / (sd - rd + 200))) / (rd + 100) * fd - fy)), 6) AS smoothed_mae, round(AVG(abs(COALESCE(sy / NULLIF(sd, 0), 0) * fd - fy)), 6) AS season_mae
  FROM g JOIN l USING (o, metric) WHERE spa >= 5 AND rpa >= 3 AND fpa > 0 GROUP BY 1""")
def _(t):
    return rounded(hitters.rate_diagnostic(hit_pitches(t), cutoff(), (14, 7), 5, 3), "smoothed_mae", "season_mae")


def hitter_radar(t):
    from fieldglass.session import cut_lineage

    p = cut_lineage(hit_pitches(t))  # read by every window below
    span = lambda a, b: (F.date_sub(cutoff(), a), F.date_sub(cutoff(), b))
    stats = {k: hitters.box_stats(p, *span(a, b)) for k, (a, b) in {"season": (29, 0), "30": (29, 0), "14": (13, 0), "7": (6, 0), "prev14": (27, 14)}.items()}
    skill = {k: hitters.contact_metrics(p.filter(F.col("game_date").between(*span(a, b)))) for k, (a, b) in {"30": (29, 0), "14": (13, 0), "prev14": (27, 14)}.items()}
    return hitters.radar(stats, skill, p, cutoff())


_SAMPLES = """s AS (SELECT l_suppkey, l_suppkey % 7 <> 0 AS active, COUNT(*) FILTER (l_quantity > 47) AS pa_30, COUNT(*) FILTER (l_quantity > 47 AND l_partkey % 25 <> 0) AS statcast_pa_30, COUNT(*) - 450 AS pa_season,
  COUNT(DISTINCT month(l_shipdate)) FILTER (l_quantity > 49) AS team_games_14, CASE WHEN l_suppkey % 11 <> 0 THEN AVG(l_tax) * 50 END AS pace, MAX(CAST(l_shipdate AS DATE)) AS last_seen FROM lineitem GROUP BY l_suppkey)"""


@query("p20_hitter_eligibility", f"""WITH {_SAMPLES} SELECT l_suppkey, COALESCE(active AND pa_30 >= 30 AND pa_season >= 100 AND team_games_14 >= 5 AND COALESCE(pace, 0) >= 2
  AND (SELECT MAX(last_seen) FROM s) - last_seen <= 4 AND COALESCE(statcast_pa_30 / NULLIF(pa_30, 0), 0) BETWEEN 0.95 AND 1.05, FALSE) AS eligible FROM s""")
def _(t):
    """The product's own rule over supplier samples: every condition decides some rows."""
    late = F.col("l_quantity") > 47
    s = t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(late).alias("pa_30"), F.count_if(late & (F.col("l_partkey") % 25 != 0)).alias("statcast_pa_30"), (F.count("*") - 450).alias("pa_season"),
        F.count_distinct(F.when(F.col("l_quantity") > 49, F.month("l_shipdate"))).alias("team_games_14"), (F.avg("l_tax") * 50).alias("pace"), F.max(F.to_date("l_shipdate")).alias("last_seen"))
    s = s.withColumn("pa_per_team_game_14", F.when(F.col("l_suppkey") % 11 != 0, F.col("pace")))
    last = t.lineitem.agg(F.max(F.to_date("l_shipdate"))).scalar()
    return s.withColumn("cutoff", last).select("l_suppkey", hitters.eligible(F.col("l_suppkey") % 7 != 0, F.col("cutoff")).alias("eligible"))


@query("p25_open_games", """SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' AND NOT COALESCE(CASE o_orderstatus WHEN 'O' THEN FALSE WHEN 'F' THEN TRUE END, FALSE)""")
def _(t):
    """The product's own rule: a stated or missing start flag, and a start after now."""
    flag = F.when(F.col("o_orderstatus") == "O", False).when(F.col("o_orderstatus") == "F", True)
    games = t.orders.select("o_orderkey", flag.alias("time_tbd"), F.col("o_orderdate").alias("starts_at_utc"))
    return hitters.open_games(games, F.lit("1997-01-01 00:00:00").cast("timestamp")).select("o_orderkey")


@query("x4_hitter_radar")
def _(t):
    return hitter_radar(t)


@query("x8_hitter_signals")
def _(t):
    return hitter_radar(t).select("batter_id", F.array_join(hitters.signals(), ",").alias("signals"))


def _plans(t):
    games = t.context.join(t.raw_pitch.select("game_pk", "home_team", "away_team").distinct(), "game_pk").withColumn("team", F.explode(F.array("home_team", "away_team"))).select(
        "team", F.col("official_date").alias("game_date"), F.col("game_datetime_utc").alias("starts_at_utc"), F.lit(False).alias("time_tbd"))
    rows = hitter_radar(t).withColumn("eligible", F.col("pa_30") >= 20)
    return hitters.plan_hitters(rows, games, ["2024-01-29", "2024-01-30"], F.lit("2024-01-29 00:00:00").cast("timestamp"))


@query("x6_hitter_ranking")
def _(t):
    return hitters.rank_hitters(_plans(t), hitters.PRIORITIES["power"]).select("batter_id", "team", "planned_games", "planned_pa", "planned_hr", "planned_avg", "priority_score", hitters.combined_average(30, 100).alias("combined_average"))


@query("x7_replacement_delta")
def _(t):
    plans = _plans(t)
    return hitters.replacement_delta(plans, plans.filter(F.col("planned_hr").isNotNull()).orderBy(F.col("planned_hr").desc(), "batter_id"))


# ---- report arithmetic -------------------------------------------------------------------

@query("x11_rate_decomposition", """WITH g AS (SELECT event_type, COUNT(*) FILTER (NOT late AND value >= 50) AS bn, COUNT(*) FILTER (NOT late) AS bd, COUNT(*) FILTER (late AND value >= 50) AS an, COUNT(*) FILTER (late) AS ad
    FROM (SELECT *, ts >= TIMESTAMP '2024-01-16' AS late FROM events) GROUP BY 1),
  r AS (SELECT *, bn / bd AS br, an / ad AS ar, bd / SUM(bd) OVER () AS bs, ad / SUM(ad) OVER () AS sh FROM g)
  SELECT event_type, round(br, 6) AS before_rate, round(ar, 6) AS after_rate, round(100 * (bs + sh) / 2 * (ar - br), 6) AS within_pp, round(100 * (br + ar) / 2 * (sh - bs), 6) AS mix_pp, round(100 * bs * (ar - br), 6) AS fixed_share_within_pp FROM r""")
def _(t):
    e = t.events.select("event_type", F.lit(1).alias("d"), fl.as_flag(F.col("value") >= 50).alias("n"), "ts")
    parts = growth.rate_decomposition(e, "event_type", F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"), "n", "d")
    return rounded(parts.select("event_type", "before_rate", "after_rate", "within_pp", "mix_pp", "fixed_share_within_pp"), "before_rate", "after_rate", "within_pp", "mix_pp", "fixed_share_within_pp")


@query("x11_decomposition_check", """SELECT round(100 * (COUNT(*) FILTER (ts >= TIMESTAMP '2024-01-16' AND value >= 50) / COUNT(*) FILTER (ts >= TIMESTAMP '2024-01-16') - COUNT(*) FILTER (ts < TIMESTAMP '2024-01-16' AND value >= 50) / COUNT(*) FILTER (ts < TIMESTAMP '2024-01-16')), 6) AS change_pp,
  0.0::DOUBLE AS symmetric_gap, 0.0::DOUBLE AS alternative_gap FROM events""")
def _(t):
    e = t.events.select("event_type", F.lit(1).alias("d"), fl.as_flag(F.col("value") >= 50).alias("n"), "ts")
    check = growth.decomposition_check(growth.rate_decomposition(e, "event_type", F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"), "n", "d"))
    return check.select(*[(F.round(c, 6) + 0.0).alias(c) for c in check.columns])


@query("x12_volume_rate_bridge", """WITH t AS (SELECT COUNT(*) FILTER (o < '1998') AS b, COUNT(*) FILTER (o >= '1998') AS a, COUNT(*) FILTER (o < '1998' AND late) AS bl, COUNT(*) FILTER (o >= '1998' AND late) AS al FROM (SELECT strftime(o_orderdate, '%Y') AS o, o_totalprice > 300000 AS late FROM orders)),
  s AS (SELECT o_orderpriority, COUNT(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01' AND o_totalprice > 300000) AS before_late, COUNT(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01' AND o_totalprice > 300000) AS current_late FROM orders GROUP BY 1)
  SELECT o_orderpriority, before_late, current_late, round(before_late * a / b, 6) AS expected_at_current_volume, round(current_late - before_late * a / b, 6) AS extra_late, round((a - b) * bl / b, 6) AS volume_extra, al - bl AS total_change FROM s, t""")
def _(t):
    out = growth.volume_rate_bridge(t.orders, "o_orderpriority", F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"), F.col("o_totalprice") > 300000)
    return rounded(out, "expected_at_current_volume", "extra_late", "volume_extra")


@query("x13_event_comparison", """WITH d AS (SELECT CAST(ts AS DATE) AS day, COUNT(*)::DOUBLE AS n FROM events GROUP BY 1)
  SELECT round(AVG(n) FILTER (day < DATE '2024-01-16'), 6) AS mean_before, round(AVG(n) FILTER (day >= DATE '2024-01-16'), 6) AS mean_after, MAX(n) FILTER (day = DATE '2024-01-16') - 5.0::DOUBLE AS adjusted_value,
  AVG(n) FILTER (day >= DATE '2024-01-16') > AVG(n) FILTER (day < DATE '2024-01-16') AS level_up FROM d""")
def _(t):
    daily = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    out = growth.event_comparison(daily, "day", "n", F.lit("2024-01-16").cast("date"), F.lit(5.0))
    return rounded(out.select("mean_before", "mean_after", "adjusted_value", "level_up"), "mean_before", "mean_after")


@query("q25_feed_checks", """WITH f AS (SELECT date_trunc('week', ts)::DATE AS week, event_type AS channel, COUNT(*) AS signups, COUNT(*) FILTER (value >= 20) AS activated, COUNT(*) FILTER (value >= 50 OR value < 5) AS paid FROM events GROUP BY 1, 2)
  SELECT COUNT(*) AS row_count, COUNT(DISTINCT week) AS week_count, COUNT(DISTINCT channel) AS channel_count, 0 AS missing_cells, 0 AS duplicate_keys, COUNT(DISTINCT week) * COUNT(DISTINCT channel) - COUNT(*) AS missing_week_channels,
  0 AS invalid_numeric_cells, COUNT(*) FILTER (paid > activated OR activated > signups) AS funnel_violations, 0 AS non_weekly_gaps FROM f""")
def _(t):
    v = F.col("value")
    feed = t.events.groupBy(F.trunc("ts", "week").alias("week"), F.col("event_type").alias("channel")).agg(F.count("*").alias("signups"), F.count_if(v >= 20).alias("activated"), F.count_if((v >= 50) | (v < 5)).alias("paid"))
    return growth.feed_checks(feed, "week", "channel", ["signups", "activated", "paid"], ["signups", "activated", "paid"])


@query("q28_bridge_check", """WITH d AS (SELECT year(o_orderdate) AS y, CASE o_orderstatus WHEN 'O' THEN 'Activation' WHEN 'F' THEN 'Expansion' ELSE 'Churn' END AS driver, CASE WHEN o_orderstatus = 'P' THEN -COUNT(*) ELSE COUNT(*) END AS change FROM orders GROUP BY year(o_orderdate), o_orderstatus),
  a AS (SELECT y, SUM(change)::BIGINT AS net FROM d GROUP BY 1) SELECT y, net AS after, COALESCE((SELECT COUNT(*) FROM d x WHERE x.y = a.y) = 3, FALSE) AS bridge_valid FROM a""")
def _(t):
    driver = F.expr("CASE o_orderstatus WHEN 'O' THEN 'Activation' WHEN 'F' THEN 'Expansion' ELSE 'Churn' END")
    signed = F.sum(F.when(F.col("o_orderstatus") == "P", -1).otherwise(1))
    moves = t.orders.groupBy(F.year("o_orderdate").cast("bigint").alias("y"), driver.alias("driver")).agg(signed.alias("change"))
    closing = moves.groupBy("y").agg(F.sum("change").alias("change")).select("y", F.lit("After").alias("driver"), "change")
    opening = moves.select("y").distinct().select("y", F.lit("Before").alias("driver"), F.lit(0).cast("bigint").alias("change"))
    return growth.bridge_check(moves.unionByName(closing).unionByName(opening), "y", "driver", "change").select("y", "after", "bridge_valid")


@query("q28_priority_segment", """WITH s AS (SELECT year(o_orderdate) AS y, o_orderpriority AS seg, round(AVG((o_orderstatus = 'F')::INTEGER), 6) AS rate FROM orders GROUP BY 1, 2), m AS (SELECT y, MIN(rate) AS low, COUNT(*) AS segments FROM s GROUP BY 1)
  SELECT m.y, segments, low AS lowest_rate, CASE WHEN COUNT(*) = 1 THEN MIN(seg) END AS priority_segment FROM m JOIN s ON s.y = m.y AND rate = low GROUP BY 1, 2, 3""")
def _(t):
    rate = F.round(F.avg(fl.as_flag(F.col("o_orderstatus") == "F")), 6)
    s = t.orders.groupBy(F.year("o_orderdate").cast("bigint").alias("y"), F.col("o_orderpriority").alias("seg")).agg(rate.alias("rate"))
    return growth.priority_segment(s, "y", "seg", "rate")
