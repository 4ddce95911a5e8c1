import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import incremental, quality
from fieldglass.plans import audit, forecast, gold, history, hitters, modeling
from fieldglass.plans.modeling import Boundaries


def _features(spark, rows):
    """(game, at-bat, pitch, pitcher, batter, type, label, day) swings; a game starts at noon."""
    df = spark.createDataFrame(rows, "game_pk long, at_bat_number int, pitch_number int, pitcher_id long, batter_id long, pitch_type string, whiff_flag int, day int")
    return df.withColumns({
        "pitch_id": F.concat_ws("-", "game_pk", "at_bat_number", "pitch_number"), "swing_flag": F.lit(1), "batted_ball_flag": F.lit(0), "hard_hit_flag": F.lit(None).cast("int"),
        "game_datetime_utc": F.timestamp_seconds(F.col("day") * 86400 + 43200),
    })


ROWS = [(g, a, n, 1 + (g + n) % 2, 5 + a, "FF" if n % 2 else "SL", (g + a + n) % 2, g) for g in range(1, 9) for a in (1, 2) for n in (1, 2, 3)]


def test_history_ignores_the_current_game_and_the_future(spark):
    mart = history.pregame_training(_features(spark, ROWS), history.WHIFF)
    names = [c for c in mart.columns if "_prior_" in c]
    before = {r.pitch_id: tuple(r[c] for c in names) for r in mart.collect()}
    flipped = [(*r[:6], 1 - r[6], r[7]) if r[0] >= 5 else r for r in ROWS]
    after = {r.pitch_id: tuple(r[c] for c in names) for r in history.pregame_training(_features(spark, flipped), history.WHIFF).collect()}
    same = [k for k in before if int(k.split("-")[0]) <= 5]
    assert len(same) == 30 and all(before[k] == after[k] for k in same)
    assert any(before[k] != after[k] for k in before)


def test_history_is_one_snapshot_per_entity_game(spark):
    mart = history.pregame_training(_features(spark, ROWS), history.WHIFF)
    per = mart.groupBy("game_pk", "pitcher_id").agg(F.count_distinct("pitcher_swings_prior_200").alias("n"), F.min("pitcher_swings_prior_200").alias("lo")).collect()
    assert all(r.n == 1 for r in per) and all(r.lo == 0 for r in per if r.game_pk == 1)
    assert mart.count() == len(ROWS)


def test_short_frame_cuts_inside_an_older_game(spark):
    entity = history.Entity("pitcher", ["pitcher_id"], 4, [])
    rows = [(1, 1, n, 1, 5, "FF", y, 1) for n, y in enumerate([1, 1, 0, 0, 1], 1)] + [(2, 1, 1, 1, 5, "FF", 0, 2)]
    out = {r.game_pk: r for r in history.entity_history(_features(spark, rows), entity, "whiff_flag", history.WHIFF).collect()}
    assert out[1].pitcher_swings_prior_4 == 0 and out[1].pitcher_whiff_rate_prior_4_swings is None
    assert out[2].pitcher_swings_prior_4 == 4 and out[2].pitcher_whiff_rate_prior_4_swings == 0.5


def test_feature_contract():
    with pytest.raises(ValueError):
        modeling.check_features(["release_speed", "launch_speed"])
    with pytest.raises(ValueError):
        modeling.check_features(["release_speed", "release_speed"])
    with pytest.raises(ValueError):
        Boundaries("2025-02-01", "2025-01-01", "2025-03-01", "2025-04-01").check()
    assert not set(gold.OUTCOME_COLUMNS) & {"swing_flag", "whiff_flag"}


def test_evaluation_against_hand_values(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.4), (1, 0.4), (0, 0.1)], "y int, p double")
    m = modeling.evaluate(df, [], "y", "p").collect()[0]
    assert abs(m.roc_auc - 0.875) < 1e-12
    assert abs(m.average_precision - (0.5 * 1 + 0.5 * 2 / 3)) < 1e-12
    assert abs(m.log_loss - -(math.log(0.9) + math.log(0.6) + math.log(0.4) + math.log(0.9)) / 4) < 1e-12
    edges = spark.createDataFrame([(0.0,), (0.1,), (0.10001,), (0.3,), (1.0,)], "p double").select(modeling.probability_bin(F.col("p")).alias("b"))
    assert [r.b for r in edges.collect()] == [0, 0, 1, 2, 9]


HITTER = "game_pk long, game_date date, at_bat_number int, pitch_number int, batter_id long, batter_team string, home_team string, away_team string, p_throws string, events string, description string, zone int, launch_speed double, launch_speed_angle int, xba double, xwoba double"


def _pitch(ab, event, what, zone, launch=None, kind=None, xba=None, xwoba=None, game=1):
    return (game, dt.date(2026, 9, 1), ab, 1, 7, "A", "A", "B", "R", event, what, zone, launch, kind, xba, xwoba)


def test_contact_keeps_unknown_apart_from_zero(spark):
    rows = [_pitch(1, "single", "hit_into_play", 5, 100.0, 6, 0.6, 0.7), _pitch(2, "field_out", "hit_into_play", 5), _pitch(3, "strikeout", "swinging_strike", None), _pitch(4, "intent_walk", "ball", 5)]
    m = hitters.contact_metrics(spark.createDataFrame(rows, HITTER)).collect()[0]
    assert (m.statcast_pa, m.measured_bbe, m.hard_hit, m.barrel, m.statcast_ab, m.covered_ab) == (4, 1, 1.0, 1.0, 3, 2)
    assert m.covered_avg == 0.5 and abs(m.covered_xba - 0.3) < 1e-12 and abs(m.coverage - 2 / 3) < 1e-12 and m.chase is None


def test_pace_counts_recent_once(spark):
    zeros = {c: 0 for c in hitters.COUNTS}
    frame = lambda **k: spark.createDataFrame([{**zeros, "batter_id": 1, **k}])
    league = F.struct(*[F.lit(0.1).alias(k) for k in hitters.RATE_KEYS])
    r = hitters.pace_rates(frame(pa=200, ab=180, hr=10), frame(pa=100, ab=90, hr=10), league).collect()[0]
    assert abs(r.pace_hr - (10 + 100 * (0 + 200 * 0.1) / (100 + 200)) / 200) < 1e-12 and r.reconciles
    assert not hitters.pace_rates(frame(pa=50, ab=40), frame(pa=100, ab=90), league).collect()[0].reconciles


def test_bench_days_count(spark):
    rows = [_pitch(1, "single", "hit_into_play", 5, game=1), (2, dt.date(2026, 9, 2), 1, 1, 8, "A", "A", "B", "R", "walk", "ball", 5, None, None, None, None)]
    players, _ = hitters.usage(spark.createDataFrame(rows, HITTER), F.lit("2026-09-02").cast("date"))
    assert players.filter("batter_id = 7").collect()[0].pa_per_team_game_7 == 0.5


def test_live_monitor(spark):
    inf = float("inf")
    rows = [("a", "observed", 5.0, 3.0, 2.0, 6.0), ("a", "observed", 4.0, 8.0, None, None), ("a", "did_not_start", 4.0, None, 1.0, 5.0), ("a", "observed", 4.0, inf, 1.0, 5.0), ("b", "observed", 3.0, 3.0, 1.0, 5.0)]
    out = {r.model_version: r for r in forecast.live_monitor(spark.createDataFrame(rows, "model_version string, outcome_status string, predicted_k double, actual_k double, lower_k double, upper_k double")).collect()}
    a, b = out["a"], out["b"]
    assert (a.observed, a.mae, a.bias, a.interval_rows, a.interval_coverage, a.excluded, a.invalid_outcomes) == (2, 3, -1, 1, 1, 1, 1)
    assert b.mae == 0 and b.status == "limited_sample"


APPEARANCE = "game_pk long, game_date date, pitcher_id long, pitcher_name string, pitcher_team string, opponent_team string, is_starter boolean, batters_faced int, strikeouts int, pitches int, game_datetime_utc timestamp"


def _starts(change=None):
    rows = []
    for i in range(8):
        for p in (1, 2):
            day = dt.date(2026, 3, 20) + dt.timedelta(days=5 * i)
            k = 3 + i % 3 + p + (change if change and i >= 5 else 0)
            rows.append((100 * i + p, day, p, f"P{p}", f"T{p}", f"T{3 - p}", True, 20, k, 90, dt.datetime(day.year, day.month, day.day, 18)))
    return rows


def test_forecast_uses_earlier_days_only(spark):
    bounds = Boundaries("2026-03-25", "2026-03-26", "2026-04-15", "2026-05-01")
    run = lambda c: {(r.pitcher_id, r.game_date): (r.prior_starts, r.recent_starts, r.workload_opponent) for r in forecast.chronological_predictions(spark.createDataFrame(_starts(c), APPEARANCE), bounds).collect()}
    a, b = run(None), run(4)
    cut = dt.date(2026, 3, 20) + dt.timedelta(days=25)
    assert all(a[k] == b[k] for k in a if k[1] <= cut) and any(a[k] != b[k] for k in a)
    assert max(v[0] for v in a.values()) == 5


GAMES = "game_pk long, official_date date, game_status string"


@pytest.mark.parametrize("extra, counts, expected", [
    ([], {1001: 300, 2001: 300}, "pass"), ([(2002, "In Progress")], {1001: 300, 2001: 300, 2002: 50}, "attention"), ([(2002, "In Progress")], {1001: 300, 2002: 50}, "error"), ([], {1001: 300, 2001: 100}, "attention"),
])
def test_recent_partition_verdicts(spark, extra, counts, expected):
    d1, d2 = dt.date(2025, 4, 1), dt.date(2025, 4, 2)
    games = [(1001, d1, "Final"), (2001, d2, "Final")] + [(g, d2, s) for g, s in extra]
    pitches = [(g, d1 if g == 1001 else d2) for g, n in counts.items() for _ in range(n)]
    ranges = spark.sql("SELECT 2025 AS season, date'2025-04-01' AS start_date, date'2025-04-03' AS end_date")
    row = quality.recent_partition(spark.createDataFrame(pitches, "game_pk long, game_date date"), spark.createDataFrame(games, GAMES), ranges, F.lit("2025-04-03").cast("date"), minimum=1).collect()[0]
    assert row.status == expected


def test_reconciliation_classes(spark):
    d1, d2 = dt.date(2025, 4, 2), dt.date(2025, 4, 1)
    official = spark.createDataFrame([(d1, 2001), (d1, 2002)], "official_date date, game_pk long")
    counts = spark.createDataFrame([(d1, 2001, 1, 2), (d1, 2001, 2, 1), (d1, 2002, 1, 3)], "official_date date, game_pk long, at_bat_number int, pitches long")
    context = spark.createDataFrame([(2001, d1, "Final"), (2002, d2, "Final")], GAMES)
    fact = spark.createDataFrame([(2001, d1, 1), (2001, d1, 1), (2001, d1, 3), (2002, d2, 1)], "game_pk long, game_date date, at_bat_number int")
    games, pas = audit.game_grain(official, context, fact), audit.appearance_grain(official, counts, fact)
    found = {(str(r.official_date), r.mismatch, r.game_pk, r.at_bat_number, r.other_dates) for r in audit.mismatches(games, pas, context, fact).collect()}
    assert ("2025-04-02", "missing_context_games", 2002, None, None) in found
    assert ("2025-04-02", "context_games_on_other_dates", 2002, None, "2025-04-01") in found
    assert ("2025-04-02", "missing_plate_appearances", 2001, 2, None) in found
    assert ("2025-04-02", "unexpected_plate_appearances", 2001, 3, None) in found
    assert ("2025-04-01", "unexpected_pitch_games", 2002, None, None) in found


def test_date_chunks():
    days = list(incremental.date_chunks(dt.date(2025, 4, 1), dt.date(2025, 4, 8), 3))
    assert days == [(dt.date(2025, 4, 1), dt.date(2025, 4, 3)), (dt.date(2025, 4, 4), dt.date(2025, 4, 6)), (dt.date(2025, 4, 7), dt.date(2025, 4, 8))]
    with pytest.raises(ValueError):
        list(incremental.date_chunks(dt.date(2025, 4, 2), dt.date(2025, 4, 1), 3))


def test_histories_of_all_kinds_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    rows, instants = [], {}
    for game in range(1, 60):
        instants[game] = int(rng.integers(0, 60))
        for a in range(int(rng.integers(1, 9))):
            for n in range(int(rng.integers(1, 4))):
                rows.append((game, a, n, int(rng.integers(1, 4)), int(rng.integers(5, 8)), [None, "FF", "SL"][int(rng.integers(0, 3))], int(rng.integers(0, 2)), instants[game]))
    kinds = [history.Entity("pitcher", ["pitcher_id"], 7, [14, 30]), history.Entity("batter_pitch_type", ["batter_id", "pitch_type"], 3, [30]), history.Entity("matchup", ["pitcher_id", "batter_id"], 4)]
    frame = _features(spark, rows)
    mart = {r.pitch_id: r for r in history.pregame_training(frame, history.WHIFF, kinds).collect()}
    events = sorted(frame.collect(), key=lambda r: (r.game_datetime_utc, r.game_pk, r.at_bat_number, r.pitch_number, r.pitch_id))
    assert set(mart) == {r.pitch_id for r in events if r.pitch_type is not None} and len(mart) < len(events)
    for r in mart.values():
        for e in kinds:
            mine = [x for x in events if all(x[k] == r[k] for k in e.keys)]
            earlier = [x for x in mine if (x.game_datetime_utc, x.game_pk) < (r.game_datetime_utc, r.game_pk)][-e.rows:]
            frames = {str(e.rows): earlier}
            for days in e.days:
                frames[f"{days}d"] = [x for x in mine if dt.timedelta(0) < r.game_datetime_utc - x.game_datetime_utc <= dt.timedelta(days=days)]
            for name, found in frames.items():
                assert r[history.WHIFF.count_name(e, name)] == len(found), (e.name, name)
                rate = r[history.WHIFF.rate_name(e, name)]
                assert rate is None if not found else abs(rate - sum(x.whiff_flag for x in found) / len(found)) < 1e-12


def test_training_broadcasts_no_frame_that_grows_with_the_events(spark):
    frame = _features(spark, ROWS).withColumns({"batted_ball_flag": F.lit(1), "hard_hit_flag": F.col("whiff_flag")})
    mart = history.pregame_training(frame, history.HARD_HIT)
    found = {r.pitch_id: r for r in mart.collect()}
    assert len(found) == len(ROWS) and found["8-2-3"].batter_batted_balls_prior_50 == 21 and found["1-1-1"].batter_batted_balls_prior_50 == 0
    planned = mart._jdf.queryExecution().executedPlan().toString()
    assert planned.count("SortMergeJoin") >= 5 and "Broadcast" not in planned
