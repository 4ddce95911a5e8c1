from pyspark.sql import functions as F

from fieldglass.plans import gold, silver
from fieldglass.sources import sinks
from tests import fixtures


def fact(spark):
    return silver.fact_pitch(fixtures.raw(spark), fixtures.ranges(spark), silver.pitch_type_dim(spark))


def test_layer_counts(spark):
    f = fact(spark)
    assert fixtures.raw(spark).count() == 12
    assert f.count() == 9
    assert gold.pitch_type_summary(f).count() == 5
    assert gold.count_strategy_summary(f).count() == 9


def test_pitch_type_mart(spark):
    columns = ["pitcher_id", "batter_stand", "pitch_type", "pitch_count", "swing_count", "whiff_count", "out_of_zone_pitch_count", "chase_count", "batted_ball_count", "measured_batted_ball_count"]
    rows = {tuple(r) for r in gold.pitch_type_summary(fact(spark)).select(*columns).collect()}
    assert rows == {
        (10, "R", "FF", 2, 1, 1, 1, 1, 0, 0), (10, "R", "SL", 1, 1, 0, 0, 0, 1, 1), (10, "R", "CH", 3, 2, 0, 2, 1, 1, 0),
        (20, "L", "SI", 2, 1, 1, 1, 1, 0, 0), (20, "L", "XX", 1, 1, 0, 0, 0, 1, 1),
    }


def test_count_mart(spark):
    columns = ["pitcher_id", "batter_stand", "count_state", "pitch_type", "pitch_count", "swing_count", "whiff_count", "out_of_zone_pitch_count", "chase_count"]
    rows = {tuple(r) for r in gold.count_strategy_summary(fact(spark)).select(*columns).collect()}
    assert rows == {
        (10, "R", "First Pitch", "FF", 1, 0, 0, 0, 0), (10, "R", "Pitcher Ahead", "FF", 1, 1, 1, 1, 1), (10, "R", "Two Strikes", "SL", 1, 1, 0, 0, 0),
        (10, "R", "First Pitch", "CH", 1, 0, 0, 1, 0), (10, "R", "Hitter Ahead", "CH", 1, 1, 0, 1, 1), (10, "R", "Even", "CH", 1, 1, 0, 0, 0),
        (20, "L", "First Pitch", "SI", 1, 0, 0, 0, 0), (20, "L", "Pitcher Ahead", "SI", 1, 1, 1, 1, 1), (20, "L", "Two Strikes", "XX", 1, 1, 0, 0, 0),
    }


def test_latest_load_wins_and_unknown_stays_unknown(spark):
    rows = {r.pitch_id: r for r in fact(spark).collect()}
    assert rows["1001-1-3"].release_speed == 87.0 and rows["1001-1-3"].hard_hit_flag == 1
    assert rows["1001-2-3"].hard_hit_flag is None and rows["1001-2-2"].hard_hit_flag == 0
    assert rows["1002-1-3"].pitch_name == "Mystery Pitch" and rows["1002-1-3"].pitch_family == "Other"
    assert rows["1001-1-1"].pitcher_team == "HOM" and rows["1002-1-1"].pitcher_team == "AWY"


def test_partitioning_does_not_matter(spark):
    sign = lambda n: sinks.content_signature(gold.count_strategy_summary(
        silver.fact_pitch(fixtures.raw(spark).repartition(n), fixtures.ranges(spark), silver.pitch_type_dim(spark)))).collect()[0]
    assert sign(1) == sign(17)


def test_benchmark_fixture(spark):
    facts = spark.sql("""SELECT * FROM VALUES (1, date'2026-08-01', 10, 'FF', 1, 0, 95D), (1, date'2026-08-01', 10, 'SL', 1, 1, 86D), (2, date'2026-09-01', 11, 'FF', 0, 0, 94D), (2, date'2026-09-01', 11, 'CH', 1, 1, 88D)
      t(game_pk, game_date, pitcher_id, pitch_type, swing_flag, whiff_flag, release_speed)""")
    games = spark.sql("SELECT * FROM VALUES (1, 100, 'day'), (2, 200, 'night') t(game_pk, venue_id, day_night)")
    assert gold.benchmark_scan(facts).count() == 4
    assert {r.pitcher_id for r in gold.benchmark_recent(facts, 30).collect()} == {11}
    joined = {(r.venue_id, r.pitch_type): r.whiff_count for r in gold.benchmark_context_join(facts, games).collect()}
    assert joined == {(100, "FF"): 0, (100, "SL"): 1, (200, "FF"): 0, (200, "CH"): 1}
    assert {r.rolling_10_date_whiff_count for r in gold.benchmark_window(facts).select(F.col("rolling_10_date_whiff_count")).collect()} == {1}
