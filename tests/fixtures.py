"""Small inputs with known answers."""

COLUMNS = (
    "pitch_type string, pitch_name string, game_date string, game_year bigint, game_pk bigint, at_bat_number bigint, pitch_number bigint, "
    "inning bigint, inning_topbot string, pitcher bigint, player_name string, batter bigint, stand string, p_throws string, home_team string, "
    "away_team string, balls bigint, strikes bigint, description string, events string, zone bigint, release_speed double, launch_speed double, "
    "estimated_woba_using_speedangle double, game_type string, loaded_at_utc string"
)


def _row(kind, day, game, ab, n, half, pitcher, batter, stand, balls, strikes, what, event, zone, speed, launch=None, xwoba=None, gtype="R", loaded="2025-04-04T12"):
    return (kind, "Mystery Pitch" if kind == "XX" else kind, day, 2025, game, ab, n, 1, half, pitcher, f"P{pitcher}", batter, stand, "R", "HOM", "AWY", balls, strikes, what, event, zone, speed, launch, xwoba, gtype, loaded)


RAW = [
    _row("FF", "2025-04-01", 1001, 1, 1, "Top", 10, 101, "R", 0, 0, "called_strike", None, 5, 95.0),
    _row("FF", "2025-04-01", 1001, 1, 2, "Top", 10, 101, "R", 0, 1, "swinging_strike", None, 11, 96.0),
    _row("SL", "2025-04-01", 1001, 1, 3, "Top", 10, 101, "R", 0, 2, "hit_into_play", "single", 8, 87.0, 98.0, 0.61),
    _row("SL", "2025-04-01", 1001, 1, 3, "Top", 10, 101, "R", 0, 2, "hit_into_play", "field_out", 8, 86.0, 80.0, 0.15, loaded="2025-04-04T11"),
    _row("CH", "2025-04-01", 1001, 2, 1, "Top", 10, 102, "R", 0, 0, "ball", None, 12, 86.0),
    _row("CH", "2025-04-01", 1001, 2, 2, "Top", 10, 102, "R", 1, 0, "foul", None, 12, 87.0),
    _row("CH", "2025-04-01", 1001, 2, 3, "Top", 10, 102, "R", 1, 1, "hit_into_play", "field_out", 5, 88.0, None, 0.18),
    _row("SI", "2025-04-02", 1002, 1, 1, "Bot", 20, 201, "L", 0, 0, "called_strike", None, 1, 94.0),
    _row("SI", "2025-04-02", 1002, 1, 2, "Bot", 20, 201, "L", 0, 1, "swinging_strike", None, 14, 95.0),
    _row("XX", "2025-04-02", 1002, 1, 3, "Bot", 20, 201, "L", 0, 2, "hit_into_play", "field_out", 8, 82.0, 90.0, 0.22),
    _row("FF", "2025-04-02", 2001, 1, 1, "Top", 30, 301, "R", 0, 0, "called_strike", None, 5, 93.0, gtype="S"),
    _row("FF", "2025-04-10", 2002, 1, 1, "Top", 40, 401, "R", 0, 0, "called_strike", None, 5, 93.0, loaded="2025-04-11T12"),
]


def raw(spark):
    return spark.createDataFrame(RAW, COLUMNS)


def ranges(spark):
    return spark.sql("SELECT 2025 AS season, date'2025-04-01' AS start_date, date'2025-04-03' AS end_date")
