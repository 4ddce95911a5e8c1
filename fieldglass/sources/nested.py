"""Nested source documents flattened to rows with typed schemas; absent members become NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass import schemas
from fieldglass.functions import text, times
from fieldglass.operators.incremental import resolve_duplicates
from fieldglass.operators.ordered import latest_per_key


def parse(df: DataFrame, column: str, schema: str, name: str = "doc") -> DataFrame:
    return df.withColumn(name, F.from_json(column, schema))


def schedule_games(documents: DataFrame, column: str = "payload") -> DataFrame:
    """One row per scheduled game of every schedule document."""
    days = parse(documents, column, schemas.SCHEDULE).select(F.explode("doc.dates").alias("d"))
    games = days.select(F.col("d.date").alias("schedule_date"), F.posexplode("d.games").alias("position", "g"))
    return games.select(
        "schedule_date", "position", F.col("g.gamePk").alias("game_pk"), F.col("g.gameType").alias("game_type"), F.col("g.officialDate").alias("official_date"),
        F.col("g.gameDate").alias("starts_at_utc"), F.col("g.dayNight").alias("day_night"), F.col("g.status.abstractGameState").alias("abstract_state"),
        F.col("g.status.detailedState").alias("game_status"), F.coalesce("g.status.startTimeTBD", F.lit(False)).alias("time_tbd"),
        F.col("g.venue.id").alias("venue_id"), F.col("g.venue.name").alias("venue_name"), F.col("g.weather").alias("weather"), F.col("g.teams").alias("teams"),
    )


def game_context(documents: DataFrame, venues: DataFrame, column: str = "payload") -> DataFrame:
    """Context rows: one per game, the most settled status, with local time and weather flags."""
    games = resolve_duplicates(schedule_games(documents, column).withColumn("__i", F.struct("schedule_date", "position")).drop("teams").withColumn("__n", F.unix_date(F.to_date("schedule_date")) * 1000 + F.col("position")), "game_pk", "abstract_state", "game_status", "__n")
    joined = games.drop("__i", "__n").join(venues.select("venue_id", "time_zone_id", "roof_type"), "venue_id", "left")
    instant = F.to_timestamp("starts_at_utc")
    direction = text.wind_direction(F.col("weather.wind"))
    return joined.withColumns({
        "game_datetime_utc": instant, **times.local_time_fields(instant, F.col("time_zone_id")), "temperature_f": F.col("weather.temp").try_cast("double"),
        "weather_condition": F.col("weather.condition"), "wind_speed_mph": text.wind_speed(F.col("weather.wind")), "wind_direction": direction,
        **text.wind_flags(direction), "indoor_flag": text.indoor_flag(F.col("roof_type"), F.col("weather.condition")),
    }).drop("weather", "position")


def _sides(games: DataFrame) -> DataFrame:
    side = lambda own, other, label: F.struct(F.lit(label).alias("home_away"), F.col(f"teams.{own}").alias("own"), F.col(f"teams.{other}").alias("other"))
    return games.withColumn("s", F.explode(F.array(side("away", "home", "Away"), side("home", "away", "Home")))).select("*", "s.*").drop("s", "teams")


def pitcher_slots(documents: DataFrame, now: Column, column: str = "payload") -> DataFrame:
    """Two rows per upcoming game: each side's probable starter or TBD."""
    start = F.to_timestamp("starts_at_utc")
    open_games = schedule_games(documents, column).filter((F.lower(F.coalesce("abstract_state", F.lit(""))) == "preview") & (start >= now))
    starter = F.col("own.probablePitcher")
    return _sides(open_games).select(
        "game_pk", F.to_date("official_date").alias("game_date"), start.alias("game_datetime_utc"), "home_away", starter["id"].alias("pitcher_id"),
        F.coalesce(starter["fullName"], F.lit("TBD")).alias("pitcher_name"), text.normalize_team(F.col("own.team.abbreviation")).alias("pitcher_team"),
        text.normalize_team(F.col("other.team.abbreviation")).alias("opponent_team"), F.col("other.team.name").alias("opponent_name"), "venue_id", "venue_name",
        F.when(starter["id"].isNotNull(), "Confirmed probable").otherwise("TBD").alias("probable_status"), "game_status",
    )


def hitter_games(documents: DataFrame, now: Column, hands: DataFrame, column: str = "payload") -> DataFrame:
    """Two rows per open regular game with the opposing starter and that starter's hand."""
    c = F.col
    first = latest_per_key(schedule_games(documents, column).filter(c("game_type") == "R"), ["game_pk"], [-F.unix_date(F.to_date("schedule_date")), -c("position")])
    start = F.to_timestamp("starts_at_utc")
    live = first.filter((c("abstract_state") == "Preview") & ~F.coalesce(c("game_status"), F.lit("")).isin("Postponed", "Cancelled", "Suspended") & (c("time_tbd") | (start > now)))
    rows = _sides(live).select(
        "game_pk", F.coalesce("official_date", "schedule_date").alias("game_date"), "starts_at_utc", "time_tbd", c("own.team.id").alias("team_id"),
        text.normalize_team(c("own.team.abbreviation")).alias("team"), text.normalize_team(c("other.team.abbreviation")).alias("opponent"), (c("home_away") == "Home").alias("home"),
        c("other.probablePitcher.id").alias("pitcher_id"), F.coalesce("other.probablePitcher.fullName", F.lit("Unannounced")).alias("pitcher_name"), F.coalesce("venue_name", F.lit("Unknown")).alias("venue"),
    )
    return rows.join(hands.select("pitcher_id", "pitcher_hand"), "pitcher_id", "left").withColumn("pitcher_hand", F.coalesce("pitcher_hand", F.lit("Unknown"))).drop("pitcher_id")


def final_games(documents: DataFrame, column: str = "payload") -> DataFrame:
    done = schedule_games(documents, column).filter(F.col("abstract_state") == "Final")
    return done.select(F.to_date("official_date").alias("official_date"), "game_pk").distinct()


def feed_appearances(documents: DataFrame, column: str = "payload") -> DataFrame:
    """Pitch events per play of every game feed; a plate appearance has at least one."""
    plays = parse(documents, column, schemas.GAME_FEED).select(F.col("doc.gameData.game.pk").alias("game_pk"), F.explode("doc.liveData.plays.allPlays").alias("p"))
    pitches = F.size(F.filter(F.coalesce("p.playEvents", F.array().cast("array<struct<isPitch:boolean,type:string>>")), lambda e: F.coalesce(e["isPitch"], F.lit(False))))
    counted = plays.select("game_pk", F.col("p.about.atBatIndex").alias("at_bat_index"), pitches.cast("bigint").alias("pitches"))
    return counted.filter(F.col("pitches") > 0).withColumn("at_bat_number", (F.col("at_bat_index") + 1).cast("int"))


def feed_problems(appearances: DataFrame) -> DataFrame:
    """Games whose plays lack an index or repeat one: the feed must be refused."""
    return appearances.filter(F.col("pitches") > 0).groupBy("game_pk").agg(
        F.count_if(F.col("at_bat_index").isNull()).alias("missing_index"), (F.count("at_bat_index") - F.count_distinct("at_bat_index")).alias("repeated_index")
    ).filter((F.col("missing_index") > 0) | (F.col("repeated_index") > 0))


def player_stats(documents: DataFrame, column: str = "payload") -> DataFrame:
    """Counting statistics per player; a traded player's aggregate row wins over team rows.

    `problem` names an ambiguous split or impossible counts instead of guessing.
    """
    blocks = parse(documents, column, schemas.PLAYER_STATS).select(F.element_at("doc.stats", 1).alias("b"))
    paged = F.coalesce(F.col("b.totalSplits"), F.size("b.splits")) != F.size("b.splits")
    splits = blocks.withColumn("__paged", paged).select("__paged", F.explode("b.splits").alias("s"))
    names = {"pa": "plateAppearances", "ab": "atBats", "h": "hits", "r": "runs", "hr": "homeRuns", "rbi": "rbi", "sb": "stolenBases", "cs": "caughtStealing", "bb": "baseOnBalls", "k": "strikeOuts", "games": "gamesPlayed"}
    flat = splits.select(
        F.col("s.player.id").alias("batter_id"), F.col("s.player.fullName").alias("batter_name"), F.coalesce("s.position.abbreviation", F.lit("Unknown")).alias("position"),
        F.col("s.team").isNull().alias("__total"), "__paged", *[F.col(f"s.stat.{v}").alias(k) for k, v in names.items()])
    rest = [c for c in flat.columns if c not in ("batter_id", "__total", "__paged")]
    chosen = flat.groupBy("batter_id").agg(
        F.count("*").alias("__n"), F.count_if("__total").alias("__totals"), F.bool_or("__paged").alias("__paged"), F.max_by(F.struct(*rest), F.col("__total").cast("int")).alias("__r")
    ).select("batter_id", "__r.*", "__n", "__totals", "__paged")
    negative = F.least(*[F.col(k) for k in names]) < 0
    problem = (
        F.when(F.col("__paged"), "incomplete_response").when((F.col("__n") > 1) & (F.col("__totals") != 1), "ambiguous_split")
        .when(negative | (F.col("h") > F.col("ab")) | (F.col("ab") > F.col("pa")), "impossible_counts")
    )
    return chosen.withColumn("problem", problem).drop("__n", "__totals", "__paged")


def hourly_forecast(documents: DataFrame, column: str = "payload") -> DataFrame:
    """Parallel hourly arrays of each venue's forecast as rows."""
    fields = ["temperature_2m", "precipitation_probability", "weather_code", "wind_speed_10m", "wind_direction_10m"]
    rows = parse(documents, column, schemas.HOURLY_FORECAST).select("venue_id", "doc.hourly", F.posexplode("doc.hourly.time").alias("i", "time"))
    return rows.select("venue_id", F.to_timestamp("time").alias("forecast_time_utc"), *[F.get(F.col(f"hourly.{f}"), F.col("i")).alias(f) for f in fields])


def rosters(documents: DataFrame, column: str = "payload") -> DataFrame:
    """Active players with team and position; the last document read wins for a player."""
    people = parse(documents, column, schemas.ROSTER).select("team_id", "team", "position_in_feed", F.explode("doc.roster").alias("p"))
    flat = people.select(F.col("p.person.id").alias("batter_id"), "team_id", text.normalize_team(F.col("team")).alias("team"), F.coalesce("p.position.abbreviation", F.lit("Unknown")).alias("position"), "position_in_feed")
    return latest_per_key(flat, ["batter_id"], [F.col("position_in_feed")]).drop("position_in_feed")


def forecast_archive(spark, folder: str) -> DataFrame:
    """All archived predictions with the file each came from."""
    files = spark.read.schema(schemas.FORECAST_ARCHIVE).option("multiLine", True).json(folder).select("*", F.col("_metadata.file_name").alias("archive_file"))
    return files.select(F.explode("predictions").alias("p"), "archive_file").select("p.*", "archive_file")
