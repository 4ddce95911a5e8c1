"""Pregame strikeout forecast: appearances, prior-day state, backtest, intervals, settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions import flags as fl
from fieldglass.functions.rates import count_bounds, count_where, rate_adjustment, smooth
from fieldglass.operators.ordered import latest_per_key, value_positions
from fieldglass.operators.shape import finite
from fieldglass.plans.modeling import Boundaries
from fieldglass.session import cut_lineage, written_table

MODELS = ["league_mean", "recent_starts", "workload_opponent"]
RECENT_STARTS = 5
OPPONENT_DAYS = 30


def starters(fact: DataFrame) -> DataFrame:
    """First pitcher of each team in each game: an aggregate, not a window over the game."""
    return fact.groupBy("game_pk", "pitcher_team").agg(
        F.min_by("pitcher_id", F.struct("at_bat_number", "pitch_number")).alias("first_pitcher")
    )


def appearances(fact: DataFrame, context: DataFrame) -> DataFrame:
    """One row per pitcher and completed game with workload, strikeouts and the starter mark."""
    grouped = fact.groupBy("game_pk", "game_date", "pitcher_id", "pitcher_team").agg(
        F.min("pitcher_name").alias("pitcher_name"),
        F.min("batter_team").alias("opponent_team"),
        F.count("*").alias("pitches"),
        count_where(fl.finished_pa()).alias("batters_faced"),
        count_where(F.col("plate_appearance_event").isin(fl.STRIKEOUTS)).alias("strikeouts"),
    )
    done = context.filter(F.col("game_status").isin(fl.COMPLETED)).select("game_pk", "game_datetime_utc")
    marked = grouped.join(starters(fact), ["game_pk", "pitcher_team"])
    return marked.withColumn("is_starter", F.col("pitcher_id") == F.col("first_pitcher")).drop("first_pitcher").join(done, "game_pk")


def priors(rows: DataFrame, train_end: str) -> DataFrame:
    """League rates of the training period, one row."""
    start = F.col("is_starter")
    train = rows.filter(F.col("game_date") <= F.lit(train_end).cast("date"))
    return train.agg(
        F.avg(F.when(start, F.col("batters_faced"))).alias("start_bf"),
        F.avg(F.when(start, F.col("strikeouts"))).alias("start_k"),
        (F.sum(F.when(start, F.col("strikeouts"))) / F.sum(F.when(start, F.col("batters_faced")))).alias("start_k_rate"),
        (F.sum("strikeouts") / F.sum("batters_faced")).alias("opponent_k_rate"),
    )


def _prior_struct(rows: DataFrame, train_end: str) -> Column:
    return priors(rows, train_end).select(F.struct("*")).scalar()


def start_history(rows: DataFrame) -> DataFrame:
    """State of a pitcher before a day: the last five starts on earlier days.

    Sums over five starts are differences of running sums, read at the day's first start, so
    same-day starts never see each other and no history list is built.
    """
    career = Window.partitionBy("pitcher_id").orderBy("game_date", "game_pk", "pitcher_team")
    through = career.rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.filter("is_starter").select(
        "pitcher_id", "game_date", "game_pk", "pitcher_team",
        F.row_number().over(career).alias("r"),
        F.sum("batters_faced").over(through).alias("cb"),
        F.sum("strikeouts").over(through).alias("ck"),
        F.lag("game_date").over(career).alias("last_start_date"),
        F.col("batters_faced").alias("b"), F.col("strikeouts").alias("k"),
    )
    edge = lambda c: F.coalesce(F.lag(c, RECENT_STARTS + 1).over(career), F.lit(0))
    state = numbered.withColumns({"eb": edge("cb"), "ek": edge("ck")})
    first = F.struct(
        F.least(F.col("r") - 1, F.lit(RECENT_STARTS)).alias("prior_starts"),
        (F.col("cb") - F.col("b") - F.col("eb")).alias("prior_batters_faced"),
        (F.col("ck") - F.col("k") - F.col("ek")).alias("prior_strikeouts"),
        F.col("last_start_date"),
    )
    return state.groupBy("pitcher_id", "game_date").agg(F.min_by(first, "r").alias("s")).select("pitcher_id", "game_date", "s.*")


def opponent_history(rows: DataFrame) -> DataFrame:
    """Opposing-lineup totals over the thirty days before each of its game days."""
    daily = rows.groupBy("opponent_team", "game_date").agg(F.sum("batters_faced").alias("b"), F.sum("strikeouts").alias("k"))
    before = Window.partitionBy("opponent_team").orderBy(F.unix_date("game_date")).rangeBetween(-OPPONENT_DAYS, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return daily.select("opponent_team", "game_date", total("b").alias("opponent_prior_pa"), total("k").alias("opponent_prior_k"))


def expectations(df: DataFrame, prior: Column) -> DataFrame:
    """The three baselines from prior-day state columns and league priors."""
    df = df.withColumn("__p", prior)
    p = F.col("__p")
    starts, bf, ks = F.col("prior_starts"), F.col("prior_batters_faced"), F.col("prior_strikeouts")
    workload = smooth(bf, starts, p["start_bf"], 3)
    rate = smooth(ks, bf, p["start_k_rate"], 50)
    against = smooth(F.col("opponent_prior_k"), F.col("opponent_prior_pa"), p["opponent_k_rate"], 100)
    adjustment = rate_adjustment(against, p["opponent_k_rate"])
    return df.withColumns({
        "expected_batters_faced": workload, "pitcher_k_rate": rate, "opponent_k_rate": against, "opponent_adjustment": adjustment,
        "league_mean": p["start_k"], "recent_starts": smooth(ks, starts, p["start_k"], 3), "workload_opponent": workload * rate * adjustment,
    }).drop("__p")


def chronological_predictions(rows: DataFrame, boundaries: Boundaries) -> DataFrame:
    """Every start of the evaluation period scored from days strictly before it.

    All frames end one day early, which equals scoring a day before observing it.
    """
    period = F.col("game_date").between(F.lit(boundaries.validation_start).cast("date"), F.lit(boundaries.test_end).cast("date"))
    targets = rows.filter(F.col("is_starter") & period).select(
        "game_pk", "pitcher_id", "opponent_team", "game_date", F.col("strikeouts").alias("actual_k")
    )
    joined = targets.join(start_history(rows), ["pitcher_id", "game_date"]).join(opponent_history(rows), ["opponent_team", "game_date"])
    return expectations(joined, _prior_struct(rows, boundaries.train_end))


def error_summary(df: DataFrame, keys: list[str], predicted: str, actual: str, radius: Column) -> DataFrame:
    error = F.col(predicted) - F.col(actual)
    low, high = count_bounds(F.col(predicted), radius)
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"),
        F.avg(F.col(actual).between(low, high).cast("int")).alias("interval_coverage"), F.avg((high - low).cast("double")).alias("mean_interval_width"),
    )


def interval_radius(errors: DataFrame, error: str, nominal: float = 0.8) -> DataFrame:
    """Held-out absolute error at the conformal rank: an observed value, never interpolated."""
    spots = value_positions(errors, [], error).withColumn("__n", errors.agg(F.count(error)).scalar())
    level = F.least(F.lit(1.0), F.ceil((F.col("__n") + 1) * nominal) / F.col("__n"))
    index = F.ceil(level * (F.col("__n") - 1))
    hit = (F.col("below") <= index) & (index < F.col("through"))
    return spots.agg(F.max(F.when(hit, F.col(error))).alias("radius"))


def backtest(predictions: DataFrame, boundaries: Boundaries) -> DataFrame:
    """Selection picks the model, calibration its radius, test reports it: one row per model.

    The cut date is 70% through the distinct validation dates, a calendar-sized table.
    """
    test = F.col("game_date") >= F.lit(boundaries.test_start).cast("date")
    split = cut_lineage(with_backtest_split(predictions, boundaries))  # one row per start, read by every step below
    long = split.unpivot(["game_date", "split", "actual_k"], MODELS, "model", "predicted")
    long = long.withColumn("e", F.abs(F.col("predicted") - F.col("actual_k")))
    selection = long.filter(F.col("split") == "selection").groupBy("model").agg(F.avg("e").alias("selection_mae"))
    place = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))
    best = selection.agg(F.min_by("model", F.struct("selection_mae", place))).scalar()
    tail = long.withColumn("__best", best).filter((F.col("split") == "calibration") & (F.col("model") == F.col("__best")))
    radius = interval_radius(tail, "e").scalar()
    tested = long.filter(test).withColumn("__radius", radius)
    measured = error_summary(tested, ["model", "__radius"], "predicted", "actual_k", F.col("__radius")).withColumnRenamed("__radius", "interval_radius")
    return measured.join(selection, "model").withColumn("__best", best).withColumn("is_selected", F.col("model") == F.col("__best")).drop("__best")


def with_backtest_split(predictions: DataFrame, boundaries: Boundaries) -> DataFrame:
    start = F.lit(boundaries.test_start).cast("date")
    dates = predictions.filter(F.col("game_date") < start).agg(F.array_sort(F.collect_set("game_date"))).scalar()
    out = predictions.withColumn("__dates", dates)
    size = F.size("__dates")
    at = F.greatest(F.lit(1), F.least(size - 1, F.floor(size * 0.7).cast("int")))
    cut = F.try_element_at("__dates", at + 1)
    split = F.when(F.col("game_date") >= start, "test").when(F.col("game_date") >= cut, "calibration").otherwise("selection")
    return out.withColumn("split", split).drop("__dates")


def upcoming(slots: DataFrame, rows: DataFrame, train_end: str, model: str, radius: float, now: Column) -> DataFrame:
    """Forecasts of confirmed future starts, one per game and team, from the latest state.

    Appearances (one row per pitcher and game) and open slots are read by several branches, so they are written once.
    """
    rows = written_table(rows)
    first = latest_per_key(slots, ["game_pk", "pitcher_team"], [-F.unix_micros(F.col("game_datetime_utc").cast("timestamp"))])
    through = rows.agg(F.max("game_date")).scalar()
    open_slots = first.withColumn("feature_data_through", through).filter(
        (F.col("probable_status") == "Confirmed probable") & F.col("pitcher_id").isNotNull()
        & (F.col("game_datetime_utc") > now) & (F.col("game_date") > F.col("feature_data_through"))
    )
    open_slots = written_table(open_slots)
    newest = Window.partitionBy("pitcher_id").orderBy(F.col("game_date").desc(), F.col("game_pk").desc(), F.col("pitcher_team").desc())
    recent = rows.filter("is_starter").withColumn("__k", F.row_number().over(newest)).filter(F.col("__k") <= RECENT_STARTS)
    state = recent.groupBy("pitcher_id").agg(
        F.count("*").alias("prior_starts"), F.sum("batters_faced").alias("prior_batters_faced"),
        F.sum("strikeouts").alias("prior_strikeouts"), F.max("game_date").alias("last_start_date"),
    )
    daily = rows.groupBy("opponent_team", F.col("game_date").alias("__day")).agg(F.sum("batters_faced").alias("b"), F.sum("strikeouts").alias("k"))
    asked = open_slots.select("opponent_team", "game_date").distinct().withColumn(
        "__day", F.explode(F.sequence(F.date_sub("game_date", OPPONENT_DAYS), F.date_sub("game_date", 1)))
    )
    against = asked.join(daily, ["opponent_team", "__day"]).groupBy("opponent_team", "game_date").agg(
        F.sum("b").alias("opponent_prior_pa"), F.sum("k").alias("opponent_prior_k")
    )
    joined = open_slots.join(state, "pitcher_id", "left").join(against, ["opponent_team", "game_date"], "left")
    zeroed = joined.na.fill(0, ["prior_starts", "prior_batters_faced", "prior_strikeouts", "opponent_prior_pa", "opponent_prior_k"])
    scored = expectations(zeroed, _prior_struct(rows, train_end)).withColumn("model", F.lit(model)).withColumn("predicted_k", F.col(model))
    low, high = count_bounds(F.col("predicted_k"), radius)
    return scored.withColumns({
        "lower_k": low, "upper_k": high,
        "sample_status": F.when(F.col("prior_starts") < 3, "Limited starting history").otherwise("At least 3 prior starts"),
    }).drop(*MODELS)


def settle(archive: DataFrame, rows: DataFrame) -> DataFrame:
    """Earliest archived forecast per start against the recorded start.

    A forecast made at or after the actual start is excluded, not scored.
    """
    first = latest_per_key(archive, ["game_pk", "pitcher_id"], [-F.unix_micros(F.col("generated_at_utc").cast("timestamp"))])
    actual = rows.filter("is_starter").select("game_pk", "pitcher_id", F.col("game_datetime_utc").alias("__start"), F.col("strikeouts").alias("__k"))
    played = rows.select("game_pk").distinct().withColumn("__played", F.lit(True))
    joined = first.join(actual, ["game_pk", "pitcher_id"], "left").join(played, "game_pk", "left")
    in_time = F.col("generated_at_utc").cast("timestamp") < F.col("__start").cast("timestamp")
    status = (
        F.when(F.col("__k").isNotNull() & in_time, "observed")
        .when(F.col("__k").isNotNull(), "excluded_after_actual_start")
        .when(F.col("__played").isNull(), "pending")
        .otherwise("did_not_start")
    )
    out = joined.withColumn("outcome_status", status).withColumn("actual_k", F.when(F.col("outcome_status") == "observed", F.col("__k")))
    return out.withColumn("absolute_error", F.abs(F.col("actual_k") - F.col("predicted_k"))).drop("__start", "__k", "__played")


def comparison(radar: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Radar and nearest forecast side by side; either may be missing."""
    base = radar.filter((F.col("window_days") == 14) & (F.col("profile_key") == "roto_balance"))
    nearest = latest_per_key(forecasts, ["pitcher_id"], [-F.unix_micros(F.col("game_datetime_utc").cast("timestamp"))])
    clash = [c for c in nearest.columns if c in base.columns and c != "pitcher_id"]
    for c in clash:
        nearest = nearest.withColumnRenamed(c, f"{c}_forecast")
    out = base.join(nearest, "pitcher_id", "full")
    for c in ("pitcher_name", "pitcher_team"):
        if f"{c}_forecast" in out.columns:
            out = out.withColumn(c, F.coalesce(c, f"{c}_forecast"))
    return out.drop(*[f"{c}_forecast" for c in clash])


def live_monitor(settled: DataFrame) -> DataFrame:
    """Per model version: outcome counts, errors on valid observed rows, bounds on their own denominator."""
    number = lambda c: F.col(c).try_cast("double") if settled.schema[c].dataType.typeName() == "string" else F.col(c).cast("double")
    usable = lambda c: finite(number(c)) & (number(c) >= 0)
    observed = F.col("outcome_status") == "observed"
    valid = observed & usable("predicted_k") & usable("actual_k")
    bounded = valid & usable("lower_k") & usable("upper_k") & (number("upper_k") >= number("lower_k"))
    error = F.when(valid, number("predicted_k") - number("actual_k"))
    inside = number("actual_k").between(number("lower_k"), number("upper_k")).cast("int")
    n = count_where(valid)
    return settled.groupBy("model_version").agg(
        F.count("*").alias("recorded"), n.alias("observed"), count_where(F.col("outcome_status") == "pending").alias("pending"),
        count_where(~F.col("outcome_status").isin("pending", "observed")).alias("excluded"),
        (count_where(observed) - n).alias("invalid_outcomes"), count_where(bounded).alias("interval_rows"),
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"),
        F.avg(F.when(bounded, inside)).alias("interval_coverage"), F.avg(F.when(bounded, number("upper_k") - number("lower_k"))).alias("mean_interval_width"),
        F.when(n == 0, "awaiting_outcomes").when(n < 30, "limited_sample").otherwise("descriptive_only").alias("status"),
    )
