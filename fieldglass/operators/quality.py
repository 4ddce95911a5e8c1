"""Boolean checks evaluated in one pass per table, and drift, freshness and volume rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import flags as fl
from fieldglass.functions.rates import count_where
from fieldglass.operators.ranges import in_ranges, outside_ranges

RESULT = ["check_name", "status", "observed", "expected"]


def check_table(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Evaluate boolean aggregates over one scan; NULL counts as a failure."""
    wide = df.agg(*[c.cast("string").alias(n) for n, c in checks.items()])
    long = wide.unpivot([], list(checks), "check_name", "observed")
    passed = F.coalesce(F.col("observed") == "true", F.lit(False))
    return long.select("check_name", F.when(passed, "PASS").otherwise("FAIL").alias("status"), F.coalesce("observed", F.lit("None")).alias("observed"), F.lit("true").alias("expected"))


def no_rows(df: DataFrame, name: str) -> DataFrame:
    """Passes when a violation query returns nothing."""
    return check_table(df, {name: F.count("*") == 0})


def all_checks(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def never(condition: Column) -> Column:
    return count_where(condition) == 0


def fact_checks(fact: DataFrame) -> DataFrame:
    """Key, domain, subset and label rules of the pitch fact in a single aggregate."""
    c = F.col
    play, measured = c("batted_ball_flag") == 1, c("launch_speed").isNotNull()
    return check_table(fact, {
        "fact_has_rows": F.count("*") > 0,
        "pitch_id_is_unique": F.count("*") == F.count_distinct("pitch_id"),
        "required_ids_not_null": never(c("game_pk").isNull() | c("pitcher_id").isNull() | c("batter_id").isNull()),
        "count_values_valid": never(~c("balls").between(0, 3) | ~c("strikes").between(0, 2)),
        "whiffs_do_not_exceed_swings": F.sum("whiff_flag") <= F.sum("swing_flag"),
        "chases_do_not_exceed_out_of_zone_pitches": F.sum("chase_flag") <= F.sum(fl.out_of_zone()),
        "hard_hits_do_not_exceed_batted_balls": F.sum("hard_hit_flag") <= F.sum("batted_ball_flag"),
        "velocity_range_reasonable": never(c("release_speed").isNotNull() & ~c("release_speed").between(20, 110)),
        "missing_exit_velocity_is_unknown": never(play & ~measured & c("hard_hit_flag").isNotNull()),
        "measured_hard_hit_labels_match_threshold": never(
            play & measured & ~c("hard_hit_flag").eqNullSafe(fl.as_flag(c("launch_speed") >= fl.HARD_HIT_SPEED))
        ),
    })


def coverage_checks(df: DataFrame, minimums: dict[str, float]) -> DataFrame:
    """One check per column: its share of known values reaches the minimum.  An empty table fails."""
    share = lambda name: F.count(name) / F.nullif(F.count("*"), F.lit(0))
    return check_table(df, {f"{name}_coverage_at_least_{100 * least:g}_percent": share(name) >= F.lit(least) for name, least in minimums.items()})


def scope_checks(fact: DataFrame, ranges: DataFrame) -> DataFrame:
    seasons = ranges.select("season").distinct()
    return all_checks([
        no_rows(fact.join(seasons, "season", "left_anti"), "configured_seasons_applied"),
        no_rows(outside_ranges(fact, ranges, F.col("game_date"), F.col("season")), "configured_date_range_applied"),
    ])


def context_checks(fact: DataFrame, context: DataFrame, ranges: DataFrame) -> DataFrame:
    """Uniqueness, coverage and agreement of games with their pitches."""
    games = fact.groupBy("game_pk").agg(F.min("game_date").alias("lo"), F.max("game_date").alias("hi"))
    known = context.select("game_pk", "official_date").withColumn("__known", F.lit(True))
    joined = games.join(known, "game_pk", "left")
    dates_agree = F.coalesce((F.col("lo") == F.col("official_date")) & (F.col("hi") == F.col("official_date")), F.lit(True))
    done = in_ranges(context.filter(F.col("game_status").isin(fl.COMPLETED)), ranges, F.col("official_date"))
    return all_checks([
        check_table(context, {"context_game_is_unique": F.count("*") == F.count_distinct("game_pk")}),
        check_table(joined, {
            "every_pitch_game_has_context": never(F.col("__known").isNull()), "context_dates_match_pitch_dates": never(~dates_agree),
        }),
        no_rows(done.join(games, "game_pk", "left_anti"), "completed_regular_games_have_pitches"),
    ])


def row_count_checks(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Equal row counts of two tables, counted where they live."""
    parts = []
    for name, (a, b) in pairs.items():
        counted = a.agg(F.count("*").alias("a")).withColumn("b", b.agg(F.count("*")).scalar())
        parts.append(check_table(counted, {name: F.max("a") == F.max("b")}))
    return all_checks(parts)


def history_checks(mart: DataFrame, target: str, entities: dict[str, tuple[list[str], int, list[str], list[str]]]) -> DataFrame:
    """Rules of a training mart: binary target, bounded counts, probability rates, no history before a first game,
    and one shared snapshot per entity-game.

    `entities`: name -> (keys, row frame, count columns, rate columns); the first count column is the row frame.
    """
    rules: dict[str, Column] = {"target_is_binary": never(F.col(target).isNull() | ~F.col(target).isin(0, 1))}
    for name, (_, rows, counts, rates) in entities.items():
        rules[f"{name}_row_count_bounded"] = never(~F.col(counts[0]).between(0, rows))
        for c in counts[1:]:
            rules[f"{c}_non_negative"] = never(F.col(c) < 0)
        for r in rates:
            rules[f"{r}_is_probability"] = never(F.col(r).isNotNull() & ~F.col(r).between(0, 1))
    parts = [check_table(mart, rules)]
    for name, (keys, _, counts, rates) in entities.items():
        columns = [*counts, *rates]
        per_game = mart.groupBy(*keys, "game_pk", "game_datetime_utc").agg(
            *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns], *[F.count(c).alias(f"n_{c}") for c in columns], F.count("*").alias("n")
        )
        same = reduce(lambda a, b: a & b, [
            (F.col(f"lo_{c}").eqNullSafe(F.col(f"hi_{c}"))) & ((F.col(f"n_{c}") == 0) | (F.col(f"n_{c}") == F.col("n"))) for c in columns])
        # Both rules come from one pass over the entity-games.
        first = per_game.groupBy(*keys).agg(
            F.count_if(~same).alias("changed"),
            F.min_by(F.struct(*[F.col(f"hi_{c}").alias(c) for c in counts], *[F.col(f"hi_{r}").alias(r) for r in rates]), F.struct("game_datetime_utc", "game_pk")).alias("f")
        )
        zero = reduce(lambda a, b: a & b, [*[F.col(f"f.{c}") == 0 for c in counts], *[F.col(f"f.{r}").isNull() for r in rates]])
        parts.append(check_table(first, {
            f"{name}_history_constant_in_game": never(F.col("changed") > 0), f"{name}_first_game_has_no_history": never(~zero),
        }))
    return all_checks(parts)


def grain_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def rates_bounded(df: DataFrame, rates: list[str]) -> DataFrame:
    """Violations per rate column, all columns in one pass."""
    wide = df.agg(*[count_where(~F.col(r).between(0, 1)).alias(r) for r in rates])
    return wide.unpivot([], rates, "rate", "violations")


def accepted_values(df: DataFrame, rules: dict[str, list]) -> DataFrame:
    wide = df.agg(*[count_where(F.col(c).isNull() | ~F.col(c).isin(values)).alias(c) for c, values in rules.items()])
    return wide.unpivot([], list(rules), "column", "violations")


def row_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """CHECK-style rules as violation counts; an unknown outcome does not violate."""
    wide = df.agg(*[count_where(~rule).alias(name) for name, rule in rules.items()])
    return wide.unpivot([], list(rules), "rule", "violations")


# ---- observation history -----------------------------------------------------------------

def schema_fingerprint(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def schema_drift(df: DataFrame, baseline: list[tuple[str, str]] | None) -> str:
    """Ordered names and types against the first passing observation."""
    if baseline is None:
        return "bootstrap"
    return "pass" if schema_fingerprint(df) == [tuple(b) for b in baseline] else "error"


def freshness(df: DataFrame, day: str, expected: Column, grace_days: int) -> DataFrame:
    row = df.agg(F.count("*").alias("rows"), F.max(day).alias("data_through")).withColumn("expected_through", expected)
    lag = F.datediff("expected_through", "data_through")
    invalid = F.col("data_through").isNull() | (F.col("data_through") > F.col("expected_through")) | (F.col("rows") == 0)
    return row.withColumns({"lag_days": lag, "status": F.when(invalid, "error").when(lag > grace_days, "attention").otherwise("pass")})


def row_volume(df: DataFrame, history: DataFrame, low: float = 0.90, high: float = 1.50) -> DataFrame:
    """Row count against the latest passing observation in `history(run, status, rows)`."""
    previous = history.filter(F.col("status") == "pass").agg(F.max_by("rows", "run")).scalar()
    row = df.agg(F.count("*").alias("rows")).withColumn("previous_rows", previous)
    ratio = F.col("rows") / F.col("previous_rows")
    return row.withColumns({"ratio": ratio, "status": F.when(F.col("previous_rows").isNull(), "bootstrap").when(ratio.between(low, high), "pass").otherwise("error")})


def overall_status(checks: DataFrame, status: str = "status") -> DataFrame:
    """Error outranks attention, attention outranks pass."""
    rank = F.max(F.when(F.col(status) == "error", 2).when(F.col(status) == "attention", 1).otherwise(0))
    return checks.agg(rank.alias("exit_code")).withColumn("status", F.when(F.col("exit_code") == 2, "error").when(F.col("exit_code") == 1, "attention").otherwise("pass"))


def recent_partition(fact: DataFrame, context: DataFrame, ranges: DataFrame, today: Column, lookback: int = 14, minimum: int = 7, low: float = 0.65, high: float = 1.35) -> DataFrame:
    """Completeness of the latest game date against earlier completed dates: one row.

    Order of verdicts: missing coverage, then unsettled games, then a thin baseline, then
    volume.  Only lookback+1 dates survive to the comparison.
    """
    c = F.col
    candidates = in_ranges(context.filter(c("official_date") < today), ranges, c("official_date")).select("game_pk", c("official_date").alias("game_date"), "game_status").distinct()
    unsettled = c("game_status").isNull() | ~c("game_status").isin(*fl.COMPLETED, "Postponed")
    games = candidates.groupBy("game_date", "game_pk").agg(F.bool_or(c("game_status").isin(fl.COMPLETED)).alias("done"), F.bool_or(unsettled).alias("open"))
    pitches = fact.groupBy("game_pk", "game_date").agg(F.count("*").alias("n"))
    counted = games.join(pitches, ["game_pk", "game_date"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    done = F.coalesce(c("done"), F.lit(False))
    dates = counted.groupBy("game_date").agg(
        count_where(done).alias("completed_games"), count_where(done & (c("n") > 0)).alias("pitch_games"), F.coalesce(F.sum(F.when(done, c("n"))), F.lit(0)).alias("pitch_rows"),
        F.min(F.when(done, c("n"))).alias("minimum_game_pitch_rows"), count_where(c("open")).alias("unsettled_games"),
    ).filter((c("completed_games") > 0) | (c("unsettled_games") > 0))
    recent = dates.orderBy(c("game_date").desc()).limit(lookback + 1)
    latest = recent.agg(F.max_by(F.struct(*[k for k in dates.columns]), "game_date").alias("l"))
    usable = (c("completed_games") > 0) & (c("pitch_games") == c("completed_games")) & (c("unsettled_games") == 0)
    rates = recent.join(latest.select(c("l.game_date").alias("__d")), c("game_date") < c("__d")).filter(usable)
    base = rates.agg(F.count("*").alias("n"), F.median(c("pitch_rows") / c("completed_games")).alias("m")).select(F.struct("*")).scalar()
    row = latest.select("l.*").withColumn("__b", base)
    rate = c("pitch_rows") / F.nullif(c("completed_games"), F.lit(0))
    row = row.withColumns({"eligible_baseline_dates": c("__b.n"), "baseline_median": c("__b.m"), "ratio": rate / F.nullif(c("__b.m"), F.lit(0.0)), "minimum_game_ratio": c("minimum_game_pitch_rows") / F.nullif(c("__b.m"), F.lit(0.0))}).drop("__b")
    healthy = F.coalesce(c("ratio").between(low, high) & (c("minimum_game_ratio") >= low), F.lit(False))
    assessment = (
        F.when(c("game_date").isNull(), "no_completed_dates").when(c("pitch_games") != c("completed_games"), "missing_coverage").when(c("unsettled_games") > 0, "unknown_unsettled_date")
        .when(c("eligible_baseline_dates") < minimum, "unknown_insufficient_baseline").when(healthy, "complete").otherwise("volume_anomaly")
    )
    row = row.withColumn("assessment", assessment)
    status = F.when(c("assessment") == "no_completed_dates", "bootstrap").when(c("assessment") == "missing_coverage", "error").when(c("assessment") == "complete", "pass").otherwise("attention")
    return row.withColumn("status", status)
