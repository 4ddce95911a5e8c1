"""Source-to-target reconciliation at game and plate-appearance grain, all dates at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import flags as fl
from fieldglass.functions.rates import count_where

CLASSES = [
    "missing_context_games", "unexpected_completed_context_games", "missing_pitch_games", "unexpected_pitch_games", "context_games_on_other_dates",
    "pitch_games_on_other_dates", "missing_plate_appearances", "unexpected_plate_appearances", "plate_appearance_pitch_counts",
]


def game_grain(official: DataFrame, context: DataFrame, fact: DataFrame) -> DataFrame:
    """Every (date, game) seen by the source, the context or the pitches, with who saw it.

    Inputs: official(official_date, game_pk); both local tables shrink to game grain first.
    """
    mark = lambda df, name: df.select("official_date", "game_pk").distinct().withColumn(name, F.lit(True))
    source = mark(official, "in_source")
    done = mark(context.filter(F.col("game_status").isin(fl.COMPLETED)), "in_context")
    pitched = mark(fact.select(F.col("game_date").alias("official_date"), "game_pk"), "in_pitches")
    keys = ["official_date", "game_pk"]
    joined = source.join(done, keys, "full").join(pitched, keys, "full")
    return joined.na.fill(False, ["in_source", "in_context", "in_pitches"])


def appearance_grain(official: DataFrame, official_counts: DataFrame, fact: DataFrame) -> DataFrame:
    """Full comparison of pitch counts per (date, game, at-bat), local games limited to source games."""
    keys = ["official_date", "game_pk", "at_bat_number"]
    local = fact.groupBy(F.col("game_date").alias("official_date"), "game_pk", "at_bat_number").agg(F.count("*").alias("local"))
    games = official.select("official_date", "game_pk").distinct()
    known = local.join(games, ["official_date", "game_pk"], "left_semi")
    return official_counts.select(*keys, F.col("pitches").alias("official")).join(known, keys, "full")


def mismatches(games: DataFrame, appearances: DataFrame, context: DataFrame, fact: DataFrame) -> DataFrame:
    """One row per mismatch: date, class, game, at-bat, both counts, other dates."""
    c = F.col
    kinds = F.array_compact(F.array(
        F.when(c("in_source") & ~c("in_context"), "missing_context_games"), F.when(c("in_context") & ~c("in_source"), "unexpected_completed_context_games"),
        F.when(c("in_source") & ~c("in_pitches"), "missing_pitch_games"), F.when(c("in_pitches") & ~c("in_source"), "unexpected_pitch_games"),
    ))
    empty = {"at_bat_number": "int", "official": "bigint", "local": "bigint", "other_dates": "string"}
    shape = lambda df: df.select("official_date", "mismatch", "game_pk", *[(c(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in empty.items()])
    plain = games.select("official_date", "game_pk", F.explode(kinds).alias("mismatch"))
    elsewhere = []
    for missing, source, day, name in (("missing_context_games", context, "official_date", "context_games_on_other_dates"), ("missing_pitch_games", fact, "game_date", "pitch_games_on_other_dates")):
        dates = source.select("game_pk", c(day).cast("string").alias("d")).distinct().groupBy("game_pk").agg(F.array_join(F.array_sort(F.collect_set("d")), ",").alias("other_dates"))
        elsewhere.append(plain.filter(c("mismatch") == missing).drop("mismatch").join(dates, "game_pk").withColumn("mismatch", F.lit(name)))
    kind = F.when(c("local").isNull(), "missing_plate_appearances").when(c("official").isNull(), "unexpected_plate_appearances").when(c("official") != c("local"), "plate_appearance_pitch_counts")
    counts = appearances.withColumn("mismatch", kind).filter(c("mismatch").isNotNull())
    return reduce(DataFrame.unionByName, [shape(x) for x in (plain, *elsewhere, counts)])


def daily_metrics(games: DataFrame, appearances: DataFrame, fact: DataFrame, differences: DataFrame) -> DataFrame:
    """One row per date: source and local totals, mismatch count, status and assessment."""
    c = F.col
    by_game = games.groupBy("official_date").agg(
        count_where(c("in_source")).alias("official_final_games"), count_where(c("in_context")).alias("local_completed_context_games"), count_where(c("in_pitches")).alias("local_pitch_games")
    )
    by_pa = appearances.groupBy("official_date").agg(F.count("official").alias("official_pitch_plate_appearances"), F.coalesce(F.sum("official"), F.lit(0)).alias("official_pitch_events"))
    local = fact.groupBy(c("game_date").alias("official_date"), "game_pk", "at_bat_number").agg(F.count("*").alias("n")).groupBy("official_date").agg(
        F.count("*").alias("local_pitch_plate_appearances"), F.sum("n").alias("local_pitch_rows"))
    wrong = differences.groupBy("official_date").agg(F.count("*").alias("mismatch_count"), F.count_distinct("mismatch").alias("mismatch_classes"))
    out = by_game.join(by_pa, "official_date", "left").join(local, "official_date", "left").join(wrong, "official_date", "left")
    out = out.na.fill(0, [x for x in out.columns if x != "official_date"])
    status = F.when(c("mismatch_count") > 0, "error").when(c("official_final_games") == 0, "attention").otherwise("pass")
    assessment = F.when(c("mismatch_count") > 0, "source_mismatch").when(c("official_final_games") == 0, "unknown_no_final_games").otherwise("source_reconciled")
    return out.withColumns({"status": status, "assessment": assessment})


def layer_metrics(raw: DataFrame, fact: DataFrame) -> DataFrame:
    """Per date: landed rows, pitch-like rows, rows without a pitch type, and fact rows."""
    c = F.col
    automatic = F.coalesce(c("description").isin("automatic_ball", "automatic_strike"), F.lit(False))
    landed = raw.filter(c("game_type") == "R").groupBy(F.to_date("game_date").alias("official_date")).agg(
        F.count("*").alias("raw_rows"), count_where(c("description").isNotNull() & ~automatic).alias("raw_pitch_proxy_rows"), count_where(c("pitch_type").isNull()).alias("raw_null_type_rows"))
    kept = fact.groupBy(c("game_date").alias("official_date")).agg(F.count("*").alias("silver_pitch_rows"))
    out = landed.join(kept, "official_date", "full")
    return out.na.fill(0, [x for x in out.columns if x != "official_date"])


def audit(daily: DataFrame, layers: DataFrame) -> DataFrame:
    """Daily verdicts once the landed layer is held against the source as well."""
    c = F.col
    joined = daily.join(layers, "official_date", "left").na.fill(0, ["raw_rows", "raw_pitch_proxy_rows", "raw_null_type_rows", "silver_pitch_rows"])
    raw_ok = c("raw_pitch_proxy_rows") == c("official_pitch_events")
    joined = joined.withColumns({"source_assessment": c("assessment"), "raw_matches": raw_ok})
    broken = (c("status") == "pass") & ~c("raw_matches")
    return joined.withColumns({"assessment": F.when(broken, "raw_pitch_proxy_mismatch").otherwise(c("assessment")), "status": F.when(broken, "error").otherwise(c("status"))})


def audit_summary(days: DataFrame) -> DataFrame:
    """Roll-up of the audit: status counts, totals, signed differences, worst status."""
    c = F.col
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)).cast("bigint")
    of = lambda s: count_where(c("status") == s)
    row = days.agg(
        F.count("*").alias("dates_checked"), of("pass").alias("passes"), of("attention").alias("attentions"), of("error").alias("errors"), total("official_final_games").alias("official_final_games"),
        total("official_pitch_events").alias("official_pitch_events"), total("raw_pitch_proxy_rows").alias("raw_pitch_proxy_rows"), total("silver_pitch_rows").alias("silver_pitch_rows"),
        count_where(c("raw_matches")).alias("raw_matching_dates"), count_where(~c("raw_matches")).alias("raw_mismatch_dates"), count_where(c("source_assessment") == "source_reconciled").alias("source_reconciled_dates"),
    )
    verdict = lambda e, a, p: F.when(c("errors") > 0, e).when(c("attentions") > 0, a).otherwise(p)
    return row.withColumns({
        "raw_minus_official": c("raw_pitch_proxy_rows") - c("official_pitch_events"), "silver_minus_official": c("silver_pitch_rows") - c("official_pitch_events"),
        "status": verdict("error", "attention", "pass"), "assessment": verdict("audit_has_errors", "audit_incomplete", "source_reconciled_all_dates"),
    })


