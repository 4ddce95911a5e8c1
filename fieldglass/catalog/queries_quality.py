"""Data quality, reconciliation, incremental builds and source documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldglass.catalog.queries_marts import rounded
from fieldglass.catalog.registry import query
from fieldglass.catalog.tables import BIND, GAME, RAW
from fieldglass.operators import incremental, quality
from fieldglass.operators.joins import symmetric_difference
from fieldglass.plans import audit, gold, history
from fieldglass.session import literal_table, shared_folder, written_table
from fieldglass.sources import landing, nested, sinks, versions


@query("q1_q4_fact_checks", f"""{BIND}, r AS (SELECT COUNT(*) > 0 AS fact_has_rows, COUNT(*) = COUNT(DISTINCT pitch_id) AS pitch_id_is_unique, COUNT(*) FILTER (game_pk IS NULL OR pitcher_id IS NULL OR batter_id IS NULL) = 0 AS required_ids_not_null,
  COUNT(*) FILTER (balls NOT BETWEEN 0 AND 3 OR strikes NOT BETWEEN 0 AND 2) = 0 AS count_values_valid, SUM(whiff_flag) <= SUM(swing_flag) AS whiffs_do_not_exceed_swings, SUM(chase_flag) <= COUNT(*) FILTER (in_zone_flag = 0) AS chases_do_not_exceed_out_of_zone_pitches,
  SUM(hard_hit_flag) <= SUM(batted_ball_flag) AS hard_hits_do_not_exceed_batted_balls, COUNT(*) FILTER (release_speed NOT BETWEEN 20 AND 110) = 0 AS velocity_range_reasonable,
  COUNT(*) FILTER (batted_ball_flag = 1 AND launch_speed IS NULL AND hard_hit_flag IS NOT NULL) = 0 AS missing_exit_velocity_is_unknown,
  COUNT(*) FILTER (batted_ball_flag = 1 AND launch_speed IS NOT NULL AND hard_hit_flag IS DISTINCT FROM (launch_speed >= 95)::INTEGER) = 0 AS measured_hard_hit_labels_match_threshold FROM fact)
  SELECT check_name, CASE WHEN v THEN 'PASS' ELSE 'FAIL' END AS status, CAST(v AS VARCHAR) AS observed, 'true' AS expected FROM (UNPIVOT r ON COLUMNS(*) INTO NAME check_name VALUE v)""")
def _(t):
    return quality.fact_checks(t.fact)


@query("q5_scope_checks", f"""{BIND} SELECT 'configured_seasons_applied' AS check_name, 'PASS' AS status, 'true' AS observed, 'true' AS expected UNION ALL SELECT 'configured_date_range_applied', 'PASS', CAST(COUNT(*) = 0 AS VARCHAR), 'true' FROM fact
  WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.season = fact.season AND game_date BETWEEN start_date AND end_date)""")
def _(t):
    return quality.scope_checks(t.fact, t.ranges)


@query("q9_context_checks", f"""{BIND}, g AS (SELECT game_pk, MIN(game_date) AS lo, MAX(game_date) AS hi FROM fact GROUP BY 1), late AS (SELECT COUNT(*) AS n FROM ctx WHERE game_status IN ('Final', 'Game Over', 'Completed Early')
    AND EXISTS (SELECT 1 FROM ranges WHERE official_date BETWEEN start_date AND end_date) AND NOT EXISTS (SELECT 1 FROM fact WHERE fact.game_pk = ctx.game_pk)),
  r AS (SELECT 'context_game_is_unique' AS check_name, (SELECT COUNT(*) = COUNT(DISTINCT game_pk) FROM ctx) AS v UNION ALL SELECT 'every_pitch_game_has_context', COUNT(*) FILTER (official_date IS NULL) = 0 FROM g LEFT JOIN ctx USING (game_pk)
    UNION ALL SELECT 'context_dates_match_pitch_dates', COUNT(*) FILTER (lo <> official_date OR hi <> official_date) = 0 FROM g LEFT JOIN ctx USING (game_pk) UNION ALL SELECT 'completed_regular_games_have_pitches', n = 0 FROM late)
  SELECT check_name, CASE WHEN v THEN 'PASS' ELSE 'FAIL' END AS status, CAST(v AS VARCHAR) AS observed, 'true' AS expected FROM r""")
def _(t):
    return quality.context_checks(t.fact, t.context, t.ranges)


@query("q6_row_count_equality", """SELECT 'lines_match_orders' AS check_name, CASE WHEN COUNT(*) = (SELECT COUNT(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) THEN 'PASS' ELSE 'FAIL' END AS status, 'true' AS observed, 'true' AS expected FROM lineitem""")
def _(t):
    kept = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return quality.row_count_checks({"lines_match_orders": (t.lineitem, kept)})


def _mart_entities(target):
    out = {}
    for e in history.ENTITIES:
        frames = [str(target.rows_of(e)), *[f"{d}d" for d in e.days]]
        out[e.name] = (e.keys, target.rows_of(e), [target.count_name(e, f) for f in frames], [target.rate_name(e, f) for f in frames])
    return out


_HISTORY_RULES = ["target_is_binary"] + [n for e in history.ENTITIES for n in (
    f"{e.name}_row_count_bounded", *[f"{history.WHIFF.count_name(e, f'{d}d')}_non_negative" for d in e.days],
    *[f"{history.WHIFF.rate_name(e, f)}_is_probability" for f in [str(e.rows), *[f"{d}d" for d in e.days]]],
    f"{e.name}_history_constant_in_game", f"{e.name}_first_game_has_no_history")]


@query("q7_q13_history_checks", "SELECT check_name, 'PASS' AS status, 'true' AS observed, 'true' AS expected FROM (VALUES " + ", ".join(f"('{n}')" for n in _HISTORY_RULES) + ") v(check_name), (SELECT COUNT(*) AS n FROM events) WHERE n > 0")
def _(t):
    # What the sequence features and the history read; other columns of the fact would only be carried along.
    t.store_fact("pitch_id", *history.EVENT_ORDER[:2], "game_pk", "pitcher_id", "batter_id", "pitch_type", "pitch_family", "release_speed", "plate_x", "plate_z",
                 "swing_flag", "whiff_flag", "batted_ball_flag", "hard_hit_flag")
    mart = history.pregame_training(gold.pitch_model_features(t.stored_fact, t.context), history.WHIFF)
    entities = _mart_entities(history.WHIFF)
    keys = {k for names, *_ in entities.values() for k in names}
    read = ["target_whiff", "game_pk", "game_datetime_utc", *sorted(keys), *[c for _, _, counts, rates in entities.values() for c in (*counts, *rates)]]
    return quality.history_checks(written_table(mart.select(*read)), "target_whiff", entities)


def _violations_sql() -> str:
    checks = {
        "target_is_binary": "(SELECT COUNT(*) = 0 FROM m WHERE target IS NULL OR target NOT IN (0, 1))",
        "user_row_count_bounded": "(SELECT COUNT(*) = 0 FROM m WHERE seen NOT BETWEEN 0 AND 30)", "kind_row_count_bounded": "(SELECT COUNT(*) = 0 FROM m WHERE day_no NOT BETWEEN 0 AND 40)",
        "change_non_negative": "(SELECT COUNT(*) = 0 FROM m WHERE change < 0)", "day_no_2_non_negative": "(SELECT COUNT(*) = 0 FROM m WHERE day_no_2 < 0)",
        "rate_is_probability": "(SELECT COUNT(*) = 0 FROM m WHERE rate NOT BETWEEN 0 AND 1)", "day_rate_is_probability": "(SELECT COUNT(*) = 0 FROM m WHERE day_rate NOT BETWEEN 0 AND 1)",
    }
    for name, key, columns in (("user", "user_id", ["seen", "change", "rate"]), ("kind", "event_type", ["day_no", "day_no_2", "day_rate"])):
        distinct = " OR ".join(f"COUNT(DISTINCT {c}) > 1 OR COUNT({c}) NOT IN (0, COUNT(*))" for c in columns)
        checks[f"{name}_history_constant_in_game"] = f"(SELECT COUNT(*) = 0 FROM (SELECT 1 FROM m GROUP BY {key}, game_pk HAVING {distinct}))"
        firsts = ", ".join(f"MAX({c}) AS {c}" for c in columns)
        checks[f"{name}_first_game_has_no_history"] = (
            f"(SELECT COUNT(*) = 0 FROM (SELECT {key}, {firsts} FROM m GROUP BY {key}, game_pk QUALIFY ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY game_pk) = 1) "
            f"WHERE NOT ({columns[0]} = 0 AND {columns[1]} = 0 AND {columns[2]} IS NULL))")
    rows = " UNION ALL ".join(f"SELECT '{name}' AS check_name, {value} AS ok" for name, value in checks.items())
    return f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, dayofyear(ts) AS game_pk FROM events),
  m AS (SELECT user_id, event_type, game_pk, k % 3 AS target, k % 40 AS seen, k - 5 AS change, value / 200 AS rate, game_pk - 1 AS day_no, (game_pk - 1) * 2 AS day_no_2, CASE WHEN game_pk > 1 THEN 1 / game_pk::DOUBLE END AS day_rate FROM e)
  SELECT check_name, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status, CAST(ok AS VARCHAR) AS observed, 'true' AS expected FROM ({rows})"""


@query("q7_q13_history_violations", _violations_sql())
def _(t):
    """The history rules over events: one entity breaks them, another, whose columns grow by the day, keeps them."""
    day = F.dayofyear("ts").cast("bigint")
    mart = t.ev.select(
        "user_id", "event_type", day.alias("game_pk"), F.to_date("ts").alias("game_datetime_utc"), (F.col("k") % 3).alias("target"), (F.col("k") % 40).alias("seen"),
        (F.col("k") - 5).alias("change"), (F.col("value") / 200).alias("rate"), (day - 1).alias("day_no"), ((day - 1) * 2).alias("day_no_2"), F.when(day > 1, 1 / day).alias("day_rate"))
    return quality.history_checks(mart, "target", {"user": (["user_id"], 30, ["seen", "change"], ["rate"]), "kind": (["event_type"], 40, ["day_no", "day_no_2"], ["day_rate"])})


_COVERED = {"release_speed": 0.99, "zone": 0.99, "launch_speed": 0.5, "pitcher_id": 1.0, "pitch_type": 1.0}


@query("q10_coverage_thresholds", f"""{BIND}, c AS (SELECT {', '.join(f"COUNT({c}) / COUNT(*) >= {m} AS {c}" for c, m in _COVERED.items())} FROM fact) """
       + " UNION ALL ".join(f"SELECT '{c}_coverage_at_least_{100 * m:g}_percent' AS check_name, CASE WHEN {c} THEN 'PASS' ELSE 'FAIL' END AS status, CAST({c} AS VARCHAR) AS observed, 'true' AS expected FROM c" for c, m in _COVERED.items()))
def _(t):
    """Shares of known values against their minimums: some columns reach them, others fail."""
    return quality.coverage_checks(t.fact, _COVERED)


@query("q14_grain_unique", "SELECT l_orderkey, l_linenumber, COUNT(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def _(t):
    return quality.grain_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("q15_rates_bounded", "SELECT 'l_discount' AS rate, COUNT(*) FILTER (l_discount < 0 OR l_discount > 1) AS violations FROM lineitem UNION ALL SELECT 'l_quantity', COUNT(*) FILTER (l_quantity > 1) FROM lineitem")
def _(t):
    return quality.rates_bounded(t.lineitem, ["l_discount", "l_quantity"])


@query("q16_accepted_values", "SELECT 'o_orderstatus' AS column, COUNT(*) FILTER (o_orderstatus = 'P') AS violations FROM orders UNION ALL SELECT 'o_orderpriority', COUNT(*) FILTER (o_orderpriority IN ('2-HIGH', '5-LOW')) FROM orders")
def _(t):
    return quality.accepted_values(t.orders, {"o_orderstatus": ["O", "F"], "o_orderpriority": ["1-URGENT", "3-MEDIUM", "4-NOT SPECIFIED"]})


@query("q17_reconcile_builds", f"""{BIND}, a AS (SELECT pitcher_id, pitch_type, COUNT(*) AS n FROM fact GROUP BY 1, 2), b AS (SELECT pitcher_id, pitch_type, COUNT(*) AS n FROM fact WHERE count_state <> 'Even' GROUP BY 1, 2)
  SELECT *, 'left' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'right' FROM (FROM b EXCEPT FROM a)""")
def _(t):
    build = lambda df: df.groupBy("pitcher_id", "pitch_type").agg(F.count("*").alias("n"))
    return symmetric_difference(build(t.fact), build(t.fact.filter(F.col("count_state") != "Even")))


@query("q18_q22_observation", """WITH o AS (SELECT COUNT(*) AS n, MAX(CAST(o_orderdate AS DATE)) AS d FROM orders) SELECT 'freshness' AS check, CASE WHEN d > DATE '2001-08-20' OR n = 0 THEN 'error' WHEN DATE '2001-08-20' - d > 2 THEN 'attention' ELSE 'pass' END AS status FROM o
  UNION ALL SELECT 'row_volume', CASE WHEN n / (SELECT COUNT(*) FROM orders WHERE o_orderdate < DATE '1998-01-01') BETWEEN 0.9 AND 1.5 THEN 'pass' ELSE 'error' END FROM o
  UNION ALL SELECT 'row_volume_of_lines', CASE WHEN (SELECT COUNT(*) FROM lineitem) / n BETWEEN 0.9 AND 1.5 THEN 'pass' ELSE 'error' END FROM o
  UNION ALL SELECT 'schema_drift', CASE WHEN (SELECT list(column_name ORDER BY column_index) FROM duckdb_columns() WHERE table_name = 'orders') = (SELECT list(column_name ORDER BY column_index) FROM duckdb_columns() WHERE table_name = 'lineitem') THEN 'pass' ELSE 'error' END""")
def _(t):
    dated = t.orders.withColumn("day", F.to_date("o_orderdate"))
    # Earlier observations, as a run log would hold them: the last passing one counts the older orders.
    older = t.orders.filter(F.col("o_orderdate") < "1998-01-01").agg(F.lit(1).alias("run"), F.lit("pass").alias("status"), F.count("*").alias("rows"))
    previous = older.unionByName(t.region.agg(F.lit(2).alias("run"), F.lit("error").alias("status"), F.count("*").alias("rows")))
    orders_run = t.orders.agg(F.lit(1).alias("run"), F.lit("pass").alias("status"), F.count("*").alias("rows"))
    fresh = quality.freshness(dated, "day", F.lit("2001-08-20").cast("date"), 2).select(F.lit("freshness").alias("check"), "status")
    volume = quality.row_volume(t.orders, previous).select(F.lit("row_volume").alias("check"), "status")
    lines = quality.row_volume(t.lineitem, orders_run).select(F.lit("row_volume_of_lines").alias("check"), "status")
    drift = t.orders.agg(F.lit("schema_drift").alias("check"), F.lit(quality.schema_drift(t.lineitem, quality.schema_fingerprint(t.orders))).alias("status"))
    return quality.all_checks([fresh, volume, lines, drift])


@query("q22_overall_status", "SELECT CASE WHEN MAX(l_tax) > 0.07 THEN 2 ELSE 0 END AS exit_code, CASE WHEN MAX(l_tax) > 0.07 THEN 'error' ELSE 'pass' END AS status FROM lineitem")
def _(t):
    states = t.lineitem.select(F.when(F.col("l_tax") > 0.07, "error").when(F.col("l_tax") > 0.05, "attention").otherwise("pass").alias("status"))
    return quality.overall_status(states)


_RECENT = f"""{BIND}, cand AS (SELECT DISTINCT game_pk, official_date AS d, game_status FROM ctx WHERE official_date < DATE '2024-01-29' AND EXISTS (SELECT 1 FROM ranges WHERE official_date BETWEEN start_date AND end_date)),
  gp AS (SELECT c.d, c.game_pk, COUNT(f.game_pk) AS n FROM cand c LEFT JOIN fact f ON f.game_pk = c.game_pk AND f.game_date = c.d WHERE game_status IN ('Final', 'Game Over', 'Completed Early') GROUP BY 1, 2),
  ds AS (SELECT d, COUNT(*) AS completed_games, COUNT(*) FILTER (n > 0) AS pitch_games, SUM(n)::BIGINT AS pitch_rows, MIN(n) AS minimum_game_pitch_rows FROM gp GROUP BY 1),
  un AS (SELECT d, COUNT(DISTINCT game_pk) FILTER (game_status NOT IN ('Final', 'Game Over', 'Completed Early', 'Postponed')) AS unsettled_games FROM cand GROUP BY 1),
  top AS (SELECT * FROM un LEFT JOIN ds USING (d) WHERE completed_games > 0 OR unsettled_games > 0 ORDER BY d DESC LIMIT 15), l AS (SELECT * FROM top ORDER BY d DESC LIMIT 1),
  b AS (SELECT COUNT(*) AS n, quantile_cont(pitch_rows / completed_games, 0.5) AS m FROM top WHERE d < (SELECT d FROM l) AND completed_games > 0 AND pitch_games = completed_games AND unsettled_games = 0)"""


@query("q21_recent_partition", f"""{_RECENT} SELECT d AS game_date, completed_games, pitch_games, pitch_rows, unsettled_games, b.n AS eligible_baseline_dates, round(m, 6) AS baseline_median, round(pitch_rows / completed_games / m, 6) AS ratio,
  CASE WHEN pitch_games <> completed_games THEN 'error' WHEN unsettled_games > 0 OR b.n < 7 THEN 'attention' WHEN pitch_rows / completed_games / m BETWEEN 0.65 AND 1.35 AND minimum_game_pitch_rows / m >= 0.65 THEN 'pass' ELSE 'attention' END AS status FROM l, b""")
def _(t):
    row = quality.recent_partition(t.stored_fact, t.context, t.ranges, F.lit("2024-01-29").cast("date"))
    return rounded(row.select("game_date", "completed_games", "pitch_games", "pitch_rows", "unsettled_games", "eligible_baseline_dates", "baseline_median", "ratio", "status"), "baseline_median", "ratio")


@query("q27_row_rules", "SELECT 'positive_quantity' AS rule, COUNT(*) FILTER (l_quantity <= 0) AS violations FROM lineitem UNION ALL SELECT 'tax_below_discount', COUNT(*) FILTER (l_tax > l_discount) FROM lineitem")
def _(t):
    return quality.row_rules(t.lineitem, {"positive_quantity": F.col("l_quantity") > 0, "tax_below_discount": F.col("l_tax") <= F.col("l_discount")})


# ---- reconciliation ----------------------------------------------------------------------

def _official(t):
    """The landed feed plays the official source: completed games and their typed pitch events."""
    games = t.context.filter(F.col("game_status") != "Postponed").select("official_date", "game_pk")
    real = t.raw_pitch.filter((F.col("game_type") == "R") & (F.col("zone").isNotNull() | (F.col("balls") > 0)))
    counts = real.select(F.to_date("game_date").alias("official_date"), "game_pk", F.col("at_bat_number").cast("int").alias("at_bat_number"), "pitch_number").distinct()
    pitches = counts.groupBy("official_date", "game_pk", "at_bat_number").agg(F.count("*").alias("pitches"))
    return games, pitches.join(games, ["official_date", "game_pk"], "left_semi")


_AUDIT = f"""{BIND}, og AS (SELECT official_date, game_pk FROM ctx WHERE game_status <> 'Postponed'),
  oc AS (SELECT CAST(game_date AS DATE) AS official_date, game_pk, CAST(at_bat_number AS INTEGER) AS at_bat_number, COUNT(DISTINCT pitch_number) AS official FROM raw_pitch WHERE game_type = 'R' AND (zone IS NOT NULL OR balls > 0)
    AND game_pk IN (SELECT game_pk FROM og) GROUP BY 1, 2, 3),
  lg AS (SELECT official_date, game_pk FROM ctx WHERE game_status IN ('Final', 'Game Over', 'Completed Early')), lp AS (SELECT DISTINCT game_date AS official_date, game_pk FROM fact),
  lc AS (SELECT game_date AS official_date, game_pk, at_bat_number, COUNT(*) AS local FROM fact WHERE game_pk IN (SELECT game_pk FROM og) GROUP BY 1, 2, 3),
  cmp AS (SELECT COALESCE(oc.official_date, lc.official_date) AS official_date, COALESCE(oc.game_pk, lc.game_pk) AS game_pk, COALESCE(oc.at_bat_number, lc.at_bat_number) AS at_bat_number, official, local FROM oc FULL JOIN lc ON oc.game_pk = lc.game_pk AND oc.at_bat_number = lc.at_bat_number AND oc.official_date = lc.official_date),
  mm AS (SELECT official_date, 'missing_context_games' AS mismatch, game_pk, NULL::INTEGER AS at_bat_number, NULL::BIGINT AS official, NULL::BIGINT AS local, NULL AS other_dates FROM og ANTI JOIN lg USING (game_pk)
    UNION ALL SELECT official_date, 'unexpected_completed_context_games', game_pk, NULL, NULL, NULL, NULL FROM lg ANTI JOIN og USING (game_pk)
    UNION ALL SELECT official_date, 'missing_pitch_games', game_pk, NULL, NULL, NULL, NULL FROM og ANTI JOIN lp USING (game_pk)
    UNION ALL SELECT official_date, 'unexpected_pitch_games', game_pk, NULL, NULL, NULL, NULL FROM lp ANTI JOIN og USING (game_pk)
    UNION ALL SELECT official_date, 'context_games_on_other_dates', game_pk, NULL, NULL, NULL, CAST(official_date AS VARCHAR) FROM og ANTI JOIN lg USING (game_pk)
    UNION ALL SELECT official_date, CASE WHEN local IS NULL THEN 'missing_plate_appearances' WHEN official IS NULL THEN 'unexpected_plate_appearances' ELSE 'plate_appearance_pitch_counts' END, game_pk, at_bat_number, official, local, NULL FROM cmp WHERE official IS DISTINCT FROM local)"""


def _reconciled(t):
    games_official, counts = _official(t)
    games = audit.game_grain(games_official, t.context, t.stored_fact)
    pas = audit.appearance_grain(games_official, counts, t.stored_fact)
    return games, pas, audit.mismatches(games, pas, t.context, t.stored_fact)


@query("q23_mismatches", f"{_AUDIT} SELECT * FROM mm")
def _(t):
    return _reconciled(t)[2]


_DAILY = f"""{_AUDIT}, days AS (SELECT DISTINCT official_date FROM (SELECT official_date FROM og UNION ALL SELECT official_date FROM lg UNION ALL SELECT official_date FROM lp)),
  daily AS (SELECT official_date, (SELECT COUNT(*) FROM og WHERE og.official_date = d.official_date) AS official_final_games, COALESCE((SELECT SUM(official) FROM cmp WHERE cmp.official_date = d.official_date), 0)::BIGINT AS official_pitch_events,
    (SELECT COUNT(*) FROM mm WHERE mm.official_date = d.official_date) AS mismatch_count, (SELECT COUNT(DISTINCT mismatch) FROM mm WHERE mm.official_date = d.official_date) AS mismatch_classes,
    (SELECT COUNT(*) FROM raw_pitch WHERE game_type = 'R' AND CAST(game_date AS DATE) = d.official_date) AS raw_pitch_proxy_rows, (SELECT COUNT(*) FROM fact WHERE game_date = d.official_date) AS silver_pitch_rows FROM days d)"""


def _audited(t):
    games, pas, differences = _reconciled(t)
    return audit.audit(audit.daily_metrics(games, pas, t.stored_fact, differences), audit.layer_metrics(t.raw_pitch, t.stored_fact))


@query("q24_daily_audit", f"{_DAILY} SELECT official_date, official_final_games, official_pitch_events, mismatch_count, mismatch_classes, raw_pitch_proxy_rows, silver_pitch_rows, CASE WHEN mismatch_count > 0 THEN 'error' WHEN official_final_games = 0 THEN 'attention' WHEN raw_pitch_proxy_rows <> official_pitch_events THEN 'error' ELSE 'pass' END AS status FROM daily")
def _(t):
    return _audited(t).select("official_date", "official_final_games", "official_pitch_events", "mismatch_count", "mismatch_classes", "raw_pitch_proxy_rows", "silver_pitch_rows", "status")


@query("a26_audit_summary", f"{_DAILY} SELECT COUNT(*) AS dates_checked, SUM(official_final_games)::BIGINT AS official_final_games, SUM(raw_pitch_proxy_rows - official_pitch_events)::BIGINT AS raw_minus_official, SUM(silver_pitch_rows - official_pitch_events)::BIGINT AS silver_minus_official, 'error' AS status FROM daily")
def _(t):
    return audit.audit_summary(_audited(t)).select("dates_checked", "official_final_games", "raw_minus_official", "silver_minus_official", "status")


@query("a25_layer_metrics", f"""{BIND}, r AS (SELECT CAST(game_date AS DATE) AS official_date, COUNT(*) AS raw_rows, COUNT(*) FILTER (pitch_type IS NULL) AS raw_null_type_rows FROM raw_pitch WHERE game_type = 'R' GROUP BY 1), f AS (SELECT game_date AS official_date, COUNT(*) AS n FROM fact GROUP BY 1)
  SELECT official_date, raw_rows, raw_rows AS raw_pitch_proxy_rows, raw_null_type_rows, COALESCE(n, 0) AS silver_pitch_rows FROM r LEFT JOIN f USING (official_date)""")
def _(t):
    return audit.layer_metrics(t.raw_pitch, t.fact)


# ---- incremental -------------------------------------------------------------------------

@query("i1_high_water_select", "SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT MAX(o_orderdate) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 499000)")
def _(t):
    day = F.to_date("o_orderdate").alias("day")
    done = t.orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 499000)).select(day)
    return incremental.since_high_water(t.orders.select("o_orderkey", day), done, "day").select("o_orderkey")


@query("i2_i3_keyed_upsert", """SELECT o_orderkey, o_totalprice, NULL AS note FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT o_orderkey, o_totalprice + 1, 'late' FROM orders WHERE o_orderstatus = 'O'""")
def _(t):
    base = t.orders.select("o_orderkey", "o_totalprice")
    fresh = t.orders.filter(F.col("o_orderstatus") == "O").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("late").alias("note"))
    once = incremental.upsert(base, fresh, ["o_orderkey"])
    return incremental.upsert(once, fresh, ["o_orderkey"])


def _ledger(t):
    return landing.partition_ledger(t.events.select(F.to_date("ts").alias("partition_date")), "events", "partition_date")


@query("i4_late_days", "SELECT CAST(ts AS DATE) AS partition_date, COUNT(*) AS row_count FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-28' GROUP BY 1")
def _(t):
    return incremental.late_days(_ledger(t), F.lit("2024-01-30").cast("date"), 3).drop("source")


@query("i5_weekly_compaction", """SELECT date_trunc('week', ts)::DATE AS week_start, COUNT(DISTINCT CAST(ts AS DATE)) AS days, COUNT(*) AS row_count, date_trunc('week', ts)::DATE + 6 AS week_end, COUNT(DISTINCT CAST(ts AS DATE)) = 7 AS complete FROM events GROUP BY 1""")
def _(t):
    return incremental.weekly_compaction(_ledger(t))


def _versioned(t) -> str:
    """A table of three versions: all events, corrections that move every tenth event a day on, and compacted weeks."""
    path = f"{shared_folder(t.spark)}/versioned-{uuid.uuid4().hex}"
    rows = t.events.select("event_id", F.to_date("ts").alias("day"), "event_type")
    versions.replace(rows, path, "day")
    moved = rows.filter(F.col("event_id") % 10 == 0).select("event_id", F.date_add("day", 1).alias("day"), F.lit("moved").alias("event_type"), F.lit(1).alias("round"))
    versions.upsert(moved, path, ["event_id"], "day", [F.col("round")])
    versions.compact_weeks(t.spark, path, "day", ["event_id"])
    return path


_MOVED = """e AS (SELECT event_id, CAST(ts AS DATE) AS day, event_type FROM events),
  m AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN day + 1 ELSE day END AS day, CASE WHEN event_id % 10 = 0 THEN 'moved' ELSE event_type END AS event_type, CASE WHEN event_id % 10 = 0 THEN 1 END AS round FROM e)"""


@query("i2_versions", f"WITH {_MOVED} SELECT 1 AS version, event_id, day, event_type, NULL AS round FROM e UNION ALL SELECT 3, event_id, day, event_type, round FROM m")
def _(t):
    """The first version, still readable, and the last one: upserted, with a new column, and compacted."""
    path = _versioned(t)
    first = versions.read(t.spark, path, 1).withColumns({"round": F.lit(None).cast("int"), "version": F.lit(1)})
    return first.unionByName(versions.read(t.spark, path).withColumn("version", F.lit(3)))


@query("i5_compacted_weeks", f"""WITH {_MOVED}, d AS (SELECT DISTINCT day, date_trunc('week', day)::DATE AS monday FROM m), w AS (SELECT *, COUNT(*) OVER (PARTITION BY monday) AS n FROM d)
  SELECT DISTINCT CAST(CASE WHEN n = 7 THEN monday ELSE day END AS VARCHAR) AS span, CASE WHEN n = 7 THEN 7 ELSE 1 END AS days FROM w""")
def _(t):
    path = _versioned(t)
    again = versions.compact_weeks(t.spark, path, "day", ["event_id"])
    return versions.entry_table(t.spark, path, again)


@query("i6_chunk_plan", """WITH b AS (SELECT MIN(CAST(ts AS DATE)) AS a, MAX(CAST(ts AS DATE)) AS z FROM events), d AS (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS d, a, z FROM b),
  w AS (SELECT DISTINCT CASE WHEN m >= a AND m + 6 <= z THEN m ELSE d END AS chunk_start, CASE WHEN m >= a AND m + 6 <= z THEN m + 6 ELSE d END AS chunk_end FROM (SELECT *, date_trunc('week', d)::DATE AS m FROM d))
  SELECT 1 AS season, chunk_start, chunk_end FROM w UNION ALL SELECT 2, d, least(d + 3, z) FROM d WHERE (d - a) % 4 = 0""")
def _(t):
    span = t.events.agg(F.min(F.to_date("ts")).alias("start_date"), F.max(F.to_date("ts")).alias("end_date"))
    plans = span.select(F.explode(F.array(F.struct(F.lit(1).alias("season"), F.lit(7).alias("chunk_days"), F.lit(True).alias("latest_complete_day")), F.struct(F.lit(2).alias("season"), F.lit(4).alias("chunk_days"), F.lit(False).alias("latest_complete_day")))).alias("p"), "start_date", "end_date")
    return incremental.chunk_plan(plans.select("p.season", "start_date", "end_date", "p.chunk_days", "p.latest_complete_day"))


@query("i7_clip_ranges", "SELECT o_orderpriority, MIN(CAST(o_orderdate AS DATE)) AS start_date, least(MAX(CAST(o_orderdate AS DATE)), DATE '1999-12-31') AS end_date FROM orders GROUP BY 1")
def _(t):
    r = t.orders.groupBy("o_orderpriority").agg(F.min(F.to_date("o_orderdate")).alias("start_date"), F.max(F.to_date("o_orderdate")).alias("end_date")).withColumn("latest_complete_day", F.lit(True))
    return incremental.clip_ranges(r, F.lit("2000-01-01").cast("date")).drop("latest_complete_day")


@query("i8_resolve_duplicates", """SELECT user_id, event_id, event_type FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'error' THEN 0 ELSE 1 END DESC, event_id) = 1""")
def _(t):
    state = F.expr("CASE event_type WHEN 'purchase' THEN 'Final' WHEN 'click' THEN 'Live' ELSE 'Preview' END")
    detail = F.expr("CASE event_type WHEN 'error' THEN 'Postponed: rain' ELSE 'Scheduled' END")
    e = t.events.select("user_id", "event_id", "event_type", state.alias("a"), detail.alias("d"))
    return incremental.resolve_duplicates(e, "user_id", "a", "d", "event_id").select("user_id", "event_id", "event_type")


@query("i11_ledger_upsert", """WITH h AS (SELECT CAST(ts AS DATE) AS partition_date, COUNT(*) AS n, COUNT(*) FILTER (event_type <> 'error') AS old FROM events GROUP BY 1) SELECT partition_date, n AS row_count, CASE WHEN day(partition_date) > 20 THEN 'new' WHEN n = old THEN 'same' ELSE 'changed' END AS change FROM h""")
def _(t):
    daily = lambda df: df.groupBy(F.to_date("ts").alias("partition_date")).agg(F.count("*").alias("row_count")).withColumn("content_sha256", F.sha2(F.col("row_count").cast("string"), 256))
    old = daily(t.events.filter((F.col("event_type") != "error") & (F.dayofmonth("ts") <= 20)))
    return incremental.ledger_upsert(old, daily(t.events), ["partition_date"], "content_sha256", [F.col("row_count")]).drop("content_sha256")


@query("i12_idempotent_requests", """SELECT user_id, MIN(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT user_id, MIN(event_id) FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click') GROUP BY 1""")
def _(t):
    click = t.events.filter(F.col("event_type") == "click").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return incremental.idempotent_requests(click, t.events.select("user_id", "event_id"), "user_id", "event_id", [-F.col("event_id")])


@query("s21_missing_partitions", "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) SELECT unnest(generate_series(MIN(d), MAX(d) + 5, INTERVAL 1 DAY))::DATE AS partition_date FROM d EXCEPT SELECT d FROM d EXCEPT SELECT MAX(d) + 2 FROM d")
def _(t):
    ledger = _ledger(t)
    span = ledger.agg(F.min("partition_date").alias("a"), F.max("partition_date").alias("z"))
    empty = span.select(F.date_add("z", 2).alias("partition_date"))
    expected = span.select(F.explode(F.sequence("a", F.date_add("z", 5))).alias("partition_date"))
    return incremental.missing_partitions(expected, landing.with_proven_empty(ledger, empty, "events"), ["partition_date"])


# ---- sources and sinks -------------------------------------------------------------------

@query("s1_union_by_name", "SELECT o_orderkey AS k, o_orderstatus AS status, NULL AS line FROM orders UNION ALL SELECT l_orderkey, NULL, l_linenumber FROM lineitem")
def _(t):
    return landing.union_by_name([t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status")), t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"))])


_FAMILIES = "(VALUES ('signup', 'rare', 1), ('purchase', 'paid', 2), ('view', 'free', 3), ('click', 'free', 4)) d(kind, family, place)"


@query("s3_literal_dim", f"SELECT COALESCE(family, 'unlisted') AS family, MIN(place) AS place, COUNT(*) AS events FROM events LEFT JOIN {_FAMILIES} ON kind = event_type GROUP BY 1")
def _(t):
    dim = literal_table(t.spark, [("signup", "rare", 1), ("purchase", "paid", 2), ("view", "free", 3), ("click", "free", 4)], "event_type string, family string, place int")
    named = t.events.select("event_type").join(dim, "event_type", "left")
    return named.groupBy(F.coalesce("family", F.lit("unlisted")).alias("family")).agg(F.min("place").alias("place"), F.count("*").alias("events"))


@query("s5_manifest_check", "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS landed_rows, COUNT(*) FILTER (event_type <> 'view') AS row_count FROM events GROUP BY 1 HAVING COUNT(*) FILTER (event_type = 'view') > 0")
def _(t):
    landed = t.events.select(F.to_date("ts").alias("day"))
    manifest = t.events.filter(F.col("event_type") != "view").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("row_count"))
    return landing.manifest_differences(landed, manifest, "day")


def _schedule_documents(t):
    """One schedule document per date, built from the context and the teams of each game."""
    teams = t.raw_pitch.groupBy("game_pk").agg(F.min("home_team").alias("h"), F.min("away_team").alias("a"), F.min("pitcher").alias("sp"))
    c = F.col
    side = lambda team, pid: F.struct(F.struct(F.lit(1).alias("id"), c(team).alias("name"), c(team).alias("abbreviation")).alias("team"), F.when(pid % 3 != 0, F.struct(pid.alias("id"), F.concat(F.lit("Player "), pid.cast("string")).alias("fullName"))).alias("probablePitcher"))
    state = F.when(c("game_status") == "In Progress", "Live").when(c("game_status") == "Postponed", "Preview").otherwise("Final")
    shown = F.when(c("official_date") >= "2024-01-20", "Preview").otherwise(state)
    game = F.struct(
        c("game_pk").alias("gamePk"), F.lit("R").alias("gameType"), F.date_format("game_datetime_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("gameDate"), c("official_date").cast("string").alias("officialDate"), c("day_night").alias("dayNight"),
        F.struct(shown.alias("abstractGameState"), c("game_status").alias("detailedState")).alias("status"), F.struct(F.concat((c("game_pk") % 20).cast("string"), F.lit(" mph, Out To CF")).alias("wind"), (c("game_pk") % 90).cast("string").alias("temp")).alias("weather"),
        F.struct(c("venue_id").alias("id"), c("venue_name").alias("name")).alias("venue"), F.struct(side("h", c("sp")).alias("home"), side("a", c("sp") + 1).alias("away")).alias("teams"))
    games = t.context.join(teams, "game_pk").groupBy("official_date").agg(F.array_sort(F.collect_list(game)).alias("games"))  # a date's games
    return games.select(F.to_json(F.struct(F.array(F.struct(c("official_date").cast("string").alias("date"), c("games"))).alias("dates"))).alias("payload"))


@query("s8_schedule_games", f"{BIND} SELECT game_pk, CAST(official_date AS VARCHAR) AS official_date, game_status, venue_id, CASE WHEN official_date >= DATE '2024-01-20' THEN 'Preview' WHEN game_status = 'In Progress' THEN 'Live' WHEN game_status = 'Postponed' THEN 'Preview' ELSE 'Final' END AS abstract_state FROM ctx")
def _(t):
    return nested.schedule_games(_schedule_documents(t)).select("game_pk", "official_date", "game_status", "venue_id", "abstract_state")


@query("s8_game_context", f"{BIND} SELECT game_pk, (game_pk % 20)::DOUBLE AS wind_speed_mph, 'Out To CF' AS wind_direction, 1 AS wind_out_flag, (game_pk % 90)::DOUBLE AS temperature_f, (hour(game_datetime_utc) - 5)::DOUBLE AS local_start_hour FROM ctx")
def _(t):
    places = t.context.select("venue_id").distinct().withColumns({"time_zone_id": F.lit("America/New_York"), "roof_type": F.lit("Open")})
    return nested.game_context(_schedule_documents(t), places).select("game_pk", "wind_speed_mph", "wind_direction", "wind_out_flag", "temperature_f", "local_start_hour")


_TEAMS = "tm AS (SELECT game_pk, MIN(home_team) AS h, MIN(away_team) AS a, MIN(pitcher) AS sp FROM raw_pitch GROUP BY 1)"
_OPEN = "(official_date >= DATE '2024-01-20' OR game_status = 'Postponed') AND game_datetime_utc >= TIMESTAMP '2024-01-21'"


@query("s9_pitcher_slots", f"""{BIND}, {_TEAMS} SELECT game_pk, 'Home' AS home_away, CASE WHEN sp % 3 <> 0 THEN sp END AS pitcher_id, h AS pitcher_team, a AS opponent_team, CASE WHEN sp % 3 <> 0 THEN 'Confirmed probable' ELSE 'TBD' END AS probable_status FROM ctx JOIN tm USING (game_pk) WHERE {_OPEN}
  UNION ALL SELECT game_pk, 'Away', CASE WHEN (sp + 1) % 3 <> 0 THEN sp + 1 END, a, h, CASE WHEN (sp + 1) % 3 <> 0 THEN 'Confirmed probable' ELSE 'TBD' END FROM ctx JOIN tm USING (game_pk) WHERE {_OPEN}""")
def _(t):
    slots = nested.pitcher_slots(_schedule_documents(t), F.lit("2024-01-21 00:00:00").cast("timestamp"))
    return slots.select("game_pk", "home_away", "pitcher_id", "pitcher_team", "opponent_team", "probable_status")


@query("s9_hitter_games", f"""{BIND}, {_TEAMS} SELECT game_pk, h AS team, a AS opponent, TRUE AS home FROM ctx JOIN tm USING (game_pk) WHERE official_date >= DATE '2024-01-20' AND game_status <> 'Postponed' AND game_datetime_utc > TIMESTAMP '2024-01-21'
  UNION ALL SELECT game_pk, a, h, FALSE FROM ctx JOIN tm USING (game_pk) WHERE official_date >= DATE '2024-01-20' AND game_status <> 'Postponed' AND game_datetime_utc > TIMESTAMP '2024-01-21'""")
def _(t):
    hands = t.raw_pitch.groupBy(F.col("pitcher").alias("pitcher_id")).agg(F.max_by("p_throws", "game_date").alias("pitcher_hand"))
    return nested.hitter_games(_schedule_documents(t), F.lit("2024-01-21 00:00:00").cast("timestamp"), hands).select("game_pk", "team", "opponent", "home")


def _feed_documents(t):
    """One feed document per game: its plate appearances and their events, a game's worth each."""
    event = F.struct((F.col("value") >= 5).alias("isPitch"), F.col("event_type").alias("type"))
    b = t.ev.selectExpr("value", "event_type", "" + GAME + " AS game_pk", "cast(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 600) AS bigint) AS ix")
    plays = b.groupBy("game_pk", "ix").agg(F.collect_list(event).alias("playEvents")).select("game_pk", F.struct(F.struct(F.col("ix").alias("atBatIndex")).alias("about"), "playEvents").alias("p"))
    games = plays.groupBy("game_pk").agg(F.collect_list("p").alias("allPlays"))
    return games.select(F.to_json(F.struct(F.struct(F.struct(F.col("game_pk").alias("pk")).alias("game")).alias("gameData"), F.struct(F.struct("allPlays").alias("plays")).alias("liveData"))).alias("payload"))


@query("s10_feed_appearances", """SELECT dayofyear(ts) * 1000000000 + (user_id // 20) * 10 + user_id % 10 AS game_pk, CAST((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) // 600 + 1 AS INTEGER) AS at_bat_number, COUNT(*) AS pitches FROM events WHERE value >= 5 GROUP BY 1, 2""")
def _(t):
    return nested.feed_appearances(_feed_documents(t)).select("game_pk", "at_bat_number", "pitches")


@query("s10_feed_problems", """WITH p AS (SELECT dayofyear(ts) * 1000000000 + (user_id // 20) * 10 + user_id % 10 AS game_pk, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) // 600 AS ix FROM events WHERE value >= 5 GROUP BY 1, 2)
  SELECT game_pk, COUNT(*) FILTER (ix % 7 = 0) AS missing_index, COUNT(*) FILTER (ix % 7 <> 0) - COUNT(DISTINCT ix // 2) FILTER (ix % 7 <> 0) AS repeated_index FROM p GROUP BY 1 HAVING missing_index > 0 OR repeated_index > 0""")
def _(t):
    """Feeds whose plays lost their index (every seventh) or share it with a neighbour."""
    at = F.col("at_bat_index")
    spoilt = nested.feed_appearances(_feed_documents(t)).withColumn("at_bat_index", F.when(at % 7 != 0, F.floor(at / 2)))
    return nested.feed_problems(spoilt)


@query("s11_player_stats", """SELECT user_id AS batter_id, COUNT(*) AS pa, COUNT(*) FILTER (value >= 5) AS ab, COUNT(*) FILTER (value >= 50) AS h, CASE WHEN user_id % 10 = 0 THEN 'ambiguous_split' END AS problem FROM events GROUP BY user_id""")
def _(t):
    """One statistics document per player; traded players repeat, some without an aggregate row."""
    v = F.col("value")
    base = t.events.groupBy("user_id").agg(F.count("*").alias("pa"), F.count_if(v >= 5).alias("ab"), F.count_if(v >= 50).alias("h"))
    stat = F.struct(F.col("pa").alias("plateAppearances"), F.col("ab").alias("atBats"), F.col("h").alias("hits"), *[F.lit(0).alias(n) for n in ("runs", "homeRuns", "rbi", "stolenBases", "caughtStealing", "baseOnBalls", "strikeOuts", "gamesPlayed")])
    who = F.struct(F.col("user_id").alias("id"), F.concat(F.lit("Player "), F.col("user_id").cast("string")).alias("fullName")).alias("player")
    team = F.struct(F.lit(7).cast("bigint").alias("id")).alias("team")
    total = F.struct(who, F.lit(None).cast("struct<id:bigint>").alias("team"), stat.alias("stat"))
    part = F.struct(who, team, stat.alias("stat"))
    splits = F.when(F.col("user_id") % 10 == 0, F.array(part, part)).when(F.col("user_id") % 3 == 0, F.array(part, total)).otherwise(F.array(total))
    docs = base.select(F.to_json(F.struct(F.array(F.struct(F.size(splits).alias("totalSplits"), splits.alias("splits"))).alias("stats"))).alias("payload"))
    return nested.player_stats(docs).select("batter_id", "pa", "ab", "h", "problem")


@query("s12_hourly_forecast", "SELECT user_id AS venue_id, date_trunc('second', ts) AS forecast_time_utc, value AS temperature_2m FROM events")
def _(t):
    series = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), "value")).alias("h"))  # a venue's day
    docs = series.select(F.col("user_id").alias("venue_id"), F.to_json(F.struct(F.struct(F.col("h.time").alias("time"), F.col("h.value").alias("temperature_2m")).alias("hourly"))).alias("payload"))
    return nested.hourly_forecast(docs).select("venue_id", "forecast_time_utc", "temperature_2m")


@query("s14_rosters", "SELECT c_custkey AS batter_id, CASE WHEN c_acctbal > 5000 THEN 'N1' ELSE 'N0' END AS team FROM customer")
def _(t):
    person = F.struct(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("fullName")).alias("person"), F.struct(F.lit("OF").alias("abbreviation")).alias("position"))
    twice = t.customer.withColumn("n", F.explode(F.when(F.col("c_acctbal") > 5000, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    docs = twice.select(F.col("n").alias("team_id"), F.concat(F.lit("n"), F.col("n").cast("string")).alias("team"), F.col("n").alias("position_in_feed"), F.to_json(F.struct(F.array(person).alias("roster"))).alias("payload"))
    return nested.rosters(docs).select("batter_id", "team")


@query("s20_dataset_version", "SELECT 'r1' AS run_id, 'full' AS mode, COUNT(*) AS rows, MAX(CAST(o_orderdate AS DATE)) AS data_through FROM orders")
def _(t):
    return sinks.run_log_row(t.orders.withColumn("day", F.to_date("o_orderdate")), "r1", "full", "day")


@query("s22_json_rows", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0 THEN l_quantity / l_tax END AS ratio, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS l_shipdate FROM lineitem")
def _(t):
    ratio = F.when(F.col("l_tax") > 0, F.col("l_quantity") / F.col("l_tax")).otherwise(float("nan"))
    return sinks.json_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", ratio.alias("ratio"), "l_shipdate"))


_SIGNED = ["l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_returnflag", "l_suppkey"]  # whole numbers and texts: one JSON form everywhere
_SIGNED_JSON = " || ',' || ".join(f"""'"{c}":"' || {c} || '"'""" if c in ("l_linestatus", "l_returnflag") else f"""'"{c}":' || {c}""" for c in _SIGNED)
_PIECES = " || '|' || ".join(f"SUM(('0x' || substr(h, {1 + 12 * i}, 12))::BIGINT)::VARCHAR" for i in range(5))


@query("f30_content_signature", f"SELECT COUNT(*) AS rows, sha256({_PIECES}) AS signature FROM (SELECT sha256('{{' || {_SIGNED_JSON} || '}}') AS h FROM lineitem)")
def _(t):
    return sinks.content_signature(t.lineitem.select(*_SIGNED))


@query("f27_schedule_json", """SELECT o_custkey || '/' || strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS team,
  '[' || string_agg('{"starts_at_utc":"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '","game_pk":' || o_orderkey || '}', ',' ORDER BY o_orderdate, o_orderkey) || ']' AS schedule_json FROM orders GROUP BY 1""")
def _(t):
    from fieldglass.plans.hitters import schedule_json

    team = F.concat_ws("/", "o_custkey", F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd"))  # one customer's week bounds a list
    return schedule_json(t.orders.select(team.alias("team"), F.col("o_orderdate").cast("string").alias("starts_at_utc"), F.col("o_orderkey").alias("game_pk")))
