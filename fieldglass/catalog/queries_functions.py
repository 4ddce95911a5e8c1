"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.catalog.registry import query
from fieldglass.catalog.tables import BIND, RAW
from fieldglass.functions import flags as fl
from fieldglass.functions import labels, rates, text, times


@query("p2_surrogate_key", "SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey AS line_id, l_suppkey FROM lineitem")
def _(t):
    return t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("line_id"), "l_suppkey")


@query("p4_p8_outcome_classes", f"""{RAW} SELECT game_pk, pitch_number, loaded_at_utc,
  CASE WHEN strikes = 2 THEN 'Two Strikes' WHEN strikes = 0 AND balls = 0 THEN 'First Pitch' WHEN strikes > balls THEN 'Pitcher Ahead'
    WHEN strikes < balls THEN 'Hitter Ahead' ELSE 'Even' END AS count_state,
  CASE WHEN description LIKE 'swinging%' OR description = 'missed_bunt' THEN 'Whiff' WHEN description = 'called_strike' THEN 'Called Strike'
    WHEN description LIKE 'foul%' OR description = 'bunt_foul_tip' THEN 'Foul' WHEN description LIKE 'hit_into%' THEN 'In Play'
    WHEN description IN ('ball', 'blocked_ball', 'pitchout', 'hit_by_pitch') THEN 'Ball' ELSE 'Other' END AS result_group,
  CASE WHEN game_year < 2026 THEN 'PRE_2026_TRACKING' ELSE '2026_ABS_ALIGNMENT' END AS tracking_regime,
  CASE WHEN description LIKE 'hit_into%' THEN (launch_speed >= 95)::INTEGER ELSE 0 END AS hard_hit_flag,
  (zone BETWEEN 1 AND 9) IS TRUE AS inside, (zone NOT BETWEEN 1 AND 9) IS TRUE AS strictly_outside FROM raw_pitch""")
def _(t):
    d = F.col("description")
    return t.raw_pitch.select(
        "game_pk", "pitch_number", "loaded_at_utc", fl.count_state(F.col("balls"), F.col("strikes")).alias("count_state"),
        fl.result_group(d).alias("result_group"), fl.tracking_regime(F.col("game_year")).alias("tracking_regime"),
        fl.hard_hit(d, F.col("launch_speed")).alias("hard_hit_flag"), (fl.in_zone(F.col("zone")) == 1).alias("inside"),
        fl.strictly_outside(F.col("zone")).alias("strictly_outside"))


@query("p9_null_presence", f"""{RAW} SELECT on_1b IS NOT NULL AS b1, on_2b IS NOT NULL AS b2, on_3b IS NOT NULL AS b3, COUNT(*) AS n
  FROM raw_pitch GROUP BY ALL""")
def _(t):
    return t.raw_pitch.groupBy(F.col("on_1b").isNotNull().alias("b1"), F.col("on_2b").isNotNull().alias("b2"), F.col("on_3b").isNotNull().alias("b3")).agg(F.count("*").alias("n"))


@query("f3_hour_on_circle", """SELECT event_id, round(sin(2 * pi() * (hour(ts) + minute(ts) / 60) / 24), 6) + 0.0::DOUBLE AS hour_sin,
  round(cos(2 * pi() * (hour(ts) + minute(ts) / 60) / 24), 6) + 0.0::DOUBLE AS hour_cos FROM events""")
def _(t):
    s, c = times.hour_on_circle(F.hour("ts") + F.minute("ts") / 60.0)
    return t.events.select("event_id", (F.round(s, 6) + 0.0).alias("hour_sin"), (F.round(c, 6) + 0.0).alias("hour_cos"))


@query("f4_date_parts", """SELECT l_orderkey, l_linenumber, l_shipdate, date_trunc('month', l_shipdate)::DATE AS month,
  strftime(l_shipdate, '%Y-%m-%d') AS day_text FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", F.trunc("l_shipdate", "month").alias("month"),
                             F.date_format("l_shipdate", "yyyy-MM-dd").alias("day_text"))


@query("f5_rounding_modes", """SELECT l_orderkey, l_linenumber, l_shipdate, round(l_extendedprice / 1000 * 4) / 4 AS quarter_bin,
  floor(l_discount * 100 / 2 + 0.5) AS half_up_value, round_even(l_quantity / 2, 0) AS half_even_value FROM lineitem""")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_shipdate", (F.round(F.col("l_extendedprice") / 1000 * 4) / 4).alias("quarter_bin"),
        rates.half_up(F.col("l_discount") * 100 / 2).alias("half_up_value"), rates.half_even(F.col("l_quantity") / 2).alias("half_even_value"))


@query("f6_zone_height", f"{RAW} SELECT game_pk, pitch_number, loaded_at_utc, round((plate_z - sz_bot) / NULLIF(GREATEST(sz_top - sz_bot, 0), 0), 6) AS height FROM raw_pitch")
def _(t):
    height = fl.zone_height(F.col("plate_z"), F.col("sz_top"), F.col("sz_bot"))
    return t.raw_pitch.select("game_pk", "pitch_number", "loaded_at_utc", F.round(height, 6).alias("height"))


_WIND_SQL = """w AS (SELECT event_id, event_type AS condition, CASE event_type WHEN 'click' THEN round(value, 1) || ' mph, Out To CF'
  WHEN 'view' THEN CAST(value AS INTEGER) || ' MPH, In From LF' WHEN 'error' THEN CAST(value AS INTEGER) || ' mph, L to R'
  WHEN 'signup' THEN CAST(value AS INTEGER) || ' mph' ELSE ' Calm ' END AS wind FROM events)"""


def _wind(t):
    v, e = F.col("value"), F.col("event_type")
    whole = F.rint(v).cast("int").cast("string")
    return t.events.select(
        "event_id", e.alias("condition"),
        F.when(e == "click", F.concat(F.round(v, 1).cast("string"), F.lit(" mph, Out To CF")))
        .when(e == "view", F.concat(whole, F.lit(" MPH, In From LF"))).when(e == "error", F.concat(whole, F.lit(" mph, L to R")))
        .when(e == "signup", F.concat(whole, F.lit(" mph"))).otherwise(" Calm ").alias("wind"))


@query("f7_parse_wind", f"""WITH {_WIND_SQL} SELECT event_id, TRY_CAST(regexp_extract(lower(wind), '([0-9.]+) *mph', 1) AS DOUBLE) AS wind_speed,
  CASE WHEN contains(lower(wind), 'mph') THEN NULLIF(trim(split_part(wind, ', ', 2)), '') ELSE trim(wind) END AS wind_direction FROM w""")
def _(t):
    w = F.col("wind")
    return _wind(t).select("event_id", text.wind_speed(w).alias("wind_speed"), text.wind_direction(w).alias("wind_direction"))


@query("f8_wind_and_roof_flags", f"""WITH {_WIND_SQL} SELECT event_id, (wind LIKE '%Out To%')::INTEGER AS wind_out_flag, (wind LIKE '%In From%')::INTEGER AS wind_in_flag,
  (wind LIKE '%L to R')::INTEGER AS crosswind_flag, (condition = 'error')::INTEGER AS indoor_flag FROM w""")
def _(t):
    roof = F.when(F.col("condition") == "error", "Dome")
    return _wind(t).select("event_id", *[v.alias(k) for k, v in text.wind_flags(text.wind_direction(F.col("wind"))).items()],
                           text.indoor_flag(roof, F.col("condition")).alias("indoor_flag"))


_ZONES = "CASE user_id % 3 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Asia/Tokyo' ELSE NULL END"


@query("f9_local_time_fields", f"""WITH z AS (SELECT event_id, CASE user_id % 3 WHEN 0 THEN ts - INTERVAL 5 HOUR WHEN 1 THEN ts + INTERVAL 9 HOUR ELSE ts END AS l FROM events)
  SELECT event_id, round(hour(l) + minute(l) / 60, 6) AS local_start_hour, CAST((isodow(l) - 1) AS INTEGER) AS local_day_of_week,
  CAST(month(l) AS INTEGER) AS local_month, (isodow(l) >= 6)::INTEGER AS weekend_flag FROM z""")
def _(t):
    fields = times.local_time_fields(F.col("ts").cast("timestamp"), F.expr(_ZONES))
    fields.pop("game_datetime_local")
    return t.events.select("event_id", *[(F.round(v, 6) if k == "local_start_hour" else v).alias(k) for k, v in fields.items()])


@query("f10_business_date", "SELECT event_id, CAST(ts - INTERVAL 8 HOUR AS DATE) AS business_day FROM events")
def _(t):
    return t.events.select("event_id", times.business_date(F.col("ts").cast("timestamp")).alias("business_day"))


@query("f11_team_alias", """SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'AZ' WHEN 1 THEN 'ATH' WHEN 2 THEN 'TB' WHEN 3 THEN 'NYY' END AS team FROM customer""")
def _(t):
    code = F.expr("CASE c_nationkey % 5 WHEN 0 THEN 'ari' WHEN 1 THEN 'OAK' WHEN 2 THEN 'tbr' WHEN 3 THEN 'nyy' ELSE '' END")
    return t.customer.select("c_custkey", text.normalize_team(code).alias("team"))


_WEATHER_NAMES = " ".join(f"WHEN {code} THEN '{name}'" for code, name in text.WEATHER_CODES.items())


@query("f12_weather", f"""SELECT event_id, CASE user_id % 100 {_WEATHER_NAMES} ELSE 'Other' END AS weather,
  CASE WHEN event_type = 'error' THEN 'Controlled environment' WHEN value < 1 THEN 'Forecast unavailable' WHEN value >= 50 AND event_type = 'view' THEN 'Roof decision'
    WHEN value >= 50 THEN 'Elevated rain risk' WHEN value >= 25 THEN 'Weather watch' ELSE 'Low weather risk' END AS risk FROM events""")
def _(t):
    roof = F.expr("CASE event_type WHEN 'error' THEN 'Dome' WHEN 'view' THEN 'Retractable' WHEN 'click' THEN NULL ELSE 'Open' END")
    return t.events.select("event_id", text.weather_condition(F.col("user_id") % 100).alias("weather"), text.weather_risk(roof, F.col("value"), F.col("value") >= 1).alias("risk"))


@query("f13_logit_platt", """WITH s AS (SELECT event_id, greatest(1e-6, least(1 - 1e-6, value / (SELECT MAX(value) FROM events))) AS p FROM events)
  SELECT event_id, round(ln(p / (1 - p)), 6) + 0.0::DOUBLE AS logit, round(1 / (1 + exp(-(0.8 * ln(p / (1 - p)) + 0.1))), 6) AS calibrated FROM s""")
def _(t):
    p = F.col("value") / t.events.agg(F.max("value")).scalar()
    return t.events.withColumn("p", p).select("event_id", (F.round(rates.logit(F.col("p")), 6) + 0.0).alias("logit"),
                                              F.round(rates.apply_platt(F.col("p"), 0.8, 0.1), 6).alias("calibrated"))


@query("f14_smoothed_rates", """WITH g AS (SELECT AVG((l_returnflag = 'R')::INTEGER) AS prior FROM lineitem)
  SELECT l_suppkey, COUNT(*) AS n, round((SUM((l_returnflag = 'R')::INTEGER) + 50 * MAX(prior)) / (COUNT(*) + 50), 6) AS smoothed,
  round(least(1.2, greatest(0.8, sqrt(AVG((l_returnflag = 'R')::INTEGER) / MAX(prior)))), 6) AS adjustment FROM lineitem, g GROUP BY l_suppkey""")
def _(t):
    flagged = t.lineitem.select("l_suppkey", fl.as_flag(F.col("l_returnflag") == "R").alias("y"))
    prior = flagged.agg(F.avg("y")).scalar()
    grouped = flagged.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("y").alias("s")).withColumn("prior", prior)
    return grouped.select("l_suppkey", "n", F.round(rates.smooth(F.col("s"), F.col("n"), F.col("prior"), 50), 6).alias("smoothed"),
                          F.round(rates.rate_adjustment(F.col("s") / F.col("n"), F.col("prior")), 6).alias("adjustment"))


@query("f16_count_bounds", """SELECT event_id, CAST(greatest(0, ceil(value / 10 - 2.5)) AS INTEGER) AS lower_k,
  CAST(greatest(greatest(0, ceil(value / 10 - 2.5)), floor(value / 10 + 2.5)) AS INTEGER) AS upper_k FROM events""")
def _(t):
    low, high = rates.count_bounds(F.col("value") / 10, 2.5)
    return t.events.select("event_id", low.alias("lower_k"), high.alias("upper_k"))


@query("f17_weighted_score", """SELECT l_orderkey, l_linenumber, l_shipdate, CASE WHEN l_quantity > 3 THEN
    round((l_quantity * 0.65 + CASE WHEN l_tax > 0 THEN l_tax * 500 * 0.25 ELSE 0 END + CASE WHEN l_returnflag <> 'N' THEN l_discount * 500 * 0.1 ELSE 0 END)
    / (0.65 + CASE WHEN l_tax > 0 THEN 0.25 ELSE 0 END + CASE WHEN l_returnflag <> 'N' THEN 0.1 ELSE 0 END), 1) END AS score,
  round(CASE WHEN l_quantity > 3 THEN 0.65 + CASE WHEN l_tax > 0 THEN 0.25 ELSE 0 END + CASE WHEN l_returnflag <> 'N' THEN 0.1 ELSE 0 END ELSE 0 END::DOUBLE, 6) AS coverage
  FROM lineitem""")
def _(t):
    q, x, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    score, coverage = rates.weighted_score([
        (F.when(q > 3, q), 0.65), (F.when(x > 0, x * 500), 0.25), (F.when(F.col("l_returnflag") != "N", d * 500), 0.10)])
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", score.alias("score"), F.round(coverage, 6).alias("coverage"))


@query("f18_decision_labels", """WITH s AS (SELECT event_id, least(value, 100) AS score, CASE WHEN event_type <> 'error' THEN value % 20 - 10 END AS change,
    CASE WHEN user_id % 2 = 0 THEN 'Starter workload' ELSE 'Relief workload' END AS role, value % 7 AS gap FROM events)
  SELECT event_id, CASE WHEN score >= 80 THEN CASE WHEN change >= 5 THEN 'High-skill, rising' ELSE 'High-skill' END
    WHEN score >= 65 THEN CASE WHEN change >= 5 THEN 'Trending stream' ELSE 'Streaming watch' END ELSE 'Monitor' END AS decision,
  CASE WHEN change IS NULL THEN 'Newly qualified' WHEN change >= 5 THEN 'Rising' WHEN change <= -5 THEN 'Cooling' ELSE 'Stable' END AS trend,
  CASE WHEN score >= 80 THEN CASE WHEN change >= 5 THEN 'Check availability' ELSE 'Roster fit review' END
    WHEN score >= 65 AND role = 'Starter workload' THEN 'Streaming review' WHEN score >= 60 AND gap >= 3 THEN 'Buy-low review' ELSE 'Monitor' END AS action,
  CASE WHEN event_type = 'view' THEN 'Awaiting probable starter' WHEN value < 1 THEN 'Insufficient recent sample' WHEN score >= 80 THEN 'Priority stream research'
    WHEN score >= 70 THEN 'Strong matchup research' WHEN score >= 60 THEN 'League-context dependent' ELSE 'Low-priority matchup' END AS tier
  FROM s JOIN events USING (event_id)""")
def _(t):
    v = F.col("value")
    s = t.events.select("event_id", "event_type", v, F.least(v, F.lit(100.0)).alias("score"), F.when(F.col("event_type") != "error", v % 20 - 10).alias("change"),
                        F.expr("CASE WHEN user_id % 2 = 0 THEN 'Starter workload' ELSE 'Relief workload' END").alias("role"), (v % 7).alias("gap"))
    score, change = F.col("score"), F.col("change")
    probable = F.when(F.col("event_type") == "view", "TBD").otherwise("Confirmed probable")
    return s.select("event_id", labels.decision_label(score, change).alias("decision"), labels.trend_status(change).alias("trend"),
                    labels.research_action(score, change, F.col("role"), F.col("gap")).alias("action"),
                    labels.stream_tier(F.when(F.col("value") >= 1, score), probable).alias("tier"))


@query("f19_row_minimum", """SELECT l_orderkey, l_linenumber, l_shipdate, round(least(l_quantity / 10, CASE WHEN l_tax > 0 THEN l_tax * 100 END, l_discount * 50), 6) AS multiple,
  CASE WHEN least(l_quantity / 10, CASE WHEN l_tax > 0 THEN l_tax * 100 END, l_discount * 50) >= 2.0 THEN 'Established sample'
  WHEN least(l_quantity / 10, CASE WHEN l_tax > 0 THEN l_tax * 100 END, l_discount * 50) >= 1.35 THEN 'Solid sample' ELSE 'Qualified sample' END AS strength FROM lineitem""")
def _(t):
    m = F.least(F.col("l_quantity") / 10, F.when(F.col("l_tax") > 0, F.col("l_tax") * 100), F.col("l_discount") * 50)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", F.round(m, 6).alias("multiple"), labels.sample_strength(m).alias("strength"))


@query("f20_fit_score", """WITH s AS (SELECT event_id, CASE WHEN value >= 1 THEN least(value, 100) END AS score, CASE WHEN user_id % 2 = 0 THEN value / 2 END AS k_score,
    CASE event_type WHEN 'click' THEN 8 WHEN 'view' THEN 4 WHEN 'error' THEN 3 ELSE 0 END + CASE user_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 0 END
    + CASE WHEN user_id % 5 = 0 THEN 3 ELSE 0 END AS pen FROM events)
  SELECT event_id, round(greatest(0, least(100, CASE WHEN k_score IS NOT NULL THEN 0.6 * score + 0.4 * k_score ELSE score END - pen)) + CASE WHEN score IS NULL THEN NULL ELSE 0 END, 6) AS fit,
  CASE WHEN score IS NULL THEN 0 ELSE pen END AS penalty FROM s""")
def _(t):
    v = F.col("value")
    weather = F.expr("CASE event_type WHEN 'click' THEN 'Elevated rain risk' WHEN 'view' THEN 'Roof decision' WHEN 'error' THEN 'Weather watch' END")
    sample = F.expr("CASE user_id % 3 WHEN 0 THEN 'Qualified sample' WHEN 1 THEN 'Solid sample' END")
    trend = F.expr("CASE WHEN user_id % 5 = 0 THEN 'Cooling' ELSE 'Stable' END")
    fit, penalty = labels.fit_score(F.when(v >= 1, F.least(v, F.lit(100.0))), F.expr("CASE WHEN user_id % 2 = 0 THEN value / 2 END"), weather, sample, trend, True, "Low risk")
    return t.events.select("event_id", F.round(fit, 6).alias("fit"), penalty.alias("penalty"))


@query("f21_parse_number", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN round(abs(c_acctbal), 2) WHEN 1 THEN -1 * round(abs(c_acctbal), 2) WHEN 2 THEN round(round(abs(c_acctbal), 2) / 100, 6)
  WHEN 3 THEN NULL ELSE CAST(c_custkey + 1000 AS DOUBLE) END AS parsed FROM customer""")
def _(t):
    shown = F.expr("""CASE c_custkey % 5 WHEN 0 THEN concat('$ ', format_number(abs(c_acctbal), 2)) WHEN 1 THEN concat('−', format_number(abs(c_acctbal), 2))
      WHEN 2 THEN concat(format_number(abs(c_acctbal), 2), '%') WHEN 3 THEN 'n/a' ELSE cast(c_custkey + 1000 AS string) END""")
    return t.customer.select("c_custkey", F.round(text.parse_number(shown), 6).alias("parsed"))


@query("f22_status_tone", """SELECT event_id, CASE event_type WHEN 'click' THEN 'positive' WHEN 'view' THEN 'warning' WHEN 'error' THEN 'negative' ELSE 'positive' END AS tone,
  CASE WHEN value < 10 THEN 'negative' ELSE 'positive' END AS direction FROM events""")
def _(t):
    status = F.expr("CASE event_type WHEN 'click' THEN 'Low risk' WHEN 'view' THEN 'Moderate risk' WHEN 'error' THEN 'Elevated rain risk' ELSE 'fine' END")
    shown = F.expr("concat(CASE WHEN value < 10 THEN '−' ELSE '+' END, format_number(value, 2), 'K')")
    return t.events.select("event_id", text.status_tone(status).alias("tone"), text.delta_direction("signupChange", shown).alias("direction"))


@query("f23_fold_name", "SELECT doc_id, regexp_replace(lower(strip_accents(trim(substr(text, 1, length(text)), ' '))), '\\s+', ' ', 'g') AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", text.fold_name(F.col("text")).alias("folded"))


@query("f24_percent_text", "SELECT l_orderkey, l_linenumber, l_shipdate, printf('%.1f%%', l_discount * 100) AS shown FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", text.percent_text(F.col("l_discount")).alias("shown"))


@query("f25_period_change", """SELECT l_orderkey, l_linenumber, l_shipdate, round((l_quantity - l_tax * 100) / NULLIF(abs(l_tax * 100), 0), 6) + 0.0::DOUBLE AS relative,
  round(l_discount - l_tax, 6) + 0.0::DOUBLE AS points FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", (F.round(rates.relative_change(F.col("l_quantity"), F.col("l_tax") * 100), 6) + 0.0).alias("relative"),
                             (F.round(rates.relative_change(F.col("l_discount"), F.col("l_tax"), points=True), 6) + 0.0).alias("points"))


@query("f26_temporal_text", """SELECT event_id, event_type <> 'error' AS temporal FROM events""")
def _(t):
    shown = F.expr("CASE event_type WHEN 'click' THEN date_format(ts, 'yyyy-MM') WHEN 'view' THEN date_format(ts, 'yyyy-MM-dd') WHEN 'error' THEN '2024-13-45' "
                   "ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm\") END")
    return t.events.select("event_id", text.is_temporal(shown).alias("temporal"))


@query("f29_map_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 0 END AS priority FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.coalesce(text.lookup({"F": 3, "O": 2}, F.col("o_orderstatus")), F.lit(0)).alias("priority"))


@query("f31_date_windows", """SELECT l_orderkey, l_linenumber, l_shipdate, l_shipdate::DATE - 13 AS window_start, l_shipdate::DATE AS window_end,
  l_shipdate::DATE - 27 AS previous_window_start, l_shipdate::DATE - 14 AS previous_window_end FROM lineitem""")
def _(t):
    bounds = times.window_bounds(F.to_date("l_shipdate"), 14)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", *[v.alias(k) for k, v in bounds.items()])


@query("p7_tri_state_flag", """SELECT event_id, CASE WHEN event_type NOT IN ('click', 'purchase') THEN 0 WHEN value < 1 THEN NULL WHEN value >= 50 THEN 1 ELSE 0 END AS flag FROM events""")
def _(t):
    play = F.when(F.col("event_type").isin("click", "purchase"), "hit_into_play").otherwise("ball")
    return t.events.select("event_id", fl.hard_hit(play, F.when(F.col("value") >= 1, F.col("value") + 45)).alias("flag"))


@query("d1_safe_divide", f"{BIND} SELECT pitch_type, round(SUM(chase_flag) / NULLIF(COUNT(*) FILTER (zone > 9 AND zone < 0), 0), 6) AS undefined_rate, round(SUM(whiff_flag) / SUM(swing_flag), 6) AS whiff_rate FROM fact GROUP BY 1")
def _(t):
    nothing = F.count_if((F.col("zone") > 9) & (F.col("zone") < 0))
    return t.fact.groupBy("pitch_type").agg(F.round(rates.safe_divide(F.sum("chase_flag"), nothing), 6).alias("undefined_rate"),
                                            F.round(rates.safe_divide(F.sum("whiff_flag"), F.sum("swing_flag")), 6).alias("whiff_rate"))
