"""Joins, aggregates, windows, top-k, set operations and reshaping on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.catalog.queries_marts import _SUMMARY, rounded
from fieldglass.catalog.registry import query
from fieldglass.catalog.tables import BIND, RAW
from fieldglass.functions import flags as fl
from fieldglass.functions import rates, text
from fieldglass.operators import filters, joins, ordered, shape
from fieldglass.operators.filters import FilterDefinition as Filter
from fieldglass.operators.ranges import outside_ranges
from fieldglass.plans import gold
from fieldglass.session import cut_lineage, literal_table

LINE = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
LINE_SQL = ", ".join(LINE)


# ---- projections and filters -------------------------------------------------------------

@query("p3_role_swap", f"""{RAW} SELECT game_pk, pitch_number, loaded_at_utc, CASE WHEN inning_topbot = 'Top' THEN home_team ELSE away_team END AS pitcher_team,
  CASE WHEN inning_topbot = 'Top' THEN away_team ELSE home_team END AS batter_team FROM raw_pitch""")
def _(t):
    top = F.col("inning_topbot") == "Top"
    return t.raw_pitch.select("game_pk", "pitch_number", "loaded_at_utc", F.when(top, F.col("home_team")).otherwise(F.col("away_team")).alias("pitcher_team"),
                              F.when(top, F.col("away_team")).otherwise(F.col("home_team")).alias("batter_team"))


@query("p11_scope_filter", f"""{RAW} SELECT game_type, COUNT(*) AS n FROM raw_pitch WHERE game_type = 'R' AND pitch_type IS NOT NULL
  AND game_pk IS NOT NULL AND at_bat_number IS NOT NULL GROUP BY 1""")
def _(t):
    keyed = t.raw_pitch.filter((F.col("game_type") == "R") & F.col("pitch_type").isNotNull() & F.col("game_pk").isNotNull() & F.col("at_bat_number").isNotNull())
    return keyed.groupBy("game_type").agg(F.count("*").alias("n"))


@query("p13_star_minus", "SELECT * EXCLUDE (l_tax, l_linestatus) FROM lineitem")
def _(t):
    return t.lineitem.drop("l_tax", "l_linestatus")


@query("p16_dynamic_projection", f"SELECT {LINE_SQL} FROM lineitem")
def _(t):
    return t.lineitem.select(*dict.fromkeys([*LINE, "l_quantity", "l_orderkey"]))


@query("p17_date_window", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def _(t):
    return t.orders.filter(F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))).select("o_orderkey", "o_orderdate")


@query("p18_cutoff_from_data", "SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) >= (SELECT MAX(CAST(ts AS DATE)) - 6 FROM events)")
def _(t):
    last = t.events.agg(F.max(F.to_date("ts"))).scalar()
    return t.events.filter(F.to_date("ts") >= F.date_sub(last, 6)).select("event_id", "ts")


@query("p19_minimum_sample_gate", """WITH m AS (SELECT l_suppkey, COUNT(*) AS n, SUM((l_returnflag = 'R')::INTEGER)::BIGINT AS r FROM lineitem GROUP BY 1)
  SELECT days, l_suppkey, n, r FROM m JOIN (VALUES (7, 50, 10), (14, 80, 18), (30, 150, 35)) g(days, min_n, min_r) ON n >= min_n AND r >= min_r""")
def _(t):
    gates = literal_table(t.spark, [(7, 50, 10), (14, 80, 18), (30, 150, 35)], "days int, min_n int, min_r int")
    m = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), rates.count_where(F.col("l_returnflag") == "R").alias("r"))
    offered = m.withColumn("gate", F.explode(F.array(*[F.struct(F.lit(d).alias("days")) for d in (7, 14, 30)]))).select("*", "gate.days").drop("gate")
    return offered.join(gates, "days").filter((F.col("n") >= F.col("min_n")) & (F.col("r") >= F.col("min_r"))).select("days", "l_suppkey", "n", "r")


@query("p24_finite_rows", "SELECT COUNT(*) AS n, COUNT(*) FILTER (l_quantity >= 0 AND l_tax > 0 AND l_discount >= l_tax) AS usable FROM lineitem")
def _(t):
    ok = shape.finite(F.col("l_quantity")) & (F.col("l_quantity") >= 0) & (F.col("l_tax") > 0) & (F.col("l_discount") >= F.col("l_tax"))
    return t.lineitem.agg(F.count("*").alias("n"), rates.count_where(ok).alias("usable"))


@query("p25_open_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND (o_orderdate > TIMESTAMP '1998-06-01' OR o_totalprice < 100000)")
def _(t):
    later = F.col("o_orderdate") > F.lit("1998-06-01").cast("timestamp_ntz")
    return t.orders.filter((F.col("o_orderstatus") == "O") & ~F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & (later | (F.col("o_totalprice") < 100000))).select("o_orderkey")


def _order_totals(t):
    slim = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.lit(1).alias("n"))
    grains = [["month", "status", "priority"], ["month", "status"], ["month", "priority"], ["month"]]
    return shape.with_totals(slim, grains, ["month", "status", "priority"], [F.sum("n").cast("bigint").alias("orders")])


_TOTALS_SQL = """totals AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN GROUPING(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS status,
  CASE WHEN GROUPING(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS priority, COUNT(*) AS orders FROM orders
  GROUP BY GROUPING SETS ((1, o_orderstatus, o_orderpriority), (1, o_orderstatus), (1, o_orderpriority), (1)))"""
_TOTALS_SQL = _TOTALS_SQL.replace("(1", "(strftime(o_orderdate, '%Y-%m')")


@query("a19_multi_grain_totals", f"WITH {_TOTALS_SQL} SELECT * FROM totals")
def _(t):
    return _order_totals(t)


_DEFS = [Filter("status", "status"), Filter("priority", "priority"), Filter("period", "month", through=True)]


@query("p21_filter_all_rows", f"WITH {_TOTALS_SQL}, r AS (SELECT * FROM totals WHERE status = 'F' AND priority = 'all' AND month BETWEEN '1996-01' AND '1997-06') SELECT * FROM r WHERE month = (SELECT MAX(month) FROM r)")
def _(t):
    return filters.filter_rows(_order_totals(t), _DEFS, {"status": "F", "period": "1996-01..1997-06"})


@query("p21_filter_breakdown", f"WITH {_TOTALS_SQL} SELECT * FROM totals WHERE status = 'all' AND priority <> 'all' AND month <= '1997-06'")
def _(t):
    return filters.filter_rows(_order_totals(t), _DEFS, {"period": "1997-06"}, breakdown=("priority", "month"))


@query("p22_section_filters", f"WITH {_TOTALS_SQL} SELECT * FROM totals WHERE status = 'O' AND priority = '2-HIGH'")
def _(t):
    return filters.section_rows(_order_totals(t), [Filter("x", "status")], {"x": "O"}, [Filter("x", "priority")], {"x": "2-HIGH"})


@query("p23_previous_period", f"WITH {_TOTALS_SQL} SELECT * FROM totals WHERE status = 'F' AND priority = 'all' AND month = '1996-12'")
def _(t):
    return filters.previous_period_rows(_order_totals(t), _DEFS, {"status": "F", "period": "1997-01"}, None, "month", "1997-01")


@query("p23_latest_period", f"WITH {_TOTALS_SQL} SELECT * FROM totals WHERE month = (SELECT MAX(month) FROM totals)")
def _(t):
    return filters.latest_period_rows(_order_totals(t), "month")


# ---- joins -------------------------------------------------------------------------------

@query("j1_dim_fallback", """SELECT p_partkey, COALESCE(d.label, NULLIF(p_type, 'PROMO'), p_brand) AS label FROM part LEFT JOIN (VALUES ('ECONOMY', 'Economy line'), ('LARGE', 'Large line')) d(p_type, label) USING (p_type)""")
def _(t):
    dim = literal_table(t.spark, [("ECONOMY", "Economy line"), ("LARGE", "Large line")], "p_type string, std string")
    named = joins.with_fallback(t.part, dim, "p_type", "label", [F.col("std"), F.nullif("p_type", F.lit("PROMO")), F.col("p_brand")])
    return named.select("p_partkey", "label")


@query("j2_j3_context_lookups", """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, o_orderpriority, c_mktsegment, n_name, r_name FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    buyer = t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_mktsegment", "n_name", "r_name")
    order = t.orders.join(buyer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_orderpriority", "c_mktsegment", "n_name", "r_name")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    return lines.join(order, F.col("l_orderkey") == F.col("o_orderkey"), "left").drop("o_orderkey")


@query("j4_star_join", """SELECT s_nationkey, p_brand, COUNT(*) AS n, round(SUM(CAST(l_quantity AS DECIMAL(18,2))), 2)::DOUBLE AS quantity FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def _(t):
    # Lines shrink to (supplier, part) totals before they meet the dimensions.
    pairs = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("k"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    joined = pairs.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("s_nationkey", "p_brand").agg(F.sum("k").alias("n"), F.sum("q").cast("double").alias("quantity"))


@query("j7_full_outer_expected", """WITH a AS (SELECT user_id, COUNT(*) AS swings, round(AVG(value), 6) AS swing_mean FROM events WHERE event_type = 'click' AND value > 20 GROUP BY 1),
  b AS (SELECT user_id, COUNT(*) AS balls, round(AVG(value), 6) AS ball_mean FROM events WHERE event_type = 'view' AND value > 20 GROUP BY 1)
  SELECT COALESCE(a.user_id, b.user_id) AS user_id, swings, swing_mean, balls, ball_mean FROM a FULL JOIN b ON a.user_id = b.user_id""")
def _(t):
    kept = t.events.filter(F.col("value") > 20)
    part = lambda kind, n, m: kept.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias(n), F.round(F.avg("value"), 6).alias(m))
    return part("click", "swings", "swing_mean").join(part("view", "balls", "ball_mean"), "user_id", "full")


@query("j9_outside_ranges", f"""{RAW} SELECT game_pk, pitch_number, loaded_at_utc FROM raw_pitch WHERE NOT EXISTS (SELECT 1 FROM ranges WHERE CAST(game_date AS DATE) BETWEEN start_date AND end_date)""")
def _(t):
    return outside_ranges(t.raw_pitch, t.ranges, F.to_date("game_date")).select("game_pk", "pitch_number", "loaded_at_utc")


@query("j9_games_without_pitches", f"""{BIND} SELECT game_pk, game_status FROM ctx WHERE game_status IN ('Final', 'Game Over', 'Completed Early') AND NOT EXISTS (SELECT 1 FROM fact WHERE fact.game_pk = ctx.game_pk)""")
def _(t):
    done = t.context.filter(F.col("game_status").isin(fl.COMPLETED)).select("game_pk", "game_status")
    return done.join(t.fact.select("game_pk"), "game_pk", "left_anti")


@query("j10_orphans", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    known = t.customer.filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_custkey").distinct().join(known, "o_custkey", "left_anti")


@query("j11_residual_inequality", "SELECT l_orderkey, COUNT(*) AS late_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate <> o_orderdate WHERE l_shipdate < o_orderdate GROUP BY 1")
def _(t):
    joined = t.lineitem.select("l_orderkey", "l_shipdate").join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.filter(F.col("l_shipdate") < F.col("o_orderdate")).groupBy("l_orderkey").agg(F.count("*").alias("late_lines"))


@query("j12_coverage_count", """SELECT o_orderkey, COUNT(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND year(l_shipdate) = year(o_orderdate) GROUP BY 1""")
def _(t):
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"), F.year("l_shipdate").alias("y")).agg(F.count("*").alias("c"))
    return t.orders.select("o_orderkey", F.year("o_orderdate").alias("y")).join(per, ["o_orderkey", "y"], "left").select("o_orderkey", F.coalesce("c", F.lit(0)).alias("lines"))


@query("j13_previous_window", """WITH m AS (SELECT user_id, event_type, CAST(ts AS DATE) >= DATE '2024-01-16' AS recent, COUNT(*) AS n FROM events GROUP BY ALL)
  SELECT c.user_id, c.event_type, c.n, p.n AS previous_n, c.n - p.n AS change FROM m c LEFT JOIN m p ON c.user_id = p.user_id AND c.event_type = p.event_type AND NOT p.recent WHERE c.recent""")
def _(t):
    recent = F.to_date("ts") >= F.lit("2024-01-16").cast("date")
    both = t.events.groupBy("user_id", "event_type").agg(rates.count_where(recent).alias("n"), rates.count_where(~recent).alias("p"))
    previous = F.when(F.col("p") > 0, F.col("p"))
    return both.filter(F.col("n") > 0).select("user_id", "event_type", "n", previous.alias("previous_n"), (F.col("n") - previous).alias("change"))


_J15 = """l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
  r AS (SELECT user_id, ts AS time, event_id AS other_id, value FROM events WHERE event_type = 'view')"""


@query("j15_nearest_2h", f"""WITH {_J15}, pairs AS (SELECT l.event_id, l.user_id, l.ts, r.time, r.other_id, r.value,
    ROW_NUMBER() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(r.time) - epoch_us(l.ts)), r.time, r.other_id) AS k
    FROM l LEFT JOIN r ON l.user_id = r.user_id AND abs(epoch_us(r.time) - epoch_us(l.ts)) <= 7200000000)
  SELECT event_id, user_id, ts, time AS nearest_time, other_id AS nearest_other_id, value AS nearest_value FROM pairs WHERE k = 1""")
def _(t):
    left = t.events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    right = t.events.filter(F.col("event_type") == "view").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("other_id"), "value")
    return joins.nearest_in_time(left, right, ["user_id"], "ts", "at", ["other_id", "value"], 7200)


@query("j16_full_outer_names", """WITH a AS (SELECT c_nationkey AS k, COUNT(*) AS customers, MIN(c_name) AS name FROM customer WHERE c_acctbal > 9000 GROUP BY 1),
  b AS (SELECT s_nationkey AS k, COUNT(*) AS suppliers, MIN(s_name) AS name FROM supplier GROUP BY 1)
  SELECT COALESCE(a.k, b.k) AS k, COALESCE(a.name, b.name) AS name, customers, suppliers FROM a FULL JOIN b ON a.k = b.k""")
def _(t):
    a = t.customer.filter(F.col("c_acctbal") > 9000).groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"), F.min("c_name").alias("an"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"), F.min("s_name").alias("bn"))
    return a.join(b, "k", "full").select("k", F.coalesce("an", "bn").alias("name"), "customers", "suppliers")


@query("j18_baseline_lookup", """WITH e AS (SELECT event_id, event_type, CASE WHEN value >= 1 THEN floor(value / 100) END AS band, (value >= 50)::INTEGER AS y, CAST(ts AS DATE) < DATE '2024-01-21' AS train FROM events),
  g AS (SELECT AVG(y) AS rate FROM e WHERE train), b AS (SELECT event_type, band, (SUM(y) + 50 * (SELECT rate FROM g)) / (COUNT(*) + 50) AS p FROM e WHERE train GROUP BY 1, 2)
  SELECT event_id, round(COALESCE(p, (SELECT rate FROM g)), 6) AS prediction FROM e LEFT JOIN b ON e.event_type = b.event_type AND e.band IS NOT DISTINCT FROM b.band WHERE NOT train""")
def _(t):
    from fieldglass.plans.modeling import apply_baseline, group_baseline

    band = F.when(F.col("value") >= 1, F.floor(F.col("value") / 100))
    e = t.events.select("event_id", "event_type", band.alias("band"), fl.as_flag(F.col("value") >= 50).alias("y"), F.to_date("ts").alias("d"))
    train = e.filter(F.col("d") < "2024-01-21")
    scored = apply_baseline(e.filter(F.col("d") >= "2024-01-21"), group_baseline(train, ["event_type", "band"], "y"), train, ["event_type", "band"], "y")
    return scored.select("event_id", F.round("prediction", 6).alias("prediction"))


@query("j19_compare_counts", """WITH o AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2),
  l AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
  SELECT COALESCE(o.l_orderkey, l.l_orderkey) AS l_orderkey, COALESCE(o.l_linenumber, l.l_linenumber) AS l_linenumber, o.n AS official, l.n AS local,
    CASE WHEN l.n IS NULL THEN 'missing' WHEN o.n IS NULL THEN 'unexpected' ELSE 'count_mismatch' END AS mismatch
  FROM o FULL JOIN l ON o.l_orderkey = l.l_orderkey AND o.l_linenumber = l.l_linenumber WHERE o.n IS DISTINCT FROM l.n""")
def _(t):
    keys = ["l_orderkey", "l_linenumber"]
    a = t.lineitem.filter(F.col("l_returnflag") != "A").groupBy(*keys).agg(F.count("*").alias("n"))
    b = t.lineitem.filter(F.col("l_linestatus") == "O").groupBy(*keys).agg(F.count("*").alias("n"))
    return joins.compare_counts(a, b, keys, "n")


@query("j20_on_other_dates", """WITH m AS (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'))
  SELECT user_id, array_to_string(list_sort(list(DISTINCT strftime(ts, '%Y-%m-%d'))), ',') AS dates FROM events JOIN m USING (user_id) GROUP BY 1""")
def _(t):
    dated = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    missing = dated.select("user_id").distinct().join(dated.filter(F.col("day") == "2024-01-15").select("user_id"), "user_id", "left_anti")
    return joins.on_other_dates(missing, dated, "user_id", "day").select("user_id", F.array_join("dates", ",").alias("dates"))


@query("j22_self_join_by_slot", """SELECT a.user_id, a.event_type, COUNT(*) AS n, MAX(b.best) AS click_best FROM events a LEFT JOIN (SELECT user_id, MAX(value) AS best FROM events WHERE event_type = 'click' GROUP BY 1) b USING (user_id)
  WHERE a.event_type <> 'click' GROUP BY 1, 2""")
def _(t):
    per = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("best"))
    click = per.filter(F.col("event_type") == "click").select("user_id", F.col("best").alias("click_best"))
    return per.filter(F.col("event_type") != "click").drop("best").join(click, "user_id", "left")


@query("j23_resolve_names", """WITH k AS (SELECT lower(replace(c_name, '#', ' ')) AS name, c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT lower(replace(c_name, '#', ' ')), c_custkey + 100000 FROM customer WHERE c_acctbal > 9000),
  u AS (SELECT name, MIN(id) AS id FROM k GROUP BY 1 HAVING COUNT(*) = 1)
  SELECT c_name AS name, u.id FROM customer LEFT JOIN u ON lower(replace(c_name, '#', ' ')) = u.name""")
def _(t):
    spaced = F.regexp_replace("c_name", "#", "   ")
    held = t.customer.filter(F.col("c_acctbal") > 0).select(F.upper(spaced).alias("name"), F.col("c_custkey").alias("id"))
    twice = t.customer.filter(F.col("c_acctbal") > 9000).select(spaced.alias("name"), (F.col("c_custkey") + 100000).alias("id"))
    asked = t.customer.select(F.regexp_replace("c_name", "#", " ").alias("name"))
    found = joins.resolve_names(asked, held.unionByName(twice), "name", "id", text.fold_name)
    return found.select(F.regexp_replace("name", " ", "#").alias("name"), "id")


# ---- aggregates --------------------------------------------------------------------------

@query("a4_a5_filtered_aggregates", """SELECT l_suppkey, COUNT(*) FILTER (l_tax > 0) AS taxed, round(AVG(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 6) AS returned_mean,
  round(SUM((l_returnflag = 'R')::INTEGER)::DOUBLE / NULLIF(COUNT(*) FILTER (l_tax > 0.07), 0), 6) AS ratio FROM lineitem GROUP BY 1""")
def _(t):
    returned = F.col("l_returnflag") == "R"
    return t.lineitem.groupBy("l_suppkey").agg(
        rates.count_where(F.col("l_tax") > 0).alias("taxed"), F.round(F.avg(F.when(returned, F.col("l_quantity"))), 6).alias("returned_mean"),
        F.round(rates.safe_divide(rates.count_where(returned), rates.count_where(F.col("l_tax") > 0.07)), 6).alias("ratio"))


@query("a8_having_alias", "SELECT l_partkey, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING n >= 35")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")).filter(F.col("n") >= 35)


@query("a11_distinct_counts", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_orderkey").alias("orders"))


@query("a12_a13_latest_any", """SELECT user_id, ARG_MAX(event_type, event_id) AS last_type, ARG_MAX(value, event_id) AS last_value, MIN(event_type) AS a_type, BOOL_OR(value > 300) AS ever_large FROM events GROUP BY 1""")
def _(t):
    at = F.struct("ts", "event_id")
    return t.events.groupBy("user_id").agg(F.max_by("event_type", at).alias("last_type"), F.max_by("value", at).alias("last_value"),
                                           F.min("event_type").alias("a_type"), F.bool_or(F.col("value") > 300).alias("ever_large"))


@query("a17_a18_named_and_mode", """WITH c AS (SELECT l_suppkey, l_returnflag, COUNT(*) AS n FROM lineitem WHERE l_tax > 0 GROUP BY 1, 2),
  m AS (SELECT l_suppkey, l_returnflag AS mode_flag FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) = 1)
  SELECT l_suppkey, COUNT(*) AS sample_size, round(AVG(l_discount), 6) AS mean_discount, MIN(l_shipdate) AS first_date, MAX(l_shipdate) AS last_date, COUNT(DISTINCT l_partkey) AS parts, MAX(mode_flag) AS mode_flag
  FROM lineitem LEFT JOIN m USING (l_suppkey) GROUP BY 1""")
def _(t):
    from fieldglass.plans.modeling import most_common

    base = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("sample_size"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.min("l_shipdate").alias("first_date"),
                                               F.max("l_shipdate").alias("last_date"), F.count_distinct("l_partkey").alias("parts"))
    flagged = t.lineitem.select("l_suppkey", F.when(F.col("l_tax") > 0, F.col("l_returnflag")).alias("flag"))
    return base.join(most_common(flagged, ["l_suppkey"], "flag", "mode_flag"), "l_suppkey", "left")


@query("a23_error_summary", """SELECT l_returnflag, COUNT(*) AS n, round(AVG(abs(l_quantity - 25)), 6) AS mae, round(sqrt(AVG((l_quantity - 25) ** 2)), 6) AS rmse, round(AVG(25 - l_quantity), 6) AS bias,
  round(AVG((l_quantity BETWEEN 15 AND 35)::INTEGER), 6) AS interval_coverage, 20.0::DOUBLE AS mean_interval_width FROM lineitem GROUP BY 1""")
def _(t):
    from fieldglass.plans.forecast import error_summary

    framed = t.lineitem.select("l_returnflag", F.lit(25.0).alias("p"), F.col("l_quantity").alias("a"))
    return rounded(error_summary(framed, ["l_returnflag"], "p", "a", F.lit(10.0)).withColumnRenamed("rows", "n"), "mae", "rmse", "bias", "interval_coverage")


@query("a27_a28_profile", """SELECT year(o_orderdate) AS season, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS customers, MIN(o_orderdate) AS first_date, MAX(o_orderdate) AS last_date,
  COUNT(*) FILTER (o_totalprice >= 100000) AS measured, round(COUNT(*) FILTER (o_totalprice >= 100000) / COUNT(*), 6) AS coverage FROM orders GROUP BY 1""")
def _(t):
    big = rates.count_where(F.col("o_totalprice") >= 100000)
    return t.orders.groupBy(F.year("o_orderdate").cast("bigint").alias("season")).agg(
        F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"),
        big.alias("measured"), F.round(big / F.count("*"), 6).alias("coverage"))


@query("a29_non_null_coverage", f"{BIND} SELECT pitch_type, round(COUNT(zone) / COUNT(*), 6) AS zone_coverage, round(COUNT(release_speed) / COUNT(*), 6) AS speed_coverage FROM fact GROUP BY 1")
def _(t):
    return t.fact.groupBy("pitch_type").agg(F.round(F.count("zone") / F.count("*"), 6).alias("zone_coverage"), F.round(F.count("release_speed") / F.count("*"), 6).alias("speed_coverage"))


_A31 = "WITH summary AS (" + f"{BIND}, {_SUMMARY} SELECT * FROM summary)"


def _a31(name, select):
    return query(name, f"{_A31} {select}")


@_a31("a31_pitch_usage", "SELECT pitch_name, SUM(pitch_count)::BIGINT AS pitch_count, round(SUM(pitch_count) / (SELECT SUM(pitch_count) FROM summary), 6) AS usage_rate FROM summary GROUP BY 1")
def _(t):
    from fieldglass.plans import dashboard

    return rounded(dashboard.pitch_usage(gold.pitch_summary(t.fact)), "usage_rate")


@_a31("a31_outcome_rates", """SELECT pitch_name, SUM(pitch_count)::BIGINT AS pitch_count, round(SUM(whiff_count) / NULLIF(SUM(swing_count), 0), 6) AS whiff_rate,
  round(SUM(chase_count) / NULLIF(SUM(pitch_count - in_zone_count), 0), 6) AS chase_rate, round(SUM(hard_hit_count) / NULLIF(SUM(measured_batted_ball_count), 0), 6) AS hard_hit_rate
  FROM summary GROUP BY 1 ORDER BY SUM(pitch_count) DESC LIMIT 8""")
def _(t):
    from fieldglass.plans import dashboard

    return rounded(dashboard.outcome_rates(gold.pitch_summary(t.fact), keep=8), "whiff_rate", "chase_rate", "hard_hit_rate")


@_a31("a31_count_strategy", """, top AS (SELECT pitch_name FROM summary GROUP BY 1 ORDER BY SUM(pitch_count) DESC, 1 LIMIT 3), s AS (SELECT count_state, SUM(pitch_count) AS total FROM summary GROUP BY 1)
  SELECT count_state, pitch_name, SUM(pitch_count)::BIGINT AS pitch_count, round(SUM(pitch_count) / MAX(total), 6) AS usage_rate FROM summary JOIN s USING (count_state) WHERE pitch_name IN (FROM top) GROUP BY 1, 2""")
def _(t):
    from fieldglass.plans import dashboard

    return rounded(dashboard.count_strategy(gold.pitch_summary(t.fact), keep=3), "usage_rate")


@_a31("a31_season_mix", "SELECT CAST(season AS VARCHAR) AS season, pitch_name, SUM(pitch_count)::BIGINT AS pitch_count FROM summary GROUP BY 1, 2")
def _(t):
    from fieldglass.plans import dashboard

    return dashboard.season_mix(gold.pitch_summary(t.fact))


@_a31("a31_velocity_whiff", """SELECT pitch_name AS name, MIN(pitch_family) AS pitch_family, SUM(pitch_count)::BIGINT AS pitch_count, round(SUM(velocity_total) / NULLIF(SUM(pitch_count - missing_velocity_count), 0), 1) AS avg_velocity,
  round(SUM(whiff_count) / NULLIF(SUM(swing_count), 0), 6) AS whiff_rate FROM summary GROUP BY 1""")
def _(t):
    from fieldglass.plans import dashboard

    return rounded(dashboard.velocity_whiff(gold.pitch_summary(t.fact)), "whiff_rate")


@_a31("a31_pitcher_table", """SELECT pitcher_id, MIN(pitcher_name) AS pitcher_name, MIN(pitcher_team) AS pitcher_team, MIN(pitcher_throws) AS pitcher_throws, SUM(pitch_count)::BIGINT AS pitch_count,
  round((SUM(velocity_total) / NULLIF(SUM(pitch_count - missing_velocity_count), 0))::DECIMAL(18, 6), 1)::DOUBLE AS avg_velocity,
  round(SUM(in_zone_count) / SUM(pitch_count), 6) AS zone_rate, round(SUM(whiff_count) / NULLIF(SUM(swing_count), 0), 6) AS whiff_rate,
  round(SUM(chase_count) / NULLIF(SUM(pitch_count - in_zone_count), 0), 6) AS chase_rate, round(SUM(hard_hit_count) / NULLIF(SUM(measured_batted_ball_count), 0), 6) AS hard_hit_rate
  FROM summary GROUP BY 1 HAVING SUM(pitch_count) >= 20""")
def _(t):
    from fieldglass.plans import dashboard

    table = dashboard.pitcher_table(gold.pitch_summary(t.fact), 20)
    return rounded(table, "zone_rate", "whiff_rate", "chase_rate", "hard_hit_rate")


@_a31("a31_totals", """SELECT SUM(pitch_count)::BIGINT AS total_pitches, SUM(in_zone_count)::BIGINT AS in_zone, SUM(pitch_count - in_zone_count)::BIGINT AS out_of_zone, SUM(swing_count)::BIGINT AS swings,
  SUM(whiff_count)::BIGINT AS whiffs, SUM(chase_count)::BIGINT AS chases, SUM(batted_ball_count)::BIGINT AS batted_balls, SUM(measured_batted_ball_count)::BIGINT AS measured_batted_balls,
  SUM(hard_hit_count)::BIGINT AS hard_hits, COUNT(DISTINCT pitcher_id) AS pitchers, MIN(first_game_date) AS first_date, MAX(last_game_date) AS last_date FROM summary""")
def _(t):
    from fieldglass.plans import dashboard

    return dashboard.totals(gold.pitch_summary(t.fact))


@query("a31_location", f"""{BIND} SELECT round(plate_x * 4) / 4 + 0.0::DOUBLE AS plate_x_bin, round(plate_z * 4) / 4 + 0.0::DOUBLE AS plate_z_bin, COUNT(*) AS pitch_count FROM fact
  WHERE plate_x BETWEEN -2 AND 2 AND plate_z BETWEEN 0 AND 5 GROUP BY ALL""")
def _(t):
    from fieldglass.plans import dashboard

    return dashboard.location(gold.location_density(t.fact))


@query("a32_sum_over", "SELECT lang, source, SUM(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1, 2")
def _(t):
    return shape.sum_over(t.documents, ["lang", "source"], "n_chars")


@query("a33_histogram", """WITH w AS (SELECT 10.0 ** greatest(0, floor(log10(greatest(1, MAX(l_extendedprice)))) - 1) AS width FROM lineitem)
  SELECT floor(l_extendedprice / width) * width AS start, COUNT(*) AS count, floor(l_extendedprice / width) * width + MAX(width) AS end FROM lineitem, w GROUP BY 1, floor(l_extendedprice / width) * width""")
def _(t):
    return shape.histogram(t.lineitem, "l_extendedprice")


@query("a34_box_plots", """SELECT l_returnflag, MIN(l_extendedprice) AS minimum, round(quantile_cont(l_extendedprice, 0.25), 6) AS "lowerQuartile", round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS "upperQuartile", MAX(l_extendedprice) AS maximum, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 6) AS spread FROM lineitem GROUP BY 1""")
def _(t):
    return rounded(shape.box_plots(t.lineitem, "l_returnflag", "l_extendedprice"), "lowerQuartile", "median", "upperQuartile", "spread")


@query("a34_box_plots_hot_key", """SELECT event_type, MIN(user_id)::DOUBLE AS minimum, round(quantile_cont(user_id, 0.25), 6) AS "lowerQuartile", round(quantile_cont(user_id, 0.5), 6) AS median,
  round(quantile_cont(user_id, 0.75), 6) AS "upperQuartile", MAX(user_id)::DOUBLE AS maximum, round(quantile_cont(user_id, 0.75) - quantile_cont(user_id, 0.25), 6) AS spread FROM events GROUP BY 1""")
def _(t):
    return rounded(shape.box_plots(t.events, "event_type", "user_id"), "lowerQuartile", "median", "upperQuartile", "spread")


@query("a35_distribution_buckets", """WITH b AS (SELECT CAST(least(11, floor(value / 100 * 12)) AS INTEGER) AS bucket, COUNT(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1),
  f AS (SELECT CAST(range AS INTEGER) AS bucket, COALESCE(n, 0) AS n FROM range(12) LEFT JOIN b ON range = bucket)
  SELECT bucket, n, round(greatest(10, n / greatest(1, MAX(n) OVER ()) * 100), 6) AS height FROM f""")
def _(t):
    return rounded(shape.distribution_buckets(t.events, "value"), "height")


@query("a36_sankey_links", """WITH s AS (SELECT l_returnflag, l_linestatus, p_brand, l_quantity AS v FROM lineitem JOIN part ON l_partkey = p_partkey)
  SELECT 0 AS stage, l_returnflag AS source, l_linestatus AS target, SUM(v) AS value FROM s GROUP BY 2, 3 UNION ALL SELECT 1, l_linestatus, p_brand, SUM(v) FROM s GROUP BY 2, 3""")
def _(t):
    staged = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return shape.sankey_links(staged, ["l_returnflag", "l_linestatus", "p_brand"], "l_quantity")


@query("a36_sankey_nodes", """SELECT 0 AS stage, l_returnflag AS name, 'l_returnflag' AS field FROM lineitem GROUP BY 2 UNION ALL SELECT 1, l_linestatus, 'l_linestatus' FROM lineitem GROUP BY 2""")
def _(t):
    stages = ["l_returnflag", "l_linestatus"]
    return shape.sankey_nodes(shape.sankey_links(t.lineitem, stages, "l_quantity"), stages)


@query("a37_median_baseline", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, COUNT(*) / COUNT(DISTINCT event_type) AS rate FROM events GROUP BY 1, 2)
  SELECT user_id, COUNT(*) AS n, round(quantile_cont(rate, 0.5), 6) AS median_rate FROM d GROUP BY 1""")
def _(t):
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg((F.count("*") / F.count_distinct("event_type")).alias("rate"))
    return rounded(ordered.exact_quantiles(daily, ["user_id"], "rate", {"median_rate": 0.5}), "median_rate")


@query("a38_weekly_endpoints", """WITH w AS (SELECT date_trunc('week', ts)::DATE AS week, event_type, COUNT(*) FILTER (value >= 50) / COUNT(*) AS rate FROM events GROUP BY 1, 2)
  SELECT event_type, round(ARG_MIN(rate, week), 6) AS before_rate, round(ARG_MAX(rate, week), 6) AS after_rate FROM w GROUP BY 1""")
def _(t):
    weekly = t.events.groupBy(F.trunc("ts", "week").alias("week"), "event_type").agg((rates.count_where(F.col("value") >= 50) / F.count("*")).alias("rate"))
    ends = weekly.groupBy("event_type").agg(F.min_by("rate", "week").alias("before_rate"), F.max_by("rate", "week").alias("after_rate"))
    return rounded(ends, "before_rate", "after_rate")


# ---- windows -----------------------------------------------------------------------------

@query("w2_w3_sequence_and_lag", f"""SELECT {LINE_SQL}, CAST(ROW_NUMBER() OVER w AS INTEGER) AS line_in_order, LAG(l_quantity) OVER w AS previous_quantity, l_quantity - LAG(l_quantity) OVER w AS quantity_change
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice)""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", F.col("l_shipdate").desc(), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return t.lineitem.select(*LINE).withColumns({"line_in_order": F.row_number().over(w), "previous_quantity": F.lag("l_quantity").over(w)}).withColumn(
        "quantity_change", F.col("l_quantity") - F.col("previous_quantity"))


@query("w4_first_event_markers", """SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts) = 1 AS first_of_day,
  ROW_NUMBER() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts) = 1 AS first_of_type FROM events""")
def _(t):
    from fieldglass.plans.history import first_event_of_game

    dated = t.events.withColumn("day", F.to_date("ts"))
    marked = first_event_of_game(dated, ["user_id"], "day", ["ts", "event_id"], "first_of_day")
    marked = first_event_of_game(marked, ["user_id", "event_type"], "day", ["ts", "event_id"], "first_of_type")
    return marked.select("event_id", "first_of_day", "first_of_type")


@query("w5_prior_rows", """SELECT event_id, user_id, COUNT(*) OVER a AS prior_50_count, round(AVG((value >= 50)::INTEGER) OVER a, 6) AS prior_50_rate, COUNT(*) OVER b AS prior_20_count,
  round(AVG((value >= 50)::INTEGER) OVER b, 6) AS prior_20_rate FROM events WINDOW a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING),
  b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def _(t):
    e = t.events.select("event_id", "user_id", "ts", fl.as_flag(F.col("value") >= 50).alias("y"))
    out = ordered.prior_rows(e, ["user_id"], ordered.numeric_order(e, "ts"), [F.col("ts"), F.col("event_id")], "y", [50, 20])
    return rounded(out.drop("y", "ts"), "prior_50_rate", "prior_20_rate")


@query("w6_prior_14d", """SELECT event_id, user_id, COUNT(*) OVER a AS prior_14d_count, round(AVG((value >= 50)::INTEGER) OVER a, 6) AS prior_14d_rate FROM events
  WINDOW a AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)""")
def _(t):
    e = t.events.select("event_id", "user_id", "ts", fl.as_flag(F.col("value") >= 50).alias("y"))
    return rounded(ordered.prior_days(e, ["user_id"], "ts", "y", 14).drop("y", "ts"), "prior_14d_rate")


@query("w9_prior_30d_by_type", """SELECT event_id, COUNT(*) OVER a AS prior_30d_count, round(AVG((value >= 50)::INTEGER) OVER a, 6) AS prior_30d_rate FROM events
  WINDOW a AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)""")
def _(t):
    e = t.events.select("event_id", "event_type", "ts", fl.as_flag(F.col("value") >= 50).alias("y"))
    return rounded(ordered.prior_days(e, ["event_type"], "ts", "y", 30).select("event_id", "prior_30d_count", "prior_30d_rate"), "prior_30d_rate")


@query("w7_trailing_10", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n, SUM((value >= 50)::INTEGER)::BIGINT AS hits FROM events GROUP BY 1, 2)
  SELECT *, SUM(n) OVER w::BIGINT AS n_10, SUM(hits) OVER w::BIGINT AS hits_10 FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS 9 PRECEDING)""")
def _(t):
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum(fl.as_flag(F.col("value") >= 50)).alias("hits"))
    return ordered.trailing_sums(daily, ["user_id"], "day", {"n_10": "n", "hits_10": "hits"}, 10)


@query("w8_first_pitcher", f"""{BIND} SELECT DISTINCT game_pk, pitcher_team, FIRST_VALUE(pitcher_id) OVER (PARTITION BY game_pk, pitcher_team ORDER BY at_bat_number, pitch_number) AS first_pitcher FROM fact""")
def _(t):
    from fieldglass.plans.forecast import starters

    return starters(t.fact)


@query("w11_share_in_partition", """SELECT l_suppkey, l_returnflag, COUNT(*) AS n, round(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY l_suppkey), 6) AS share FROM lineitem GROUP BY 1, 2""")
def _(t):
    from pyspark.sql import Window

    counted = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("l_suppkey")), 6))


@query("w13_average_rank_percentile", """WITH v AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, CASE WHEN l_tax > 0 THEN l_quantity END AS v FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, v, round(CASE WHEN v IS NOT NULL THEN (RANK() OVER (ORDER BY v NULLS LAST) + (COUNT(*) OVER (PARTITION BY v) - 1) / 2) / COUNT(v) OVER () END, 6) AS pct_up,
  round(CASE WHEN v IS NOT NULL THEN (RANK() OVER (ORDER BY v DESC NULLS LAST) + (COUNT(*) OVER (PARTITION BY v) - 1) / 2) / COUNT(v) OVER () END, 6) AS pct_down FROM v""")
def _(t):
    v = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("v"))
    return rounded(ordered.average_rank_share(v, "v", {"pct_up": True, "pct_down": False}), "pct_up", "pct_down")


@query("w14_unique_rank", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN ROW_NUMBER() OVER (ORDER BY CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 50000) END DESC NULLS LAST, o_orderkey) END AS rank FROM orders""")
def _(t):
    scored = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 50000)).alias("score"))
    return ordered.unique_rank(scored, "score", "o_orderkey").drop("score")


@query("w14_unique_rank_per_key", """SELECT o_orderkey, o_orderpriority, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders""")
def _(t):
    return ordered.unique_rank(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_totalprice", "o_orderkey", keys=["o_orderpriority"]).drop("o_totalprice")


@query("w15_first_per_key", "SELECT conv_id, turn, role FROM conversations QUALIFY ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def _(t):
    return ordered.latest_per_key(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn")])


@query("w18_right_inclusive_percentile", "SELECT event_id, value, CAST(floor(CUME_DIST() OVER (ORDER BY value) * 100 + 0.5) AS BIGINT) AS percentile FROM events")
def _(t):
    return shape.rank_percentile(t.events.select("event_id", "value"), "value")


@query("w19_waterfall", """WITH g AS (SELECT event_id, user_id, value, event_type = 'signup' AS is_total, COUNT(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM events),
  b AS (SELECT *, SUM(value) OVER (PARTITION BY user_id, grp ORDER BY event_id) AS balance FROM g)
  SELECT event_id, user_id, round(CASE WHEN is_total THEN least(0, balance) ELSE least(balance - value, balance) END, 6) + 0.0::DOUBLE AS baseline, round(CASE WHEN is_total THEN abs(balance) ELSE abs(value) END, 6) AS magnitude,
  CASE WHEN NOT is_total THEN value END AS change, round(balance, 6) AS balance FROM b""")
def _(t):
    e = t.events.select("event_id", "user_id", "value", (F.col("event_type") == "signup").alias("is_total"))
    out = shape.waterfall(e, ["user_id"], "event_id", "value", "is_total").drop("value", "is_total")
    return rounded(out, "baseline", "magnitude", "balance").withColumn("baseline", F.col("baseline") + 0.0)


@query("w20_funnel", """WITH s AS (SELECT source, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS stage, COUNT(*)::DOUBLE AS v FROM documents GROUP BY 1, 2),
  p AS (SELECT *, LAG(v) OVER w AS p, FIRST_VALUE(v) OVER w AS f FROM s WINDOW w AS (PARTITION BY source ORDER BY stage))
  SELECT source, stage, v, round(v / NULLIF(p, 0), 6) AS conversion, round(v / NULLIF(p, 0) - 1, 6) + 0.0::DOUBLE AS change, round(v / NULLIF(f, 0), 6) AS share, p - v AS dropoff FROM p""")
def _(t):
    stage = F.expr("CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END")
    counts = t.documents.groupBy("source", stage.alias("stage")).agg(F.count("*").cast("double").alias("v"))
    out = rounded(shape.funnel(counts, ["source"], "stage", "v"), "conversion", "change", "share")
    return out.withColumn("change", F.col("change") + 0.0)


@query("w21_z_scores", """WITH p AS (SELECT AVG(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, AVG(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_shipdate, round(((l_quantity - mq) / sq * 1 + (l_discount - md) / sd * 3) / 4, 6) + 0.0::DOUBLE AS score FROM lineitem, p""")
def _(t):
    from fieldglass.plans.hitters import weighted_z

    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount")
    scored = weighted_z(lines, {"l_quantity": 1, "l_discount": 3}, "score").drop("l_quantity", "l_discount")
    return rounded(scored, "score").withColumn("score", F.col("score") + 0.0)


@query("w22_isolated_points", """WITH s AS (SELECT event_id, user_id, value >= 30 AS ok, LAG(value >= 30) OVER w AS b, LEAD(value >= 30) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id, user_id FROM s WHERE ok AND b IS NOT TRUE AND a IS NOT TRUE""")
def _(t):
    e = t.events.select("event_id", "user_id", "ts", F.when(F.col("value") >= 30, F.col("value")).alias("v"))
    return shape.isolated_points(e, ["user_id"], ["ts", "event_id"], "v").select("event_id", "user_id")


@query("w23_heatmap", """WITH c AS (SELECT user_id, event_type, COUNT(*) AS n FROM events WHERE value > 60 GROUP BY 1, 2), l AS (SELECT MIN(n) AS lo, MAX(n) AS hi FROM c),
  g AS (SELECT x.user_id, y.event_type FROM (SELECT DISTINCT user_id FROM c) x CROSS JOIN (SELECT DISTINCT event_type FROM c) y)
  SELECT g.user_id, g.event_type, COALESCE(n, 0) AS n, n IS NULL AS missing, round(COALESCE(n / hi, 0), 6) AS intensity FROM g LEFT JOIN c USING (user_id, event_type), l""")
def _(t):
    counts = t.events.filter(F.col("value") > 60).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return rounded(shape.heatmap(counts, "user_id", "event_type", "n"), "intensity")


# ---- order, top-k, set operations --------------------------------------------------------

@query("t2_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("t3_case_order", "SELECT o_orderpriority, COUNT(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS place FROM orders GROUP BY 1 ORDER BY place, 1")
def _(t):
    place = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END")
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("place", place).orderBy("place", "o_orderpriority")


@query("t4_top_k_per_group", f"""SELECT {LINE_SQL}, CAST(ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rank FROM lineitem QUALIFY rank <= 3""")
def _(t):
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return ordered.top_per_key(t.lineitem.select(*LINE), ["l_suppkey"], order, 3)


@query("t5_top_categories_as_filter", """WITH top AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 8) SELECT p_brand, p_type, COUNT(*) AS n FROM part WHERE p_brand IN (FROM top) GROUP BY 1, 2""")
def _(t):
    top = t.part.groupBy("p_brand").count().orderBy(F.col("count").desc(), "p_brand").limit(8)
    return t.part.join(top, "p_brand", "left_semi").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@query("t6_group_small", """WITH b AS (SELECT p_brand, COUNT(*) AS parts FROM part GROUP BY 1), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY parts DESC, p_brand) AS k FROM b)
  SELECT CASE WHEN k <= 6 THEN p_brand ELSE 'Other' END AS p_brand, SUM(parts)::BIGINT AS parts FROM r GROUP BY 1""")
def _(t):
    return shape.group_small(t.part.groupBy("p_brand").agg(F.count("*").alias("parts")), "p_brand", "parts")


@query("t6_group_small_refused", "SELECT p_brand, AVG(p_size) AS avg_size FROM part GROUP BY 1")
def _(t):
    return shape.group_small(t.part.groupBy("p_brand").agg(F.avg("p_size").alias("avg_size")), "p_brand", "avg_size")


@query("t6_group_small_series", """WITH b AS (SELECT p_type, p_brand, COUNT(*) AS parts FROM part GROUP BY 1, 2), top AS (SELECT p_brand FROM b GROUP BY 1 ORDER BY MAX(parts) DESC, 1 LIMIT 6)
  SELECT p_type, CASE WHEN p_brand IN (FROM top) THEN p_brand ELSE 'Other' END AS p_brand, SUM(parts)::BIGINT AS parts FROM b GROUP BY 1, 2""")
def _(t):
    return shape.group_small_series(t.part.groupBy("p_type", "p_brand").agg(F.count("*").alias("parts")), "p_type", "p_brand", "parts")


_SERIES = """WITH b AS (SELECT p_type, p_brand, COUNT(*) AS parts FROM part GROUP BY 1, 2), top AS (SELECT p_brand FROM b GROUP BY 1 ORDER BY p_brand = 'Brand#11' DESC, MAX(parts) DESC, 1 LIMIT 6)"""


def _part_series(t):
    return t.part.groupBy("p_type", "p_brand").agg(F.count("*").alias("parts"))


@query("t6_series_preserve", f"{_SERIES} SELECT p_type, CASE WHEN p_brand IN (FROM top) THEN p_brand ELSE 'Other' END AS p_brand, SUM(parts)::BIGINT AS parts FROM b GROUP BY 1, 2")
def _(t):
    return shape.group_small_series(_part_series(t), "p_type", "p_brand", "parts", preserve=("Brand#11",))


@query("t6_visible_subset", f"""{_SERIES}, v AS (SELECT *, p_brand IN (FROM top) AS lead, p_brand LIKE '%2' OR p_brand LIKE '%3' AS shown FROM b)
  SELECT p_type, p_brand, parts FROM v WHERE lead UNION ALL SELECT p_type, 'Other', COALESCE(SUM(parts) FILTER (shown), 0)::BIGINT FROM v WHERE NOT lead GROUP BY 1""")
def _(t):
    """A grouping kept as a table and applied to a view that shows only brands ending in 2 or 3."""
    series = _part_series(t)
    state = cut_lineage(shape.grouping_state(series, "p_type", "p_brand", "parts", preserve=("Brand#11",)))
    visible = [f"Brand#{i}" for i in range(1, 60) if i % 10 in (2, 3)]
    return shape.apply_grouping(series, state, "p_type", "p_brand", "parts", visible)


@query("t7_nulls_last", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders ORDER BY v DESC NULLS LAST, o_orderkey")
def _(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v")).orderBy(F.col("v").desc_nulls_last(), "o_orderkey")


@query("t8_calendar_order", """SELECT dayname(ts) AS day, CAST(isodow(ts) - 1 AS INTEGER) AS place, COUNT(*) AS n FROM events GROUP BY 1, 2 ORDER BY 2""")
def _(t):
    counted = t.events.groupBy(F.date_format("ts", "EEEE").alias("day")).agg(F.count("*").alias("n"))
    return counted.withColumn("place", shape.weekday_number(F.col("day")).cast("int")).orderBy("place")


@query("t8_order_evidence", """WITH d AS (SELECT dayname(ts) AS label, COUNT(*) AS n FROM events GROUP BY 1), w AS (SELECT dayname(ts) AS label, COUNT(*) AS n FROM events GROUP BY 1, CAST(ts AS DATE)),
  i AS (SELECT strftime(ts, '%Y-%m-%d') AS label, COUNT(*) AS n FROM events GROUP BY 1)
  SELECT 'weekdays' AS kind, label, n, CAST(list_position(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'], label) - 1 AS BIGINT) AS place FROM d
  UNION ALL SELECT 'repeated', label, n, NULL FROM w UNION ALL SELECT 'dates', label, n, CAST(epoch_ms(CAST(label AS TIMESTAMP)) AS BIGINT) FROM i
  UNION ALL SELECT 'stated', label, n, CAST(COALESCE(list_position(['Sunday', 'Friday'], label) - 1, 2) AS BIGINT) FROM d UNION ALL SELECT 'mixed', label, n, NULL FROM d UNION ALL SELECT 'mixed', label, n, NULL FROM i""")
def _(t):
    """The order key of five axes: weekday names, repeated ones, dates, a stated list, and names mixed with dates."""
    name, day = F.date_format("ts", "EEEE").alias("label"), F.date_format("ts", "yyyy-MM-dd")
    days = t.events.groupBy(name).agg(F.count("*").alias("n"))
    weeks = t.events.groupBy(name, F.to_date("ts").alias("d")).agg(F.count("*").alias("n")).select("label", "n")
    dates = t.events.groupBy(day.alias("label")).agg(F.count("*").alias("n"))
    axes = {"weekdays": (days, None), "repeated": (weeks, None), "dates": (dates, None), "stated": (days, ["Sunday", "Friday"]), "mixed": (days.unionByName(dates), None)}
    out = [shape.calendar_place(rows, "label", stated).withColumn("kind", F.lit(kind)) for kind, (rows, stated) in axes.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@query("t9_evenly_spaced_ticks", """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), r AS (SELECT day, ROW_NUMBER() OVER (ORDER BY day) AS position, COUNT(*) OVER () AS n FROM d)
  SELECT day, position FROM r WHERE (position - 1) % CAST(ceil(n / 6) AS BIGINT) = 0""")
def _(t):
    return shape.evenly_spaced(t.events.select(F.to_date("ts").alias("day")), "day")


@query("t10_seeded_sample", "SELECT LEAST(500, COUNT(*)) AS rows, LEAST(500, COUNT(*)) AS rows_of_table FROM events")
def _(t):
    from fieldglass.plans.modeling import seeded_cap

    e = t.events.select("event_id", "ts", "value")
    first, again = (seeded_cap(df, ["event_id"], 500, seed=42, order="ts") for df in (e, e.repartition(3, "value")))
    both = first.join(again, ["event_id", "ts", "value"], "full")  # a row in one sample only makes it longer
    known = both.join(e, ["event_id", "ts", "value"], "left_semi")
    return both.agg(F.count("*").alias("rows")).withColumn("rows_of_table", known.agg(F.count("*")).scalar())


@query("t11_first_dates", "SELECT event_id FROM events QUALIFY DENSE_RANK() OVER (ORDER BY CAST(ts AS DATE)) <= 3")
def _(t):
    dated = t.events.select("event_id", F.to_date("ts").alias("day"))
    first = dated.select("day").distinct().orderBy("day").limit(3)
    return dated.join(first, "day", "left_semi").select("event_id")


@query("u1_union_of_checks", """SELECT 'tax' AS rate, COUNT(*) FILTER (l_tax NOT BETWEEN 0 AND 0.05) AS failures FROM lineitem UNION ALL SELECT 'discount', COUNT(*) FILTER (l_discount NOT BETWEEN 0 AND 0.05) FROM lineitem""")
def _(t):
    bad = lambda c: rates.count_where(~F.col(c).between(0, 0.05))
    one = t.lineitem.agg(bad("l_tax").alias("tax"), bad("l_discount").alias("discount"))
    return one.unpivot([], ["tax", "discount"], "rate", "failures")


@query("u2_symmetric_difference", """WITH a AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O')
  SELECT *, 'left' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'right' FROM (FROM b EXCEPT FROM a)""")
def _(t):
    slim = lambda c, v: t.lineitem.filter(F.col(c) == v).select("l_orderkey", "l_linenumber")
    return joins.symmetric_difference(slim("l_returnflag", "R"), slim("l_linestatus", "O"))


@query("u3_key_sets", """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A')
  SELECT 'both' AS kind, COUNT(*) AS n FROM a JOIN b USING (k) UNION ALL SELECT 'only_a', COUNT(*) FROM a ANTI JOIN b USING (k)""")
def _(t):
    keys = lambda v: t.lineitem.filter(F.col("l_returnflag") == v).select("l_partkey").distinct()
    a, b = keys("R"), keys("A")
    both = a.join(b, "l_partkey").agg(F.count("*").alias("n")).select(F.lit("both").alias("kind"), "n")
    return both.unionByName(a.join(b, "l_partkey", "left_anti").agg(F.count("*").alias("n")).select(F.lit("only_a").alias("kind"), "n"))


@query("u5_densify", """WITH c AS (SELECT user_id, event_type, COUNT(*) AS n FROM events WHERE value > 100 GROUP BY 1, 2)
  SELECT x.user_id, y.event_type, COALESCE(n, 0) AS n, n IS NULL AS missing FROM (SELECT DISTINCT user_id FROM c) x CROSS JOIN (SELECT DISTINCT event_type FROM c) y LEFT JOIN c USING (user_id, event_type)""")
def _(t):
    counts = t.events.filter(F.col("value") > 100).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return shape.densify(counts, "user_id", "event_type", "n")


@query("u6_pivot", "SELECT l_suppkey, SUM(l_quantity) FILTER (l_returnflag = 'A') AS A, SUM(l_quantity) FILTER (l_returnflag = 'N') AS N, SUM(l_quantity) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1")
def _(t):
    long = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return shape.pivot_wide(long, "l_suppkey", "l_returnflag", "q", ["A", "N", "R"])


@query("u6_unpivot", """SELECT o_orderkey, 'price' AS metric, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'customer', o_custkey::DOUBLE FROM orders""")
def _(t):
    renamed = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
    return shape.unpivot_metrics(renamed, ["o_orderkey"], ["price", "customer"])


@query("u7_both_sides", f"{RAW}, g AS (SELECT DISTINCT game_pk, home_team, away_team FROM raw_pitch) SELECT game_pk, home_team AS team FROM g UNION ALL SELECT game_pk, away_team FROM g")
def _(t):
    games = t.raw_pitch.select("game_pk", "home_team", "away_team").distinct()
    return shape.both_sides(games, "home_team", "away_team", "team", ["game_pk"])


@query("u8_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def _(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_suppkey").distinct()


@query("t1_total_order", "SELECT l_suppkey, l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2")
def _(t):
    return t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n")).orderBy("l_suppkey", "l_returnflag")


@query("j6_enrichment", f"{BIND} SELECT f.pitch_id, r.description AS pitch_description, r.loaded_at_utc FROM fact f JOIN raw_pitch r ON r.game_pk = f.game_pk AND r.pitch_number = f.pitch_number AND r.loaded_at_utc = f.loaded_at_utc")
def _(t):
    extra = t.raw_pitch.select("game_pk", "pitch_number", "loaded_at_utc", F.col("description").alias("pitch_description"))
    return t.fact.select("pitch_id", "game_pk", F.col("pitch_number").cast("bigint").alias("pitch_number"), "loaded_at_utc").join(
        extra, ["game_pk", "pitch_number", "loaded_at_utc"], "left").select("pitch_id", "pitch_description", "loaded_at_utc")


@query("u4_stack_profiles", """SELECT profile_key, l_suppkey, round(SUM(l_quantity * w), 6) AS score FROM lineitem CROSS JOIN (VALUES ('balanced', 0.5::DOUBLE), ('upside', 0.25::DOUBLE)) p(profile_key, w) GROUP BY 1, 2""")
def _(t):
    totals = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    options = F.array(*[F.struct(F.lit(k).alias("profile_key"), F.lit(w).alias("w")) for k, w in (("balanced", 0.5), ("upside", 0.25))])
    return totals.withColumn("p", F.explode(options)).select("p.profile_key", "l_suppkey", F.round(F.col("q") * F.col("p.w"), 6).alias("score"))


@query("f28_array_functions", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS positives, label FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("positives"), "label")


@query("p20_eligibility_flag", """WITH g AS (SELECT user_id, COUNT(*) AS n, COUNT(DISTINCT CAST(ts AS DATE)) AS days, DATE '2024-01-30' - MAX(CAST(ts AS DATE)) AS idle, COUNT(*) FILTER (value >= 5) / COUNT(*) AS coverage FROM events GROUP BY 1)
  SELECT user_id, n >= 30 AND days >= 15 AND idle <= 4 AND coverage BETWEEN 0.8 AND 1.05 AS eligible FROM g""")
def _(t):
    g = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days"), F.max(F.to_date("ts")).alias("last"), (rates.count_where(F.col("value") >= 5) / F.count("*")).alias("coverage"))
    idle = F.datediff(F.lit("2024-01-30").cast("date"), F.col("last"))
    return g.select("user_id", ((F.col("n") >= 30) & (F.col("days") >= 15) & (idle <= 4) & F.col("coverage").between(0.8, 1.05)).alias("eligible"))


@query("w17_prior_days_totals", """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, day, n, COALESCE(SUM(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0)::BIGINT AS before FROM d""")
def _(t):
    from pyspark.sql import Window

    daily = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    frame = Window.partitionBy("event_type").orderBy(F.unix_date("day")).rangeBetween(-7, -1)
    return daily.withColumn("before", F.coalesce(F.sum("n").over(frame), F.lit(0)))


@query("x10_dataset_index", f"{BIND}, {_SUMMARY} SELECT 'pitch_summary' AS dataset, COUNT(*) AS rows FROM summary UNION ALL SELECT 'games', COUNT(*) FROM ctx")
def _(t):
    size = lambda df, name: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("dataset"), "rows")
    return size(gold.pitch_summary(t.fact), "pitch_summary").unionByName(size(t.context, "games"))
