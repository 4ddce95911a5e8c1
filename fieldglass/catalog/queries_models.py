"""Time splits, baselines, evaluation, calibration, scoring and leaderboards on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.catalog.queries_marts import rounded
from fieldglass.catalog.registry import query
from fieldglass.catalog.tables import BIND
from fieldglass.functions import flags as fl
from fieldglass.plans import boosting, forecast, modeling
from fieldglass.plans.modeling import Boundaries
from fieldglass.session import cut_lineage, literal_table

BOUNDS = Boundaries("2024-01-12", "2024-01-13", "2024-01-22", "2024-01-30")
MODELS = ["constant", "line", "steep"]

_SPLIT = """CASE WHEN CAST(ts AS DATE) <= DATE '2024-01-12' THEN 'train' WHEN CAST(ts AS DATE) < DATE '2024-01-22' THEN 'validation' ELSE 'test' END"""


@query("m3_time_split", f"SELECT {_SPLIT} AS split, COUNT(*) AS rows, MIN(CAST(ts AS DATE)) AS first_day, MAX(CAST(ts AS DATE)) AS last_day FROM events GROUP BY 1")
def _(t):
    split = modeling.time_split(t.events.withColumn("game_date", F.to_date("ts")), BOUNDS)
    return split.groupBy("split").agg(F.count("*").alias("rows"), F.min("game_date").alias("first_day"), F.max("game_date").alias("last_day"))


@query("m4_group_baseline", """WITH g AS (SELECT AVG((l_returnflag = 'R')::INTEGER) AS r FROM lineitem) SELECT l_suppkey, CASE WHEN l_tax > 0.04 THEN l_linestatus END AS status,
  round((SUM((l_returnflag = 'R')::INTEGER) + 50 * MAX(r)) / (COUNT(*) + 50), 6) AS prediction FROM lineitem, g GROUP BY 1, 2""")
def _(t):
    lines = t.lineitem.select("l_suppkey", F.when(F.col("l_tax") > 0.04, F.col("l_linestatus")).alias("status"), fl.as_flag(F.col("l_returnflag") == "R").alias("y"))
    return rounded(modeling.group_baseline(lines, ["l_suppkey", "status"], "y"), "prediction")


def _scored(t):
    """Three made-up probability models over all events: label `k >= 50`, score from the value."""
    p = F.col("value") / (F.col("value") + 30)
    options = F.array(*[F.struct(F.lit(m).alias("model"), v.alias("p")) for m, v in zip(MODELS, (F.lit(0.5), 0.25 + p / 2, F.pow(p, 2)))])
    e = modeling.time_split(t.ev.withColumn("game_date", F.to_date("ts")), BOUNDS).withColumn("y", fl.as_flag(F.col("k") >= 50))
    return e.withColumn("o", F.explode(options)).select("event_id", "user_id", "event_type", "game_date", "split", "y", "o.model", "o.p")


_SCORED = f"""WITH base AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 AS y, {_SPLIT} AS split, value / (value + 30) AS q FROM events),
  s AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS game_date, split, y::INTEGER AS y, model, greatest(1e-6, least(1 - 1e-6, CASE model WHEN 'constant' THEN 0.5::DOUBLE WHEN 'line' THEN 0.25 + q / 2 ELSE q * q END)) AS p
  FROM base CROSS JOIN (VALUES ('constant'), ('line'), ('steep')) m(model)),
  met AS (SELECT model, split, COUNT(*) AS rows, AVG(y) AS observed_rate, AVG(p) AS predicted_rate, AVG(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss, AVG((p - y) ** 2) AS brier_score FROM s GROUP BY 1, 2),
  rk AS (SELECT *, RANK() OVER (PARTITION BY model, split ORDER BY p) + (COUNT(*) OVER (PARTITION BY model, split, p) - 1) / 2 AS r, SUM(y) OVER (PARTITION BY model, split ORDER BY p DESC) / COUNT(*) OVER (PARTITION BY model, split ORDER BY p DESC) AS prec FROM s),
  auc AS (SELECT model, split, (SUM(r) FILTER (y = 1) - SUM(y) * (SUM(y) + 1) / 2) / (SUM(y) * (COUNT(*) - SUM(y))) AS roc_auc, SUM(prec) FILTER (y = 1) / SUM(y) AS average_precision FROM rk GROUP BY 1, 2),
  bins AS (SELECT model, split, (SELECT COUNT(*) FROM range(1, 10) e WHERE p > e.range * 0.1::DOUBLE) AS bin, COUNT(*) AS rows, AVG(y) AS o, AVG(p) AS q FROM s GROUP BY 1, 2, 3),
  ece AS (SELECT model, split, SUM(rows * abs(o - q)) / SUM(rows) AS expected_calibration_error FROM bins GROUP BY 1, 2)"""
_METRICS = ["observed_rate", "predicted_rate", "log_loss", "brier_score", "roc_auc", "average_precision", "expected_calibration_error"]


@query("m5_evaluation", f"{_SCORED} SELECT model, split, rows, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM met JOIN auc USING (model, split) JOIN ece USING (model, split)")
def _(t):
    return rounded(modeling.evaluate(_scored(t), ["model", "split"], "y", "p"), *_METRICS)


@query("m6_calibration_error", f"{_SCORED} SELECT model, round(SUM(rows * abs(o - q)) / SUM(rows), 6) AS expected_calibration_error FROM bins WHERE split = 'test' GROUP BY 1")
def _(t):
    test = _scored(t).filter(F.col("split") == "test")
    return rounded(modeling.calibration_error(test, ["model"], "y", "p"), "expected_calibration_error")


@query("m7_calibration_table", f"{_SCORED} SELECT model, split, CAST(bin AS INTEGER) AS bin, rows, round(o, 6) AS observed_rate, round(q, 6) AS predicted_rate FROM bins")
def _(t):
    return rounded(modeling.calibration_table(_scored(t), ["model", "split"], "y", "p"), "observed_rate", "predicted_rate")


@query("m7_monthly_table", f"{_SCORED} SELECT model, strftime(game_date, '%Y-%m') AS month, COUNT(*) AS rows, round(AVG(y), 6) AS observed_rate, round(AVG(p), 6) AS predicted_rate FROM s GROUP BY 1, 2")
def _(t):
    return rounded(modeling.monthly_table(_scored(t), ["model"], "game_date", "y", "p"), "observed_rate", "predicted_rate")


@query("u9_ideal_diagonal", f"""{_SCORED}, t AS (SELECT 'champion' AS series, CAST(bin AS INTEGER) AS bin, rows, round(o, 6) AS observed_rate, round(q, 6) AS predicted_rate, FALSE AS is_reference FROM bins WHERE model = 'line' AND split = 'test')
  FROM t UNION ALL SELECT 'Ideal calibration', CAST(range AS INTEGER), NULL, range / 10, range / 10, TRUE FROM range(11)""")
def _(t):
    test = _scored(t).filter((F.col("split") == "test") & (F.col("model") == "line"))
    table = modeling.calibration_table(test, [], "y", "p").withColumn("series", F.lit("champion"))
    return modeling.with_ideal_diagonal(rounded(table, "observed_rate", "predicted_rate"))


@query("m10_champion", f"{_SCORED} SELECT ARG_MIN(model, log_loss) AS champion FROM met WHERE split = 'validation'")
def _(t):
    return modeling.champion(modeling.evaluate(_scored(t), ["model", "split"], "y", "p"))


@query("m12_lift", f"{_SCORED} SELECT m.model, m.split, round(100 * (b.log_loss - m.log_loss) / b.log_loss, 6) + 0.0::DOUBLE AS log_loss_reduction_pct FROM met m JOIN met b ON b.split = m.split AND b.model = 'constant'")
def _(t):
    lifted = modeling.lift(modeling.evaluate(_scored(t), ["model", "split"], "y", "p"), "constant")
    return lifted.select("model", "split", (F.round("log_loss_reduction_pct", 6) + 0.0).alias("log_loss_reduction_pct"))


@query("m12_feature_set_deltas", f"{_SCORED}, x AS (SELECT MAX(log_loss) FILTER (model = 'line') - MAX(log_loss) FILTER (model = 'constant') AS a, MAX(log_loss) FILTER (model = 'steep') - MAX(log_loss) FILTER (model = 'line') AS b FROM met WHERE split = 'test') SELECT 'line_over_constant' AS comparison, round(a, 6) AS log_loss_delta FROM x UNION ALL SELECT 'steep_over_line', round(b, 6) FROM x")
def _(t):
    metrics = modeling.evaluate(_scored(t), ["model", "split"], "y", "p")
    return rounded(modeling.feature_set_deltas(metrics, {"line_over_constant": ("line", "constant"), "steep_over_line": ("steep", "line")}), "log_loss_delta")


@query("m15_evaluation_report", f"{_SCORED} SELECT model, rows, round(log_loss, 6) AS log_loss, model = (SELECT ARG_MIN(model, log_loss) FROM met WHERE split = 'validation') AS is_champion, model <> 'steep' OR model = (SELECT ARG_MIN(model, log_loss) FROM met WHERE split = 'validation') AS is_shortlist FROM met WHERE split = 'test'")
def _(t):
    report = modeling.evaluation_report(modeling.evaluate(_scored(t), ["model", "split"], "y", "p"), "constant", ["constant", "line"])
    return rounded(report.select("model", "rows", "log_loss", "is_champion", "is_shortlist"), "log_loss")


@query("m6_quality_labels", """WITH s AS (SELECT quality AS y, n_chars / (n_chars + 500.0::DOUBLE) AS p FROM documents JOIN labels USING (doc_id)), b AS (SELECT (SELECT COUNT(*) FROM range(1, 10) e WHERE p > e.range * 0.1::DOUBLE) AS bin, COUNT(*) AS n, AVG(y) AS o, AVG(p) AS q FROM s GROUP BY 1)
  SELECT round(SUM(n * abs(o - q)) / SUM(n), 6) AS expected_calibration_error FROM b""")
def _(t):
    joined = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 500.0)).alias("p"))
    return rounded(modeling.calibration_error(joined, [], "y", "p"), "expected_calibration_error")


_PRED = f"""{BIND}, sc AS (SELECT pitcher_id, pitcher_name, pitcher_team, pitch_type, pitch_name, game_pk, game_date, pitch_id, release_speed, whiff_flag AS actual_event, (CAST(release_spin_rate AS BIGINT) % 1024 + 1) / 1026.0::DOUBLE AS p FROM fact WHERE swing_flag = 1)"""


def _whiffs(t):
    from fieldglass.session import cut_lineage

    swings = t.fact.filter(F.col("swing_flag") == 1).withColumn("p", (F.col("release_spin_rate").cast("bigint") % 1024 + 1) / 1026.0)
    return cut_lineage(modeling.residuals(swings, "whiff_flag", "p"))


@query("m13_residuals", f"{_PRED} SELECT pitch_id, round(p, 6) AS predicted_probability, actual_event, round(actual_event - p, 6) AS actual_minus_expected FROM sc")
def _(t):
    return rounded(_whiffs(t).select("pitch_id", "predicted_probability", "actual_event", "actual_minus_expected"), "predicted_probability", "actual_minus_expected")


@query("m14_pitcher_leaderboard", f"""{_PRED}, g AS (SELECT pitcher_id, COUNT(*) AS sample_size, AVG(p) AS pr, AVG(actual_event) AS observed_rate FROM sc GROUP BY 1 HAVING COUNT(*) >= 30), pp AS (SELECT pitcher_id, pitch_name FROM sc GROUP BY 1, 2 QUALIFY ROW_NUMBER() OVER (PARTITION BY pitcher_id ORDER BY COUNT(*) DESC, pitch_name) = 1)
  SELECT pitcher_id, sample_size, round(pr, 6) AS predicted_rate, round(observed_rate, 6) AS observed_rate, round((pr - (SELECT AVG(p) FROM sc)) * 100, 6) AS model_edge_pp, ROW_NUMBER() OVER (ORDER BY pr DESC, sample_size DESC, pitcher_id) AS rank, pitch_name AS primary_pitch FROM g JOIN pp USING (pitcher_id)""")
def _(t):
    board = modeling.leaderboard(_whiffs(t), ["pitcher_id"], 30, True)
    return rounded(board.select("pitcher_id", "sample_size", "predicted_rate", "observed_rate", "model_edge_pp", "rank", "primary_pitch"), "predicted_rate", "observed_rate", "model_edge_pp")


@query("m14_pitch_type_leaderboard", f"{_PRED} SELECT pitch_type, pitch_name, COUNT(*) AS sample_size, round(AVG(p), 6) AS predicted_rate, COUNT(DISTINCT pitcher_id) AS pitcher_count, ROW_NUMBER() OVER (ORDER BY AVG(p)) AS rank FROM sc GROUP BY 1, 2")
def _(t):
    board = modeling.leaderboard(_whiffs(t), ["pitch_type", "pitch_name"], 1, False)
    return rounded(board.select("pitch_type", "pitch_name", "sample_size", "predicted_rate", "pitcher_count", "rank"), "predicted_rate")


@query("t4_latest_predictions", f"{_PRED} SELECT pitch_id, pitch_type, round(p, 6) AS predicted_probability FROM sc QUALIFY ROW_NUMBER() OVER (PARTITION BY pitch_type ORDER BY game_date DESC, game_pk DESC, pitch_id DESC) <= 250")
def _(t):
    return rounded(modeling.latest_predictions(_whiffs(t), "pitch_type").select("pitch_id", "pitch_type", "predicted_probability"), "predicted_probability")


def _platt_sql(rows: str, name: str, steps: int = 12) -> str:
    """CTEs {name}0, {name}1, ...: Newton steps of slope a (penalised) and intercept b over rows (y, z)."""
    out = [f"{name}0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(steps):
        out.append(f"""{name}{k + 1} AS (SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM (
    SELECT a, b, SUM((q - y) * z) + a AS ga, SUM(q - y) AS gb, SUM(q * (1 - q) * z * z) + 1 AS haa, SUM(q * (1 - q) * z) AS hab, SUM(q * (1 - q)) AS hbb
    FROM (SELECT a, b, y, z, 1 / (1 + exp(-(a * z + b))) AS q FROM {rows}, {name}{k}) GROUP BY a, b))""")
    return ",\n  ".join(out) + f",\n  {name} AS (SELECT a, b FROM {name}{steps})"


def _gate_sql(models: list[str]) -> str:
    ctes, parts = [], []
    for m in models:
        ctes.append(f"""v_{m} AS (SELECT y, p, ln(p / (1 - p)) AS z, ROW_NUMBER() OVER (ORDER BY game_date, event_id) AS i, greatest(1, least(COUNT(*) OVER () - 1, floor(COUNT(*) OVER () * 0.7::DOUBLE))) AS cut FROM s WHERE model = '{m}' AND split = 'validation'),
  head_{m} AS (SELECT y, z FROM v_{m} WHERE i <= cut), {_platt_sql(f'head_{m}', f'part_{m}_')}, {_platt_sql(f'v_{m}', f'all_{m}_')},
  two_{m} AS (SELECT 'raw' AS kind, y, p FROM v_{m} WHERE i > cut UNION ALL SELECT 'calibrated', y, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(a * z + b))))) FROM v_{m}, part_{m}_ WHERE i > cut),
  bin_{m} AS (SELECT kind, (SELECT COUNT(*) FROM range(1, 10) e WHERE p > e.range * 0.1::DOUBLE) AS bin, COUNT(*) AS n, AVG(y) AS o, AVG(p) AS q FROM two_{m} GROUP BY 1, 2),
  met_{m} AS (SELECT kind, AVG(-(y * ln(p) + (1 - y) * ln(1 - p))) AS ll, (SELECT SUM(n * abs(o - q)) / SUM(n) FROM bin_{m} b WHERE b.kind = t.kind) AS ece FROM two_{m} t GROUP BY kind),
  wide_{m} AS (SELECT MAX(ll) FILTER (kind = 'raw') AS raw_ll, MAX(ece) FILTER (kind = 'raw') AS raw_e, MAX(ll) FILTER (kind <> 'raw') AS new_ll, MAX(ece) FILTER (kind <> 'raw') AS new_e FROM met_{m})""")
        ok = "new_ll < raw_ll AND new_e < raw_e"
        parts.append(f"""SELECT '{m}' AS model, (SELECT CAST(MAX(cut) AS BIGINT) FROM v_{m}) AS fit_rows, (SELECT COUNT(*) FROM v_{m} WHERE i > cut) AS check_rows, round(p.a, 6) AS slope, round(p.b, 6) AS intercept,
  round(raw_ll, 6) AS raw_log_loss, round(raw_e, 6) AS raw_ece, round(new_ll, 6) AS calibrated_log_loss, round(new_e, 6) AS calibrated_ece, {ok} AS accepted,
  CASE WHEN {ok} THEN round(f.a, 6) END AS final_slope, CASE WHEN {ok} THEN round(f.b, 6) END AS final_intercept FROM wide_{m}, part_{m}_ p, all_{m}_ f""")
    return f"{_SCORED}, " + ",\n  ".join(ctes) + "\n" + "\nUNION ALL ".join(parts)


@query("m11_calibration_gate", _gate_sql(MODELS))
def _(t):
    """Fitted slopes and both metrics of the tail for each model, and the refit on all rows where the gate accepts."""
    rows = _scored(t).filter(F.col("split") == "validation")
    gates = [modeling.calibration_gate(rows.filter(F.col("model") == m), "y", "p", "game_date", "event_id").withColumn("model", F.lit(m)) for m in MODELS]
    both = gates[0].unionByName(gates[1]).unionByName(gates[2])
    return rounded(both, "slope", "intercept", "raw_log_loss", "raw_ece", "calibrated_log_loss", "calibrated_ece", "final_slope", "final_intercept")


def _training_rows(t):
    """A label that quantity and status decide up to noise of the part number; the other columns say nothing."""
    dealt = F.col("l_quantity") + F.col("l_partkey") % 20 + F.when(F.col("l_linestatus") == "F", 5).otherwise(0)
    return t.lineitem.select(
        fl.as_flag(dealt > 38).cast("double").alias("label"), "l_quantity", F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("l_tax"), "l_discount",
        "l_linestatus", F.concat(F.lit("S"), (F.col("l_suppkey") % 50).cast("string")).alias("supplier_group"), F.year("l_shipdate").alias("year"))


def _later(model, test):
    """Labels and scores of later rows, written once: the metrics read them several times."""
    return cut_lineage(model.score(test, "p").select("label", "p"))


_NUMBERS, _CATEGORIES = ["l_quantity", "l_tax", "l_discount"], ["l_linestatus", "supplier_group"]
_ROWS = """r AS (SELECT (l_quantity + l_partkey % 20 + CASE WHEN l_linestatus = 'F' THEN 5 ELSE 0 END > 38)::INTEGER AS y, CAST(l_quantity AS DOUBLE) AS q, CASE WHEN l_tax > 0 THEN CAST(l_tax AS DOUBLE) END AS raw_tax,
  CAST(l_discount AS DOUBLE) AS d, l_linestatus AS status, 'S' || CAST(l_suppkey % 50 AS VARCHAR) AS supplier, year(l_shipdate) < 1999 AS train FROM lineitem),
  x AS (SELECT row_number() OVER () AS id, y, q, coalesce(raw_tax, (SELECT median(raw_tax) FROM r WHERE train)) AS t, d, status, supplier, train FROM r)"""


def _logistic_sql(steps: int = 12) -> str:
    """Newton steps of two scaled numbers (penalised) and an intercept, each step's 3 x 3 system by Cramer's rule."""
    scaled = "m AS (SELECT AVG(q) AS mq, stddev_pop(q) AS sq, AVG(t) AS mt, stddev_pop(t) AS st FROM x WHERE train), v AS (SELECT y, train, (q - mq) / sq AS u, (t - mt) / st AS w FROM x, m)"
    out = ["n0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c)"]
    det = lambda x, y, z: f"({x[0]} * ({y[1]} * {z[2]} - {z[1]} * {y[2]}) - {y[0]} * ({x[1]} * {z[2]} - {z[1]} * {x[2]}) + {z[0]} * ({x[1]} * {y[2]} - {y[1]} * {x[2]}))"
    one, two, three, g = ("haa", "hab", "hac"), ("hab", "hbb", "hbc"), ("hac", "hbc", "hcc"), ("ga", "gb", "gc")
    whole = det(one, two, three)
    for k in range(steps):
        out.append(f"""n{k + 1} AS (SELECT a - {det(g, two, three)} / {whole} AS a, b - {det(one, g, three)} / {whole} AS b, c - {det(one, two, g)} / {whole} AS c FROM (
    SELECT a, b, c, SUM((p - y) * u) + a AS ga, SUM((p - y) * w) + b AS gb, SUM(p - y) AS gc, SUM(k * u * u) + 1 AS haa, SUM(k * u * w) AS hab, SUM(k * u) AS hac, SUM(k * w * w) + 1 AS hbb, SUM(k * w) AS hbc, SUM(k) AS hcc
    FROM (SELECT *, p * (1 - p) AS k FROM (SELECT *, 1 / (1 + exp(-(a * u + b * w + c))) AS p FROM v, n{k} WHERE train)) GROUP BY a, b, c))""")
    last = f"n{steps}"
    return f"""WITH {_ROWS}, {scaled}, {", ".join(out)}, e AS (SELECT y, 1 / (1 + exp(-(a * u + b * w + c))) AS p FROM v, {last} WHERE NOT train)
  SELECT 'l_quantity' AS term, round(a, 6) AS value FROM {last} UNION ALL SELECT 'l_tax', round(b, 6) FROM {last} UNION ALL SELECT 'intercept', round(c, 6) FROM {last}
  UNION ALL SELECT 'test_log_loss', round(AVG(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) FROM e"""


@query("m8_logistic_fit", _logistic_sql())
def _(t):
    """Coefficients of two numbers, one with missing values, and the log loss of later rows."""
    rows = _training_rows(t)
    model = modeling.fit_logistic(rows.filter(F.col("year") < 1999), "label", ["l_quantity", "l_tax"], [])
    loss = modeling.evaluate(_later(model, rows.filter(F.col("year") >= 1999)), [], "label", "p").select(F.lit("test_log_loss").alias("term"), F.col("log_loss").alias("value"))
    terms = literal_table(rows.sparkSession, list(model.coefficients().items()), "term string, value double")
    return rounded(terms.unionByName(loss), "value")


_STUMPS, _STEP, _L2, _LEAST = 4, 0.08, 1.0, 100


def _stumps_sql() -> str:
    """Rounds of two-leaf trees: gradients and curvatures per column and value, the best cut, the new scores."""
    names = ["l_quantity", "l_tax", "l_discount", "l_linestatus", "supplier_group"]
    fields = ["q", "t", "d", "status", "supplier"]
    out = ["s0 AS (SELECT *, (SELECT ln(AVG(y) / (1 - AVG(y))) FROM x WHERE train) AS score FROM x)"]
    for k in range(_STUMPS):
        values = " UNION ALL ".join(
            f"SELECT {i} AS f, CAST({c} AS VARCHAR) AS v, {c if i < 3 else 'NULL'}::DOUBLE AS o, p - y AS g, p * (1 - p) AS h FROM g{k}" for i, c in enumerate(fields))
        side = "CASE f " + " ".join(f"WHEN {i} THEN CAST({c} AS VARCHAR)" for i, c in enumerate(fields)) + " END"
        out.append(f"""g{k} AS (SELECT *, 1 / (1 + exp(-score)) AS p FROM s{k} WHERE train),
  c{k} AS (SELECT f, v, coalesce(MAX(o), SUM(g) / (SUM(h) + {_L2})) AS o, SUM(g) AS g, SUM(h) AS h, COUNT(*) AS n FROM ({values}) GROUP BY 1, 2),
  l{k} AS (SELECT f, v, o, SUM(g) OVER w AS gl, SUM(h) OVER w AS hl, SUM(n) OVER w AS nl, SUM(g) OVER z AS g, SUM(h) OVER z AS h, SUM(n) OVER z AS n FROM c{k} WINDOW w AS (PARTITION BY f ORDER BY o), z AS (PARTITION BY f)),
  b{k} AS (SELECT *, gl * gl / (hl + {_L2}) + (g - gl) * (g - gl) / (h - hl + {_L2}) - g * g / (h + {_L2}) AS gain FROM l{k} WHERE nl >= {_LEAST} AND n - nl >= {_LEAST} ORDER BY gain DESC, f, o LIMIT 1),
  s{k + 1} AS (SELECT s.* EXCLUDE (score), score - {_STEP} * CASE WHEN {side} IN (SELECT l{k}.v FROM l{k} JOIN b{k} USING (f) WHERE l{k}.o <= b{k}.o) THEN gl / (hl + {_L2}) ELSE (g - gl) / (h - hl + {_L2}) END AS score FROM s{k} s, b{k})""")
    rounds = " UNION ALL ".join(
        f"SELECT {k + 1} AS round, ({names!r})[f + 1] AS feature, CAST(nl AS BIGINT) AS left_rows, round(gain, 4) AS gain FROM b{k}".replace("(['", "['").replace("'])[", "'][") for k in range(_STUMPS))
    return f"""WITH {_ROWS}, {", ".join(out)} {rounds}
  UNION ALL SELECT {_STUMPS + 1}, 'test_log_loss', COUNT(*), round(AVG(ln(1 + exp(CASE WHEN y = 1 THEN -score ELSE score END))), 6) FROM s{_STUMPS} WHERE NOT train"""


@query("m9_boosted_stumps", _stumps_sql())
def _(t):
    """Boosting rounds of two leaves: chosen column, rows on the left and gain of each round, and the log loss of later rows."""
    rows = _training_rows(t)
    train, test = rows.filter(F.col("year") < 1999), rows.filter(F.col("year") >= 1999)
    settings = boosting.Settings(rounds=_STUMPS, leaves=2, step=_STEP, l2=_L2, min_leaf=_LEAST, patience=None)
    model = modeling.fit_boosting(train, "label", _NUMBERS, _CATEGORIES, settings)
    cuts = [(i + 1, model.binning.columns[tree.column[0]], tree.rows[1], float(tree.gain[0])) for i, tree in enumerate(model.trees)]
    chosen = literal_table(t.spark, cuts, "round int, feature string, left_rows bigint, gain double").withColumn("gain", F.round("gain", 4))
    loss = modeling.evaluate(_later(model, test), [], "label", "p")
    return chosen.unionByName(loss.select(F.lit(_STUMPS + 1).alias("round"), F.lit("test_log_loss").alias("feature"), F.col("rows").alias("left_rows"), F.round("log_loss", 6).alias("gain")))


@query("m9_boosting_fit")
def _(t):
    """The stated fit of 160 rounds and 31 leaves: metrics of later rows (no SQL form; tested against a brute-force tree)."""
    rows = _training_rows(t)
    train, test = rows.filter(F.col("year") < 1999), rows.filter(F.col("year") >= 1999)
    model = modeling.fit_boosting(train, "label", _NUMBERS, _CATEGORIES)
    shape = {"trees": len(model.trees), "most_leaves": max(((len(tree.column) + 1) // 2 for tree in model.trees), default=0)}
    scored = modeling.evaluate(_later(model, test), [], "label", "p").select("rows", "log_loss", "roc_auc", "expected_calibration_error")
    return scored.withColumns({name: F.lit(n) for name, n in shape.items()})


@query("m17_league_priors", f"""{BIND}, a AS (SELECT game_pk, pitcher_team, pitcher_id, COUNT(*) FILTER (plate_appearance_event <> 'truncated_pa') AS b, COUNT(*) FILTER (plate_appearance_event LIKE 'strikeout%') AS k, MIN(pitch_number) AS f, ANY_VALUE(game_date) AS d FROM fact JOIN ctx USING (game_pk)
    WHERE game_status IN ('Final', 'Game Over', 'Completed Early') GROUP BY 1, 2, 3), s AS (SELECT *, f = MIN(f) OVER (PARTITION BY game_pk, pitcher_team) AS st FROM a WHERE d <= DATE '2024-01-20')
  SELECT round(AVG(b) FILTER (st), 6) AS start_bf, round(AVG(k) FILTER (st), 6) AS start_k, round(SUM(k) FILTER (st) / SUM(b) FILTER (st), 6) AS start_k_rate, round(SUM(k) / SUM(b), 6) AS opponent_k_rate FROM s""")
def _(t):
    return rounded(forecast.priors(forecast.appearances(t.stored_fact, t.context), "2024-01-20"), "start_bf", "start_k", "start_k_rate", "opponent_k_rate")
