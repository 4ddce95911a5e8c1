"""Rules that the driver tables do not reach: null keys, text ids, refused tables, odd numbers."""

import datetime as dt

from pyspark.sql import functions as F

from fieldglass.functions import text
from fieldglass.operators import ordered, shape
from fieldglass.plans import growth, modeling
from fieldglass.sources import nested


def rows(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def test_null_keys_are_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "k string, v double")
    assert rows(ordered.exact_quantiles(df, ["k"], "v", {"m": 0.5}), "k", "n", "m") == [("a", 1, 2.0), (None, 2, 2.0)]
    ranked = ordered.average_rank_shares(df.withColumn("id", F.monotonically_increasing_id()), ["id", "k"], {"share": ("v", True)}, ["k"])
    assert ranked.where("k is null and share = 1.0").count() == 1
    scored = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.2), ("m", 1, 0.4), ("m", 0, 0.6)], "model string, y int, p double")
    assert rows(modeling.evaluate(scored, ["model"], "y", "p"), "model", "roc_auc") == [("m", 0.0), (None, 1.0)]
    day = dt.datetime(2024, 1, 3)
    seen = spark.createDataFrame([(None, day, 1), (None, day + dt.timedelta(hours=2), 0), ("a", day, 1)], "k string, at timestamp, y int")
    assert sorted(r.prior_2d_count for r in ordered.prior_days(seen, ["k"], "at", "y", 2).collect()) == [0, 0, 1]


def test_text_ids_rank_in_text_order(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("é", 1.0), ("z", 2.0), ("n", None)], "id string, score double")
    got = {r.id: r.rank for r in ordered.unique_rank(df, "score", "id").collect()}
    assert (got["z"], got["a"], got["b"], got["é"], got["n"]) == (1, 2, 3, 4, None)


def test_series_folding_refuses_what_does_not_add_up(spark):
    base = [("g", f"c{i}", 10 - i) for i in range(9)]
    fold = lambda data, value="n", keep=3: rows(shape.group_small_series(spark.createDataFrame(data, f"grp string, cat string, {value} int"), "grp", "cat", value, keep), "cat", value)
    assert ("Other", sum(10 - i for i in range(2, 9))) in fold(base) and len(fold(base)) == 3
    for data, value in ((base + [("g", "x", -1)], "n"), (base + [("g", None, 1)], "n"), (base + [base[0]], "n"), (base + [("g", "Other", 1)], "n"), (base, "avg_rate")):
        assert len(fold(data, value)) == len(data)


def test_one_period_groups_are_not_comparable(spark):
    df = spark.createDataFrame([("a", False, 1, 2), ("a", True, 1, 4), ("b", True, 1, 2)], "g string, late boolean, n int, d int")
    got = {r.g: r for r in growth.rate_decomposition(df, "g", F.col("late"), "n", "d").collect()}
    assert got["a"].comparable and got["a"].within_pp is not None
    assert not got["b"].comparable and got["b"].before_rate is None and got["b"].within_pp is None


def test_plays_without_a_pitch_are_no_appearances(spark):
    feed = '{"gameData":{"game":{"pk":5}},"liveData":{"plays":{"allPlays":[{"about":{"atBatIndex":0},"playEvents":[{"isPitch":true}]},{"about":{"atBatIndex":1},"playEvents":[{"isPitch":false}]}]}}}'
    assert rows(nested.feed_appearances(spark.createDataFrame([(feed,)], "payload string")), "at_bat_number", "pitches") == [(1, 1)]


def test_text_rules(spark):
    said = {"$1,234.50": 1234.5, "−5%": -0.05, "1,23": None, "- € 7": -7.0, "$-5": None, "12abc": None, "": None, ".5": 0.5, "1,000,000": 1e6, "5.": None, "+3": 3.0, "1.2,3": None}
    df = spark.createDataFrame([(k,) for k in said], "t string")
    got = {r.t: r.n for r in df.select("t", text.parse_number(F.col("t")).alias("n")).collect()}
    assert {k: None if v is None else round(v, 9) for k, v in got.items()} == said
    tones = {"Low risk": "positive", "risk-free": "positive", "Moderate": "warning", "elevated rain": "negative", "highway": "positive", "low, risk": "negative"}
    df = spark.createDataFrame([(k,) for k in tones], "t string")
    assert {r.t: r.n for r in df.select("t", text.status_tone(F.col("t")).alias("n")).collect()} == tones
    names = {" Peña’s  Ñu": "pena's nu", "Zoë": "zoe", "Ştefan Đoković": "stefan đokovic", None: None}
    df = spark.createDataFrame([(k,) for k in names], "t string")
    assert {r.t: r.n for r in df.select("t", text.fold_name(F.col("t")).alias("n")).collect()} == names
    dates = {"2024-02": True, "2024-13": False, "2024-02-30": False, "2024-02-29T10:00": True, "2024-02-29x": False, "24-02": False, None: False}
    df = spark.createDataFrame([(k,) for k in dates], "t string")
    assert {r.t: r.n for r in df.select("t", text.is_temporal(F.col("t")).alias("n")).collect()} == dates
    days = {"Mon": 0, "tues.": 1, " SUNDAY ": 6, "Mond": None, "thurs": 3}
    df = spark.createDataFrame([(k,) for k in days], "t string")
    assert {r.t: r.n for r in df.select("t", shape.weekday_number(F.col("t")).alias("n")).collect()} == days
    assert text.is_change_field("growth2") and not text.is_change_field("exchange") and text.is_ratio_field("winShare")
