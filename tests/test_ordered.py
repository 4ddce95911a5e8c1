"""Distributed order operators against brute force, with one key holding most rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import joins, ordered, shape


@pytest.fixture(scope="module")
def events():
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        user = 1 if rnd.random() < 0.7 else rnd.randint(2, 5)  # one hot key
        minute = rnd.randint(0, 60 * 24 * 20) if rnd.random() < 0.8 else 600  # one hot instant
        rows.append((i, user, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minute), rnd.randint(0, 1), rnd.choice([1.0, 1.0, 2.5, 9.0, None])))
    return pd.DataFrame(rows, columns=["id", "user", "ts", "y", "v"])


def test_prior_rows(spark, events):
    df = spark.createDataFrame(events)
    got = ordered.prior_rows(df, ["user"], ordered.numeric_order(df, "ts"), [F.col("ts"), F.col("id")], "y", [7], tie_axis=F.col("id")).select("id", "prior_7_count", "prior_7_rate").toPandas().set_index("id")
    for _, g in events.sort_values(["ts", "id"]).groupby("user"):
        labels = list(g.y)
        for j, i in enumerate(g.id):
            before = labels[max(0, j - 7):j]
            assert got.loc[i].prior_7_count == len(before)
            if before:
                assert abs(got.loc[i].prior_7_rate - sum(before) / len(before)) < 1e-12


def test_prior_days(spark, events):
    got = ordered.prior_days(spark.createDataFrame(events), ["user"], "ts", "y", 3).select("id", "prior_3d_count").toPandas().set_index("id")
    for r in events.itertuples():
        same = events[(events.user == r.user) & (events.ts < r.ts) & (events.ts >= r.ts - pd.Timedelta(days=3))]
        assert got.loc[r.id].prior_3d_count == len(same)


def test_rank_share_matches_pandas(spark, events):
    df = spark.createDataFrame(events).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = ordered.average_rank_share(df, "v", {"up": True, "down": False}).toPandas().set_index("id").sort_index()
    expected_up, expected_down = events.v.rank(pct=True), events.v.rank(pct=True, ascending=False)
    pd.testing.assert_series_equal(got.up, expected_up, check_names=False, check_index=False)
    pd.testing.assert_series_equal(got.down, expected_down, check_names=False, check_index=False)


def test_quantiles_match_pandas(spark, events):
    got = ordered.exact_quantiles(spark.createDataFrame(events), ["user"], "id", {"q": 0.3}).toPandas().set_index("user").q
    for user, g in events.groupby("user"):
        assert abs(got[user] - g.id.quantile(0.3)) < 1e-9


def test_quantiles_of_large_small_and_null_keys(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [("hot", float(v)) for v in np.round(rng.exponential(50, 9_000), 1)] + [("ties", 7.0)] * 6_000 + [("ties", 9.0)] * 10
    rows += [("small", float(v)) for v in range(11)] + [(None, float(v)) for v in rng.normal(size=5_000)] + [("one", 3.5), ("none", None)]
    rows += [("far", float(v)) for v in 10.0 ** rng.uniform(-300, 300, 5_000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    fractions = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9995, "e": 1.0}
    for limit in (10 ** 6, 1):  # one task a key, and split by order buckets
        monkeypatch.setattr(ordered, "_WINDOW", limit)
        got = {r.k: r for r in ordered.exact_quantiles(df, ["k"], "v", fractions).collect()}
        assert set(got) == {"hot", "ties", "small", None, "one", "far"}
        for key, r in got.items():
            values = np.array([v for k, v in rows if k == key])
            assert r.n == len(values)
            for name, f in fractions.items():
                assert np.isclose(r[name], np.quantile(values, f), rtol=1e-12), (key, name)
        higher = {r.k: r.c for r in ordered.exact_quantiles(df, ["k"], "v", {"c": 0.5}, "higher").collect()}
        assert all(higher[k] == np.quantile([v for x, v in rows if x == k], 0.5, method="higher") for k in higher)
    everything = ordered.exact_quantiles(df, [], "v", {"m": 0.25}).collect()
    values = [v for _, v in rows if v is not None]
    assert len(everything) == 1 and everything[0].n == len(values) and np.isclose(everything[0].m, np.quantile(values, 0.25))
    assert ordered.exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_quantiles_do_not_sort_a_busy_key(spark, monkeypatch):
    rows = [("hot", float(v % 977)) for v in range(9_000)] + [(f"k{v % 50}", float(v)) for v in range(1_500)] + [(None, float(v)) for v in range(600)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (10 ** 6, 3):  # all ranges are broadcast, and those of hot keys alone
            monkeypatch.setattr(ordered, "_FEW_KEYS", few, raising=False)
            out = ordered.exact_quantiles(df, ["k"], "v", {"m": 0.37})
            assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
            got = {r.k: (r.n, r.m) for r in out.collect()}
            assert len(got) == 52
            for key, (n, m) in got.items():
                values = [v for k, v in rows if k == key]
                assert n == len(values) and np.isclose(m, np.quantile(values, 0.37))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_unique_rank_with_a_hot_score(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id").cast("double")).alias("s"))
    rows = ordered.unique_rank(df, "s", "id").toPandas().sort_values(["s", "id"], ascending=[False, True])
    assert list(rows["rank"]) == list(range(1, 501))


def test_latest_per_key_prefers_present_order(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5, "b"), (1, 4, "c"), (2, None, "d")], "k int, o int, v string")
    assert {(r.k, r.v) for r in ordered.latest_per_key(df, ["k"], [F.col("o")]).collect()} == {(1, "b"), (2, "d")}


def test_nearest_in_time(spark, events):
    left, right = events[events.y == 0], events[events.y == 1]
    got = joins.nearest_in_time(
        spark.createDataFrame(left[["id", "user", "ts"]]), spark.createDataFrame(right[["user", "ts", "id"]].rename(columns={"id": "rid", "ts": "at"})), ["user"], "ts", "at", ["rid"], 3600
    ).toPandas().set_index("id")
    for r in left.itertuples():
        near = right[right.user == r.user].assign(gap=lambda d: (d.ts - r.ts).abs())  # noqa: B023
        near = near[near.gap <= pd.Timedelta(hours=1)].sort_values(["gap", "ts", "id"])
        value = got.loc[r.id].nearest_rid
        assert (pd.isna(value) and near.empty) or value == near.iloc[0].id


def test_nearest_in_time_of_a_hot_key(spark):
    import bisect
    import random

    random.seed(11)
    moment = lambda s: (pd.Timestamp("2024-03-01") + pd.Timedelta(microseconds=s)).to_pydatetime()
    # One key with nearly all rows inside one tolerance, far rows, repeated instants, a null instant and a null key.
    asks = [(i, "hot", random.randrange(0, 3_600_000_000)) for i in range(1_500)] + [(2_000, "hot", 90_000_000_000), (2_001, "cold", 5), (2_003, None, 7)]
    marks = [("hot", random.randrange(0, 3_600_000_000, 1_000_000), k) for k in range(900)] + [("hot", 93_600_000_000, 901), ("cold", 3_600_000_005, 902), (None, 3_000_007, 903)]
    left = spark.createDataFrame([(i, k, moment(t)) for i, k, t in asks] + [(2_002, "hot", None)], "id int, user string, ts timestamp")
    right = spark.createDataFrame([(k, moment(t), n) for k, t, n in marks], "user string, at timestamp, rid int")
    got = {r.id: r for r in joins.nearest_in_time(left, right, ["user"], "ts", "at", ["rid"], 3600).collect()}
    assert len(got) == len(asks) + 1 and got[2_002].nearest_rid is None
    for i, key, t in asks:
        own = sorted((s, n) for k, s, n in marks if k == key)
        at = bisect.bisect_left(own, (t, -1))
        near = min(own[max(0, at - 3):at + 3], key=lambda m: (abs(m[0] - t), m[0], m[1]))
        first = min(n for s, n in own if s == near[0])
        assert got[i].nearest_rid == (first if abs(near[0] - t) <= 3_600_000_000 else None), i
    # A plain partition by key and slot holds a small part of the hot key.
    slots = {(t // (3_600_000_000 // 64)) for _, k, t in asks if k == "hot"}
    assert len(slots) > 60


def test_waterfall_restarts_at_totals(spark):
    df = spark.createDataFrame([(1, 1, 100.0, True), (1, 2, 20.0, False), (1, 3, -50.0, False), (1, 4, 70.0, True), (1, 5, 5.0, False)], "k int, i int, v double, t boolean")
    rows = shape.waterfall(df, ["k"], "i", "v", "t").orderBy("i").collect()
    assert [r.balance for r in rows] == [100, 120, 70, 70, 75]
    assert [r.baseline for r in rows] == [0, 100, 70, 0, 70]
    assert [r.change for r in rows] == [None, 20, -50, None, 5]


def test_group_small_refuses_repeated_and_other(spark):
    rows = [(c, float(i)) for i, c in enumerate("abcdefghij")]
    df = spark.createDataFrame(rows, "c string, n double")
    folded = {r.c: r.n for r in shape.group_small(df, "c", "n", 4).collect()}
    assert folded == {"j": 9, "i": 8, "h": 7, "Other": 21}
    blocked = df.union(spark.createDataFrame([("other", 1.0)], "c string, n double"))
    assert shape.group_small(blocked, "c", "n", 4).count() == 11
    kept = {r.c for r in shape.group_small(df, "c", "n", 4, ("a",)).collect()}
    assert kept == {"a", "j", "i", "Other"}


def test_series_keep_their_grouping_in_a_filtered_view(spark):
    plans = [f"Plan {i}" for i in range(8)]
    rows = [(day, plan, (8 - i) * (d + 1)) for d, day in enumerate(("2026-08-18", "2026-08-19")) for i, plan in enumerate(plans)]
    df = spark.createDataFrame(rows, "period string, plan string, users long")
    got = {(r.period, r.plan): r.users for r in shape.group_small_series(df, "period", "plan", "users").collect()}
    assert len(got) == 14 and got["2026-08-18", "Other"] == 3 and got["2026-08-19", "Other"] == 6
    kept = {r.plan for r in shape.group_small_series(df, "period", "plan", "users", preserve=("Plan 7",)).collect()}
    assert "Plan 7" in kept and "Plan 5" not in kept and len(kept) == 7
    state = shape.grouping_state(df, "period", "plan", "users")
    assert {r.plan for r in state.where("is_other").collect()} == {"Plan 6", "Plan 7"}
    for visible, other in ((["Plan 0", "Plan 7"], 1), (["Plan 0"], 0), ([], 0), (None, 3)):
        view = {(r.period, r.plan): r.users for r in shape.apply_grouping(df, state, "period", "plan", "users", visible).collect()}
        assert view["2026-08-18", "Other"] == other and view["2026-08-18", "Plan 0"] == 8 and len(view) == 14
    # Nothing is folded: room for all, too many preserved, a rate, a repeated pair, a missing period, a negative value.
    same = lambda rows, **more: sorted(map(tuple, shape.group_small_series(rows, "period", "plan", "users", **more).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert same(df, keep=8) and same(df, preserve=tuple(plans[:7]))
    for extra in (("2026-08-18", "Plan 0", 1), (None, "Plan 0", 1), ("2026-08-20", "Plan 0", -1), ("2026-08-20", "other", 1)):
        assert same(df.union(spark.createDataFrame([extra], df.schema)))
    rate = df.withColumnRenamed("users", "adoptionRate")
    assert shape.group_small_series(rate, "period", "plan", "adoptionRate").count() == 16


def test_order_evidence_of_an_axis(spark):
    places = lambda labels, **more: [r.place for r in shape.calendar_place(spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "i int, v string"), "v", **more).orderBy("i").collect()]
    assert places(["Tue", "monday", "Sun."]) == [1, 0, 6]
    assert places(["Tue", "Mon", "Tue"]) == [None] * 3 and places(["Tue", None]) == [None] * 2
    assert places(["2026-03", "2025-12"]) == [1772323200000, 1764547200000]
    assert places(["2026-03-01T06:00:00", "2026-02-28"]) == [1772344800000, 1772236800000]
    assert places(["2026-03", "Mon"]) == [None] * 2 and places(["2026-13", "2026-01"]) == [None] * 2
    assert places(["b", "x", "a"], explicit=["a", "b"]) == [1, 2, 0]
    assert places(["Tue", "Mon"], sort_order="original") == [None] * 2
    assert places(["a", "b"], explicit=["b", "a"], sort_order="ascending") == [None] * 2


def test_grid_with_null_axes_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 6.0), (None, 2, 7.0), ("a", None, 8.0)], "x string, y int, v double")
    got = sorted(((r.x, r.y, r.v, r.missing) for r in shape.densify(df, "x", "y", "v").collect()), key=str)
    assert got == sorted([("a", 1, 5.0, False), ("a", 2, 0.0, True), ("b", 1, 0.0, True), ("b", 2, 6.0, False), (None, 1, 0.0, True), (None, 2, 0.0, True)], key=str)
    assert shape.densify(df.limit(0), "x", "y", "v").count() == 0


def test_isolated_points_in_a_hot_and_a_null_key(spark):
    from fieldglass.operators.shape import isolated_points

    data = [(None if i % 10 == 0 else "hot" if i % 10 < 8 else f"k{i % 7}", i // 3, i, 1.0 if i * 7919 % 5 < 2 else None) for i in range(600)]
    df = spark.createDataFrame(data, "k string, at int, id int, v double").repartition(5)
    expected = set()
    for key in {row[0] for row in data}:
        line = sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2]))
        for before, here, after in zip([None, *line], line, [*line[1:], None]):
            if here[3] is not None and all(n is None or n[3] is None for n in (before, after)):
                expected.add(here[2])
    assert {r["id"] for r in isolated_points(df, ["k"], ["at", "id"], "v").collect()} == expected


def test_limits_place_values_in_order(spark):
    from fieldglass.operators.ordered import with_order_bucket

    df = spark.createDataFrame([(None if i % 50 == 0 else float(i * i % 997 if i % 3 else 5),) for i in range(3000)], "v double")
    rows = with_order_bucket(df, F.col("v")).collect()
    assert all((r["__bucket"] == -1) == (r["v"] is None) for r in rows)
    placed = sorted((r["v"], r["__bucket"]) for r in rows if r["v"] is not None)
    assert all(a[1] <= b[1] for a, b in zip(placed, placed[1:]))
    # The value of a third of the rows has a bucket of its own.
    assert {v for v, b in placed if b == dict(placed)[5.0]} == {5.0}


def test_seeded_cap_is_exact_and_repeatable(spark):
    from fieldglass.plans.modeling import seeded_cap

    df = spark.range(20000).withColumn("at", F.col("id") % 100)
    ids = lambda d, n: [r["id"] for r in seeded_cap(d, ["id"], n, 3, "at").collect()]
    assert len(ids(df, 700)) == 700 and ids(df, 700) == ids(df.repartition(7), 700)
    assert len(ids(df.limit(50), 700)) == 50 and not ids(df.limit(0), 5)


def test_first_event_is_marked_once_with_null_keys(spark):
    from fieldglass.plans.history import first_event_of_game

    df = spark.createDataFrame([(None, 1, 5, 2), (None, 1, 5, 1), ("a", 1, 3, 9), ("a", 2, None, 4), ("a", 2, 1, 3)], "k string, g int, at int, id int")
    assert {r["id"] for r in first_event_of_game(df, ["k"], "g", ["at", "id"]).filter("is_first").collect()} == {1, 9, 4}


def test_seeded_cap_is_full_when_a_key_repeats(spark):
    from fieldglass.plans.modeling import seeded_cap

    df = spark.range(4_000).selectExpr("if(id % 2 = 0, 0L, id) AS id", "id AS at")
    assert all(seeded_cap(df, ["id"], 500, seed, "at").count() == 500 for seed in range(8))
