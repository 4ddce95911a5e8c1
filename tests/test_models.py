"""Boosted trees and Newton fits against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.plans import boosting, modeling, newton
from fieldglass.plans.boosting import Settings


def made_rows(n, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        x, z, kind = float(rng.integers(0, 30)), float(rng.normal()), f"k{int(rng.integers(0, 12))}"
        push = 0.15 * (x - 15) + 0.8 * z * (kind < "k5") + (kind in ("k3", "k7")) - 0.4
        y = float(rng.random() < 1 / (1 + np.exp(-push)))
        out.append((y, None if rng.random() < 0.05 else x, z, None if rng.random() < 0.05 else kind))
    return out


SCHEMA = "y double, x double, z double, kind string"


def brute_gain(g, h, left, l2):
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
    return score(left) + score(~left) - score(np.ones(len(g), dtype=bool))


def brute_tree(bins, g, h, numeric, settings):
    """Best first by trying every cut of every column on the rows themselves: {leaf rows: value}."""
    def best(rows):
        top = None
        for k in range(bins.shape[1]):
            values = np.unique(bins[rows, k])
            if k >= numeric:
                ratio = [g[rows][bins[rows, k] == v].sum() / (h[rows][bins[rows, k] == v].sum() + settings.l2) for v in values]
                values = values[np.argsort(ratio, kind="stable")]
            for cut in range(1, len(values)):
                left = np.isin(bins[rows, k], values[:cut])
                if min(left.sum(), (~left).sum()) < settings.min_leaf:
                    continue
                gain = brute_gain(g[rows], h[rows], left, settings.l2)
                if gain > 1e-12 and (top is None or gain > top[0] + 1e-9):
                    top = (gain, rows[left], rows[~left])
        return top

    leaves = [(np.arange(len(g)),)]
    open_ = [(best(leaves[0][0]), leaves[0][0])]
    done = []
    while len(done) + len(open_) < settings.leaves:
        live = [o for o in open_ if o[0] is not None]
        if not live:
            break
        split, rows = max(live, key=lambda o: o[0][0])
        open_ = [o for o in open_ if o[1] is not rows] + [(best(part), part) for part in split[1:]]
    return {tuple(rows): -settings.step * g[rows].sum() / (h[rows].sum() + settings.l2) for _, rows in open_}


@pytest.fixture(scope="module")
def fitted(spark):
    frame = spark.createDataFrame(made_rows(5_000), SCHEMA)
    settings = Settings(rounds=3, min_leaf=60)
    return frame, settings, boosting.fit(frame, "y", ["x", "z"], ["kind"], settings)


def test_trees_equal_brute_force(fitted):
    frame, settings, model = fitted
    rows = frame.toPandas()
    bins = model.binning.encode([rows[c] for c in model.binning.columns])
    y, score = rows.y.to_numpy(), np.full(len(rows), model.start)
    assert len(model.trees) == 3 and model.start == pytest.approx(np.log(y.mean() / (1 - y.mean())))
    for tree in model.trees:
        p = 1 / (1 + np.exp(-score))
        want = brute_tree(bins, p - y, p * (1 - p), 2, settings)
        leaf = tree.route(bins)
        got = {tuple(np.flatnonzero(leaf == n)): tree.value[n] for n in np.unique(leaf)}
        assert len(got) == 31 and set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k], abs=1e-10) for k in got)
        score = score + np.array(tree.value)[leaf]
    scored = model.score(frame, "p").toPandas()
    assert np.allclose(scored.p, 1 / (1 + np.exp(-score)))


def test_rounds_as_jobs_give_the_same_trees(spark, fitted):
    frame, settings, model = fitted
    spread = boosting.fit(frame.repartition(5), "y", ["x", "z"], ["kind"], settings, task_cells=10)
    for one, other in zip(model.trees, spread.trees, strict=True):
        assert one.column == other.column and one.rows == other.rows
        assert np.allclose(one.value, other.value, atol=1e-10)


def test_scores_are_written_and_rounds_stop_early(spark):
    frame = spark.createDataFrame([(float(i % 2), float(i % 7), 0.0, "a") for i in range(2_000)], SCHEMA)
    settings = Settings(rounds=30, leaves=3, min_leaf=20, patience=3, early_from=100)
    for cells in (10, 10 ** 6):
        model = boosting.fit(frame, "y", ["x", "z"], ["kind"], settings, task_cells=cells)
        assert 3 <= len(model.trees) < 30  # noise: held-out rows do not improve
    longer = boosting.fit(frame, "y", ["x"], [], Settings(rounds=10, leaves=3, min_leaf=20), task_cells=10)
    whole = boosting.fit(frame, "y", ["x"], [], Settings(rounds=10, leaves=3, min_leaf=20))
    assert len(longer.trees) == 10 and np.allclose([t.value[-1] for t in longer.trees], [t.value[-1] for t in whole.trees])


def test_boosting_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert boosting.fit(empty, "y", ["x"], ["kind"]).trees == []
    nulls = spark.createDataFrame([(float(i % 2), None, float("nan"), None) for i in range(300)] + [(None, 1.0, 1.0, "a")], SCHEMA)
    model = boosting.fit(nulls, "y", ["x", "z"], ["kind"], Settings(rounds=2))
    assert [r.p for r in model.score(nulls, "p").select("p").distinct().collect()] == [pytest.approx(0.5)]
    # Over 254 categories: the rarest share a bin with unseen ones, whatever their number.
    many = spark.createDataFrame([(float(i % 3 == 0), float(i), 0.0, f"c{i % 400}") for i in range(4_000)], SCHEMA)
    model = boosting.fit(many, "y", [], ["kind"], Settings(rounds=2, min_leaf=5))
    assert len(model.binning.codes["kind"]) == 255 and model.trees
    unseen = spark.createDataFrame([(None, None, None, "never seen")], SCHEMA)
    assert 0 < model.score(unseen, "p").first().p < 1
    with pytest.raises(ValueError):
        modeling.fit_boosting(many, "y", ["launch_speed"], [])


def brute_newton(x, y, penalty):
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return w


def test_logistic_coefficients_equal_dense_newton(spark):
    rows = made_rows(3_000, 2)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = modeling.fit_logistic(frame, "y", ["x", "z"], ["kind"], minimum=240)
    table = frame.toPandas()
    counts = table.kind.value_counts()
    mode = sorted(counts[counts == counts.max()].index)[0]
    kept = sorted(counts[counts >= 240].index)
    assert 0 < len(kept) < len(counts)
    filled = table.kind.fillna(mode)
    columns, names = [], []
    for c in ("x", "z"):
        v = table[c].fillna(table[c].median())
        columns.append((v - v.mean()) / v.std(ddof=0))
        names.append(c)
    for k in kept:
        columns.append((filled == k).astype(float))
        names.append(f"kind={k}")
    columns += [(~filled.isin(kept)).astype(float), np.ones(len(table))]
    names += [f"kind={newton.RARE}", "intercept"]
    w = brute_newton(np.column_stack(columns), table.y.to_numpy(), np.r_[np.ones(len(names) - 1), 0.0])
    got = model.coefficients()
    assert set(got) == set(names) and all(got[n] == pytest.approx(v, abs=1e-8) for n, v in zip(names, w))
    # A category that training never saw adds nothing.
    row = spark.createDataFrame([(None, None, None, "new")], SCHEMA)
    base = got["intercept"] + got["x"] * (table.x.median() - table.x.fillna(table.x.median()).mean()) / table.x.fillna(table.x.median()).std(ddof=0)
    base += got["z"] * (table.z.median() - table.z.mean()) / table.z.std(ddof=0)
    assert model.score(row, "p").first().p == pytest.approx(1 / (1 + np.exp(-base)))


def test_wide_designs_fall_back_to_the_same_optimum(spark):
    frame = spark.createDataFrame(made_rows(1_500, 3), SCHEMA)
    exact = modeling.fit_logistic(frame, "y", ["x", "z"], ["kind"], minimum=1)
    other = modeling.fit_logistic(frame, "y", ["x", "z"], ["kind"], minimum=1, max_columns=4)
    assert isinstance(other, modeling.FittedModel)
    both = exact.score(other.score(frame, "q"), "p").select(F.max(F.abs(F.col("p") - F.col("q"))).alias("d"))
    assert both.first().d < 0.02


def gated(spark, scale, n=4_000):
    rng = np.random.default_rng(4)
    p = rng.uniform(0.02, 0.98, n)
    y = (rng.random(n) < p).astype(float)
    z = scale * np.log(p / (1 - p))
    rows = [(i, f"2024-01-{1 + i * 20 // n:02d}", float(a), float(b)) for i, (a, b) in enumerate(zip(y, 1 / (1 + np.exp(-z))))]
    return spark.createDataFrame(rows, "id long, day string, y double, p double").withColumn("day", F.to_date("day"))


def test_calibration_gate_accepts_refits_and_rejects(spark):
    sharp = gated(spark, 3.0)
    gate = modeling.calibration_gate(sharp, "y", "p", "day", "id")
    row = gate.first()
    assert row.accepted and row.fit_rows == 2_800 and row.check_rows == 1_200
    table = sharp.toPandas()
    z = np.log(table.p / (1 - table.p)).to_numpy()
    x = np.column_stack([z, np.ones(len(z))])
    for rows, got in ((slice(0, 2_800), (row.slope, row.intercept)), (slice(None), (row.final_slope, row.final_intercept))):
        assert np.allclose(brute_newton(x[rows], table.y.to_numpy()[rows], np.array([1.0, 0.0])), got, atol=1e-8)
    moved = modeling.apply_gate(sharp, gate, "p").toPandas()
    assert np.allclose(moved.calibrated_probability, 1 / (1 + np.exp(-(row.final_slope * z + row.final_intercept))))
    fine = gated(spark, 1.0)
    gate = modeling.calibration_gate(fine, "y", "p", "day", "id")
    row = gate.first()
    if row.accepted:  # a calibrated score gains nothing that both metrics confirm
        assert row.calibrated_log_loss < row.raw_log_loss and row.calibrated_ece < row.raw_ece
    constant = fine.withColumn("p", F.lit(0.5)).withColumn("y", (F.col("id") % 2).cast("double"))
    gate = modeling.calibration_gate(constant, "y", "p", "day", "id")
    assert not gate.first().accepted and gate.first().final_slope is None
    assert {r.calibrated_probability for r in modeling.apply_gate(constant, gate, "p").collect()} == {0.5}


def test_required_columns_and_split_order(spark):
    frame = spark.createDataFrame([("2024-01-01", 1), ("2024-01-15", 2), ("2024-01-25", 3)], "game_date string, v int")
    assert modeling.require_columns(frame, ["v"]) is frame
    with pytest.raises(ValueError, match="missing"):
        modeling.require_columns(frame, ["v", "w"])
    bounds = modeling.Boundaries("2024-01-12", "2024-01-13", "2024-01-22", "2024-01-30")
    modeling.check_split(modeling.time_split(frame, bounds))
    with pytest.raises(ValueError, match="no rows"):
        modeling.check_split(modeling.time_split(frame.limit(2).where("v < 3"), bounds))
    overlap = frame.select("game_date", F.when(F.col("v") == 2, "train").when(F.col("v") == 1, "validation").otherwise("test").alias("split"))
    with pytest.raises(ValueError, match="before"):
        modeling.check_split(overlap)


def test_equal_coded_rows_are_one_weighted_row(spark, monkeypatch):
    """A table of many copies fits in one task, where rounds as jobs would take one job each."""
    rows = made_rows(400, seed=3)
    frame = spark.createDataFrame(rows, SCHEMA)
    settings = Settings(rounds=3, leaves=6, min_leaf=200, patience=None)
    copies = frame.crossJoin(spark.range(20)).drop("id")
    jobs = boosting.fit(copies, "y", ["x", "z"], ["kind"], settings, task_cells=10)
    monkeypatch.setattr(boosting, "AcrossTasks", None)
    model = boosting.fit(copies, "y", ["x", "z"], ["kind"], settings, task_cells=400 * 3)
    assert len(model.trees) == 3 and model.trees[0].rows[0] == 8_000
    for one, other in zip(model.trees, jobs.trees, strict=True):
        assert one.column == other.column and one.rows == other.rows and np.allclose(one.value, other.value, atol=1e-10)
    bins = np.repeat(model.binning.encode([frame.toPandas()[c] for c in model.binning.columns]), 20, axis=0)
    y, score = np.repeat([r[0] for r in rows], 20), np.full(8_000, model.start)
    p = 1 / (1 + np.exp(-score))
    want = sorted(brute_tree(bins, p - y, p * (1 - p), 2, settings).values())
    assert np.allclose(sorted(v for v, c in zip(model.trees[0].value, model.trees[0].column) if c < 0), want)
