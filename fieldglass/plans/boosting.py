"""Gradient-boosted trees from histograms of gradients: leaf cap, best-first growth, L2 in the gain.

Columns are coded once into at most 256 bins.  A tree grows best first: leaves wait with the gain of
their best split, and the largest gain is taken until the leaf cap is reached.  All leaves that the cap
could still admit are evaluated together, so a tree needs about as many rounds as it is deep.  A round asks
for the histograms of the smaller child of each pair; the other is the parent's minus it.

Rounds are Spark jobs: every task adds up gradients and curvatures per (node, column, bin) of its rows, and
the sums of all tasks come back as at most leaves x columns x 256 cells.  Scores of finished trees are
written every few trees, so a round replays only the trees since then.  Rows that are coded alike and share label
and held-out mark are one weighted row, as no sum can tell them apart.  A table of at most `TASK_CELLS` cells of
such rows is one task's share; there the same rounds run inside that task, with the same sums.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.ordered import exact_quantiles
from fieldglass.session import cut_lineage

BINS = 256
OTHER = 255  # bin of rare, unknown and unseen categories
TASK_CELLS = 8_000_000  # rows x columns that one task may hold
_KEPT_TREES = 8  # trees between two writings of the scores


@dataclass(frozen=True)
class Settings:
    """Stated training settings.

    Tables of over `early_from` rows hold `holdout` of them out and stop once `patience` rounds bring no
    improvement there; without `patience` no row is held out.
    """

    rounds: int = 160
    step: float = 0.08
    leaves: int = 31
    min_leaf: int = 100
    l2: float = 1.0
    patience: int | None = 10
    early_from: int = 10_000
    holdout: float = 0.1
    seed: int = 42


@dataclass
class Binning:
    """Limits of numeric columns and bins of categories, learned from the training rows."""

    numeric: list[str]
    categorical: list[str]
    medians: dict = field(default_factory=dict)
    limits: dict = field(default_factory=dict)
    codes: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def fit(self, train: DataFrame) -> Binning:
        """A number gets a bin per value if there are few values, otherwise per 255th part; categories by frequency."""
        if self.numeric:
            number = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in self.numeric}
            long = train.select([v.alias(c) for c, v in number.items()]).unpivot([], self.numeric, "name", "value")
            self.medians = dict.fromkeys(self.numeric, 0.0) | {r["name"]: r["m"] for r in exact_quantiles(long, ["name"], "value", {"m": 0.5}).collect()}
            first = train.agg(*[F.approx_count_distinct(v, 0.02).alias(c) for c, v in number.items()]).first()
            few = [c for c in self.numeric if first[c] < 200]
            many = [c for c in self.numeric if c not in few]
            shares = [i / (BINS - 1) for i in range(1, BINS - 1)]
            found = train.agg(F.count(F.lit(1)), *[F.sort_array(F.collect_set(number[c])).alias(c) for c in few],
                              *[F.percentile_approx(number[c], shares, 10_000).alias(c) for c in many]).first()
            for c in self.numeric:
                values = sorted(set(found[c] or []) | ({self.medians[c]} if c in few else set()))
                # A limit between two values: rows of the lower one stay at or below it.
                self.limits[c] = [(a + b) / 2 for a, b in zip(values, values[1:])] if c in few else values
        for c in self.categorical:
            counts = train.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count()
            top = counts.orderBy(F.desc("count"), "v").limit(OTHER).collect()
            self.codes[c] = {r["v"]: i for i, r in enumerate(top)}
            self.modes[c] = top[0]["v"] if top else None
        return self

    def encode(self, columns: list[pd.Series]) -> np.ndarray:
        """Rows x columns of bins; missing numbers are the median, missing categories the most frequent one."""
        coded = np.empty((len(columns[0]) if columns else 0, len(columns)), dtype=np.uint8)
        for k, (c, values) in enumerate(zip(self.columns, columns)):
            if c in self.limits:
                number = values.to_numpy(dtype=float, na_value=np.nan)
                number = np.where(np.isnan(number), self.medians[c], number)
                coded[:, k] = np.searchsorted(np.array(self.limits[c]), number, side="left")
            else:
                filled = values.where(values.notna(), self.modes[c])
                coded[:, k] = filled.map(self.codes[c]).fillna(OTHER).to_numpy(dtype=np.uint8)
        return coded

    def sources(self) -> list:
        return [F.col(c).cast("double") for c in self.numeric] + [F.col(c).cast("string") for c in self.categorical]


@dataclass
class Tree:
    """Nodes in order of creation; a leaf has column -1.  `left` tells per bin if it goes to the first child."""

    column: list = field(default_factory=lambda: [-1])
    left: list = field(default_factory=lambda: [None])
    child: list = field(default_factory=lambda: [(0, 0)])
    value: list = field(default_factory=lambda: [0.0])
    rows: list = field(default_factory=lambda: [0])  # training rows of the node
    gain: list = field(default_factory=lambda: [0.0])  # of its split

    def split(self, node: int, column: int, left: np.ndarray) -> tuple[int, int]:
        first = len(self.column)
        self.column[node], self.left[node], self.child[node] = column, left, (first, first + 1)
        for _ in range(2):
            self.column.append(-1)
            self.left.append(None)
            self.child.append((0, 0))
            self.value.append(0.0)
            self.rows.append(0)
            self.gain.append(0.0)
        return first, first + 1

    def route(self, bins: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row, from the root or from the nodes that `node` holds (changed in place)."""
        node = np.zeros(len(bins), dtype=np.int64) if node is None else node
        column, child = np.array(self.column), np.array(self.child)
        left = np.array([np.zeros(BINS, dtype=bool) if side is None else side for side in self.left])
        rows = np.flatnonzero(column[node] >= 0)
        while len(rows):
            at = node[rows]
            to_first = left[at, bins[rows, column[at]]]
            node[rows] = np.where(to_first, child[at, 0], child[at, 1])
            rows = rows[column[node[rows]] >= 0]
        return node


class Block:
    """Rows in memory: bins, labels, held-out marks, weights and scores so far."""

    def __init__(self, bins: np.ndarray, label: np.ndarray, held: np.ndarray, weight: np.ndarray, score: np.ndarray):
        self.bins, self.label, self.held, self.weight, self.score = bins, label, held, weight, score
        # What histograms read: training rows, a column at a time, and the node that each has reached.
        self.train = np.flatnonzero(~held)
        self.own = bins[self.train]
        self.by_column = np.ascontiguousarray(self.own.T)
        self.tree, self.node = None, None
        self.gradients()

    def gradients(self):
        p = 1 / (1 + np.exp(-self.score[self.train]))
        weight = self.weight[self.train]
        self.sums = [weight * (p - self.label[self.train]), weight * p * (1 - p), weight]

    def add(self, tree: Tree):
        self.score = self.score + np.array(tree.value)[tree.route(self.bins)]
        self.gradients()

    def loss(self) -> np.ndarray:
        """Summed log loss and count of the held-out rows."""
        kept = self.held
        sign = np.where(self.label[kept] > 0.5, -1.0, 1.0)
        return np.array([(self.weight[kept] * np.logaddexp(0.0, sign * self.score[kept])).sum(), self.weight[kept].sum()], dtype=float)

    def histograms(self, tree: Tree, wanted: list[int]) -> np.ndarray:
        """(node, column, bin, [gradient, curvature, rows]) of the wanted nodes; a tree that grew is walked on from there."""
        if self.tree is not tree:
            self.tree, self.node = tree, np.zeros(len(self.train), dtype=np.int64)
        slot = np.full(len(tree.column), -1)
        slot[wanted] = np.arange(len(wanted))
        at = slot[tree.route(self.own, self.node)]
        rows = np.flatnonzero(at >= 0)
        at, out = at[rows] * BINS, np.zeros((len(wanted), len(self.by_column), BINS, 3))
        sums = [values[rows] for values in self.sums]
        for k, column in enumerate(self.by_column):
            cell = at + column[rows]
            for m, values in enumerate(sums):
                out[:, k, :, m] = np.bincount(cell, values, minlength=len(wanted) * BINS).reshape(len(wanted), BINS)
        return out


class InTask:
    """Rounds over one block."""

    def __init__(self, block: Block):
        self.block = block

    def histograms(self, tree: Tree, wanted: list[int]) -> np.ndarray:
        return self.block.histograms(tree, wanted)

    def loss(self) -> np.ndarray:
        return self.block.loss()

    def add(self, tree: Tree):
        self.block.add(tree)


def _blocks(batches, trees: list[Tree]):
    for frame in batches:
        if len(frame):
            bins = np.frombuffer(b"".join(frame["bins"]), dtype=np.uint8).reshape(len(frame), -1)
            block = Block(bins, frame["label"].to_numpy(dtype=float), frame["held"].to_numpy(dtype=bool),
                          frame["weight"].to_numpy(dtype=float), frame["score"].to_numpy(dtype=float))
            for tree in trees:
                block.add(tree)
            yield frame, block


class AcrossTasks:
    """Rounds as Spark jobs over (bins, label, held, weight, score)."""

    def __init__(self, rows: DataFrame, width: int):
        self.rows, self.width, self.trees, self.root = rows, width, [], None

    def _summed(self, of) -> dict[int, np.ndarray]:
        trees = list(self.trees)

        def run(batches):
            total = None
            for _, block in _blocks(batches, trees):
                part = of(block)
                total = part if total is None else total + part
            if total is not None:
                cells = np.flatnonzero(total.any(axis=1))
                yield pd.DataFrame({"cell": cells, "a": total[cells, 0], "b": total[cells, 1], "c": total[cells, 2]})

        sums = self.rows.mapInPandas(run, "cell long, a double, b double, c double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "abc"])
        found = sums.toPandas()  # at most leaves x columns x 256 rows
        return found["cell"].to_numpy(dtype=np.int64), found[["a", "b", "c"]].to_numpy(dtype=float)

    def histograms(self, tree: Tree, wanted: list[int]) -> np.ndarray:
        if wanted == [0] and self.root is not None:
            return self.root
        cells, sums = self._summed(lambda block: block.histograms(tree, wanted).reshape(-1, 3))
        out = np.zeros((len(wanted) * self.width * BINS, 3))
        out[cells] = sums
        return out.reshape(len(wanted), self.width, BINS, 3)

    def loss(self) -> np.ndarray:
        """The loss, and in the same job the first histograms of the next tree."""
        cells, sums = self._summed(lambda block: np.vstack([[[*block.loss(), 0.0]], block.histograms(Tree(), [0]).reshape(-1, 3)]))
        out = np.zeros((1 + self.width * BINS, 3))
        out[cells] = sums
        self.root = out[1:].reshape(1, self.width, BINS, 3)
        return out[0, :2]

    def add(self, tree: Tree):
        self.root = None
        self.trees.append(tree)
        if len(self.trees) >= _KEPT_TREES:
            trees = list(self.trees)

            def run(batches):
                for frame, block in _blocks(batches, trees):
                    yield frame.assign(score=block.score)

            self.rows, self.trees = cut_lineage(self.rows.mapInPandas(run, "bins binary, label double, held boolean, weight double, score double")), []


def split_gains(sums: np.ndarray, categorical: bool, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of bins, gain of a cut after each place, rows before the cut); -inf where a side would be too small.

    Numbers keep the order of their bins; categories are ordered by gradient over curvature, which holds
    the best cut of all subsets.
    """
    present = sums[:, 2] > 0
    order = np.flatnonzero(present)
    if categorical:
        order = order[np.argsort(sums[order, 0] / (sums[order, 1] + settings.l2), kind="stable")]
    running = np.cumsum(sums[order], axis=0)
    if not len(order):
        return order, np.zeros(0), np.zeros(0)
    total = running[-1]
    score = lambda part: part[..., 0] ** 2 / (part[..., 1] + settings.l2)
    gain = score(running) + score(total - running) - score(total)
    small = (running[:, 2] < settings.min_leaf) | (total[2] - running[:, 2] < settings.min_leaf)
    return order, np.where(small, -np.inf, gain), running[:, 2]


def best_split(sums: np.ndarray, numeric: int, settings: Settings) -> tuple[float, int, np.ndarray] | None:
    """(gain, column, bins that go left) of one node, or None if no cut gains; ties to the first column and cut."""
    best = None
    for k in range(len(sums)):
        order, gain, _ = split_gains(sums[k], k >= numeric, settings)
        at = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[at] > 1e-12 and (best is None or gain[at] > best[0]):
            best = (float(gain[at]), k, (order, at))
    if best is None:
        return None
    gain, k, (order, at) = best
    left = np.zeros(BINS, dtype=bool)
    if k < numeric:
        left[:order[at] + 1] = True
    else:
        left[order[:at + 1]] = True
    return gain, k, left


def grow(source, numeric: int, settings: Settings) -> Tree:
    """One tree, best first, from the histograms that `source` gives."""
    tree = Tree()
    sums = {0: source.histograms(tree, [0])[0]}
    splits = {0: best_split(sums[0], numeric, settings)}
    spread = Tree()  # the evaluated part: every node whose children have histograms
    real = {0: 0}  # node of `tree` -> node of `spread`
    heap, leaves = ([(-splits[0][0], 0)] if splits[0] else []), 1
    while heap and leaves < settings.leaves:
        if spread.column[real[heap[0][1]]] < 0:
            # Evaluate the children of all leaves that the cap could still admit, in one round.
            open_ = [n for n in range(len(spread.column)) if spread.column[n] < 0 and splits.get(n)]
            open_ = sorted(open_, key=lambda n: (-splits[n][0], n))[:settings.leaves - leaves]
            pairs = []
            for n in open_:
                _, column, left = splits[n]
                first, second = spread.split(n, column, left)
                rows_left = sums[n][column, left, 2].sum()
                less = first if rows_left * 2 <= sums[n][column, :, 2].sum() else second
                pairs.append((n, less, first + second - less))
            found = source.histograms(spread, [less for _, less, _ in pairs])
            for (n, less, more), part in zip(pairs, found):
                sums[less], sums[more] = part, sums[n] - part
                # Subtraction leaves rounding in empty bins.
                sums[more][sums[more][..., 2] < 0.5] = 0.0
                for child in (less, more):
                    splits[child] = best_split(sums[child], numeric, settings)
        _, node = heapq.heappop(heap)
        at = real[node]
        _, column, left = splits[at]
        for mine, theirs in zip(tree.split(node, column, left), spread.child[at]):
            real[mine] = theirs
            if splits[theirs]:
                heapq.heappush(heap, (-splits[theirs][0], mine))
        leaves += 1
    for node, at in real.items():
        total = sums[at][0].sum(axis=0)
        tree.rows[node] = int(round(total[2]))
        if tree.column[node] >= 0:
            tree.gain[node] = splits[at][0]
        else:
            tree.value[node] = -settings.step * total[0] / (total[1] + settings.l2)
    return tree


def boost(source, numeric: int, settings: Settings) -> list[Tree]:
    """Trees in order; with `patience` they end once the last rounds did not improve the held-out loss."""
    trees, losses = [], []
    for _ in range(settings.rounds):
        if settings.patience is not None:
            total, n = source.loss()
            losses.append(total / max(n, 1.0))
            recent = losses[-settings.patience:]
            if len(losses) > settings.patience and min(recent) >= losses[-settings.patience - 1] - 1e-7:
                break
        tree = grow(source, numeric, settings)
        trees.append(tree)
        source.add(tree)
    return trees


@dataclass
class BoostedModel:
    binning: Binning
    trees: list
    start: float

    def score(self, df: DataFrame, name: str = "prediction_probability") -> DataFrame:
        """`df` with the predicted probability, by Arrow batches."""
        binning, trees, start = self.binning, self.trees, self.start

        @F.pandas_udf("double")
        def probability(*columns: pd.Series) -> pd.Series:
            bins = binning.encode(list(columns))
            total = np.full(len(bins), start)
            for tree in trees:
                total += np.array(tree.value)[tree.route(bins)]
            return pd.Series(1 / (1 + np.exp(-total)))

        return df.withColumn(name, probability(*binning.sources()))


def coded(train: DataFrame, label: str, binning: Binning, settings: Settings) -> tuple[DataFrame, int, float]:
    """(bins, label, held, weight, score) of rows with a label, how many of these there are, and the starting score."""
    draw = F.pmod(F.xxhash64(*binning.sources(), F.lit(settings.seed)), F.lit(10_000)) / 10_000
    held = (draw < settings.holdout) if settings.patience is not None else F.lit(False)

    @F.pandas_udf("binary")
    def bins(*columns: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes() for row in binning.encode(list(columns))])

    labelled = train.where(F.col(label).isNotNull())
    rows = labelled.select(bins(*binning.sources()).alias("bins"), F.col(label).cast("double").alias("label"), held.alias("held"))
    n, rate = labelled.agg(F.count(F.lit(1)), F.avg(F.col(label).cast("double"))).first()
    rows = rows.groupBy("bins", "label", "held").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    rate = min(max(rate if n else 0.5, 1e-6), 1 - 1e-6)
    start = float(np.log(rate / (1 - rate)))
    rows = cut_lineage(rows.withColumn("score", F.lit(start)))
    return rows, rows.count(), start


def fit(
    train: DataFrame, label: str, numeric: list[str], categorical: list[str], settings: Settings = Settings(), task_cells: int = TASK_CELLS
) -> BoostedModel:
    """Boosted trees on the labelled rows; rows without a label are left out, an empty table gives no trees."""
    binning = Binning(numeric, categorical).fit(train)
    if train.where(F.col(label).isNotNull()).limit(settings.early_from + 1).count() <= settings.early_from:
        settings = replace(settings, patience=None)
    rows, n, start = coded(train, label, binning, settings)
    if not n or not binning.columns:
        return BoostedModel(binning, [], start)
    if n * len(binning.columns) > task_cells:
        return BoostedModel(binning, boost(AcrossTasks(rows, len(binning.columns)), len(numeric), settings), start)
    count = len(numeric)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        (_, block), = _blocks([frame], [])
        return pd.DataFrame({"model": [pickle.dumps(boost(InTask(block), count, settings))]})

    # At most TASK_CELLS bytes of bins; the rows are sorted, so that sums do not depend on their order.
    one = rows.groupBy(F.lit(0).alias("all")).applyInPandas(lambda f: run(f.sort_values(["bins", "label", "held"], kind="stable")), "model binary")
    return BoostedModel(binning, pickle.loads(one.first()["model"]), start)
