"""Logistic regression by Newton steps on summed statistics.

Gradient and curvature of the penalised log loss are sums over rows, so a step is one pass: tasks add up
the terms of their rows, Spark adds the tasks, and the driver solves one small system.  Steps that raise the
loss are halved.  The optimum is unique under the penalty, so coefficients are reproducible to the digits of
the sums, whatever the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.rates import logit
from fieldglass.operators.ordered import exact_quantiles
from fieldglass.session import cut_lineage

RARE = "__RARE__"
_TOLERANCE = 1e-11


def climb(sums, size: int, penalty: np.ndarray, start: np.ndarray | None = None, steps: int = 100) -> np.ndarray:
    """Minimise loss(w) + w' diag(penalty) w / 2, where sums(w) gives (loss, gradient, curvature) over all rows."""
    w = np.zeros(size) if start is None else start

    def total(w):
        loss, gradient, curvature = sums(w)
        return loss + (penalty * w * w).sum() / 2, gradient + penalty * w, curvature + np.diag(penalty)

    loss, gradient, curvature = total(w)
    for _ in range(steps):
        step, *_ = np.linalg.lstsq(curvature, gradient, rcond=None)
        part = 1.0
        while True:
            next_loss, next_gradient, next_curvature = total(w - part * step)
            # Near the optimum the loss only moves by rounding.
            if next_loss <= loss + 1e-12 * abs(loss) or part < 1e-6:
                break
            part /= 2
        w = w - part * step
        loss, gradient, curvature = next_loss, next_gradient, next_curvature
        if np.abs(part * step).max(initial=0.0) <= _TOLERANCE * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


@dataclass
class Design:
    """Median-imputed, scaled numbers and one column per frequent category; rare ones share a column."""

    numeric: list[str]
    categorical: list[str]
    medians: dict = field(default_factory=dict)
    means: dict = field(default_factory=dict)
    spreads: dict = field(default_factory=dict)
    levels: dict = field(default_factory=dict)  # name -> {category: column}, RARE included if there are rare ones
    modes: dict = field(default_factory=dict)
    offsets: dict = field(default_factory=dict)
    size: int = 0  # columns, the intercept last

    def fit(self, train: DataFrame, minimum: int, most: int) -> Design | None:
        """Learn from the training rows; None if there are over `most` columns."""
        width = len(self.numeric)
        for c in self.categorical:
            counts = cut_lineage(train.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")))
            kept = counts.where(F.col("n") >= minimum).orderBy(F.desc("n"), "v").limit(most + 1).collect()
            if width + len(kept) > most:
                return None
            mode = counts.orderBy(F.desc("n"), "v").limit(1).collect()
            # Missing values take the most frequent category, which may be a rare one.
            self.modes[c] = mode[0]["v"] if mode else None
            names = [r["v"] for r in kept] + ([RARE] if counts.where(F.col("n") < minimum).limit(1).count() else [])
            self.levels[c] = {v: i for i, v in enumerate(names)}
            self.offsets[c] = width
            width += len(names)
        if self.numeric:
            known = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in self.numeric}
            long = train.select([known[c].alias(c) for c in self.numeric]).unpivot([], self.numeric, "name", "value")
            self.medians = dict.fromkeys(self.numeric, 0.0) | {r["name"]: r["m"] for r in exact_quantiles(long, ["name"], "value", {"m": 0.5}).collect()}
            filled = {c: F.coalesce(known[c], F.lit(self.medians[c])) for c in self.numeric}
            first = train.agg(*[F.avg(v).alias(f"a_{c}") for c, v in filled.items()], *[F.stddev_pop(v).alias(f"s_{c}") for c, v in filled.items()]).first()
            self.means = {c: first[f"a_{c}"] or 0.0 for c in self.numeric}
            self.spreads = {c: first[f"s_{c}"] or 1.0 for c in self.numeric}
        self.size = width + 1
        return self

    def terms(self) -> list[str]:
        return [*self.numeric, *[f"{c}={v}" for c in self.categorical for v in self.levels[c]], "intercept"]

    def sources(self) -> list:
        return [F.col(c).cast("double") for c in self.numeric] + [F.col(c).cast("string") for c in self.categorical]

    def encode(self, columns: list[pd.Series]) -> tuple[np.ndarray, np.ndarray]:
        """Scaled numbers, and per category its column or -1 for one that was never seen."""
        n, k = len(columns[0]) if columns else 0, len(self.numeric)
        numbers, codes = np.empty((n, k)), np.full((n, len(self.categorical)), -1, dtype=np.int64)
        for i, c in enumerate(self.numeric):
            value = columns[i].to_numpy(dtype=float, na_value=np.nan)
            numbers[:, i] = (np.where(np.isnan(value), self.medians[c], value) - self.means[c]) / self.spreads[c]
        for i, c in enumerate(self.categorical):
            filled = columns[k + i].where(columns[k + i].notna(), self.modes[c])
            codes[:, i] = filled.map({v: self.offsets[c] + at for v, at in self.levels[c].items()}).fillna(-1).to_numpy(dtype=np.int64)
        return numbers, codes

    def rare(self, columns: list[pd.Series], codes: np.ndarray) -> np.ndarray:
        """Training categories without a column of their own go to the shared one."""
        for i, c in enumerate(self.categorical):
            if RARE in self.levels[c]:
                codes[codes[:, i] < 0, i] = self.offsets[c] + self.levels[c][RARE]
        return codes

    def linear(self, numbers: np.ndarray, codes: np.ndarray, w: np.ndarray) -> np.ndarray:
        padded = np.append(w, 0.0)  # unseen categories add nothing
        return numbers @ w[:len(self.numeric)] + padded[codes].sum(axis=1) + w[-1]

    def sums(self, numbers: np.ndarray, codes: np.ndarray, label: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and curvature of a block, without ever building its one-hot columns."""
        k, size = len(self.numeric), self.size
        z = self.linear(numbers, codes, w)
        p = 1 / (1 + np.exp(-z))
        off, weight = p - label, p * (1 - p)
        loss = np.logaddexp(0.0, np.where(label > 0.5, -z, z)).sum()
        gradient, curvature = np.zeros(size), np.zeros((size, size))
        numbers = np.hstack([numbers, np.ones((len(numbers), 1))])
        at = np.r_[np.arange(k), size - 1]
        gradient[at] = numbers.T @ off
        curvature[np.ix_(at, at)] = (numbers * weight[:, None]).T @ numbers
        for i in range(codes.shape[1]):
            seen = codes[:, i] >= 0
            gradient += np.bincount(codes[seen, i], off[seen], minlength=size)
            for j, column in enumerate(at):
                cross = np.bincount(codes[seen, i], weight[seen] * numbers[seen, j], minlength=size)
                curvature[:, column] += cross
                curvature[column, :] += cross
            for j in range(i + 1):
                both = seen & (codes[:, j] >= 0)
                cross = np.bincount(codes[both, i] * size + codes[both, j], weight[both], minlength=size * size).reshape(size, size)
                curvature += cross if i == j else cross + cross.T
        return loss, gradient, curvature


@dataclass
class LogisticModel:
    design: Design
    weights: np.ndarray

    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.design.terms(), map(float, self.weights)))

    def score(self, df: DataFrame, name: str = "prediction_probability") -> DataFrame:
        design, weights = self.design, self.weights

        @F.pandas_udf("double")
        def probability(*columns: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-design.linear(*design.encode(list(columns)), weights))))

        return df.withColumn(name, probability(*design.sources()) if design.sources() else F.lit(float(1 / (1 + np.exp(-weights[-1])))))


def fit_design(train: DataFrame, label: str, design: Design, ridge: float = 1.0) -> LogisticModel:
    """Coefficients of all columns under `ridge`, the intercept free; rows without a label are left out."""
    size = design.size
    columns = [c.alias(f"c{i}") for i, c in enumerate(design.sources())]
    rows = cut_lineage(train.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), *columns))
    upper = np.triu_indices(size)

    def sums(w: np.ndarray):
        def run(frames):
            total = np.zeros(1 + size + len(upper[0]))
            for frame in frames:
                series = [frame[c] for c in frame.columns[1:]]
                numbers, codes = design.encode(series) if series else (np.zeros((len(frame), 0)), np.zeros((len(frame), 0), dtype=int))
                loss, gradient, curvature = design.sums(numbers, design.rare(series, codes), frame["label"].to_numpy(), w)
                total += np.concatenate([[loss], gradient, curvature[upper]])
            cells = np.flatnonzero(total)
            yield pd.DataFrame({"cell": cells, "part": total[cells]})

        # At most columns squared sums come back.
        found = rows.mapInPandas(run, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("part")).toPandas()
        total = np.zeros(1 + size + len(upper[0]))
        total[found["cell"].to_numpy(dtype=np.int64)] = found["part"].to_numpy(dtype=float)
        curvature = np.zeros((size, size))
        curvature[upper] = total[1 + size:]
        return total[0], total[1:1 + size], curvature + np.triu(curvature, 1).T

    penalty = np.r_[np.full(size - 1, ridge), 0.0]
    return LogisticModel(design, climb(sums, size, penalty))


def fit_platt(df: DataFrame, label: str, score: str, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of the label on the logit of the score; the slope is penalised."""
    counted = df.where(F.col(label).isNotNull()).groupBy(logit(F.col(score)).alias("z")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("s"))
    counted = cut_lineage(counted)
    z, n, s = F.col("z"), F.col("n"), F.col("s")

    def sums(w: np.ndarray):
        line = F.lit(float(w[0])) * z + F.lit(float(w[1]))
        p = 1 / (1 + F.exp(-line))
        weight = n * p * (1 - p)
        # log(1 + e^x) without overflow
        soft = F.greatest(line, F.lit(0.0)) + F.log1p(F.exp(-F.abs(line)))
        parts = [n * soft - s * line, (n * p - s) * z, n * p - s, weight * z * z, weight * z, weight]
        row = [v or 0.0 for v in counted.agg(*[F.sum(v) for v in parts]).first()]
        return row[0], np.array(row[1:3]), np.array([[row[3], row[4]], [row[4], row[5]]])

    slope, intercept = climb(sums, 2, np.array([ridge, 0.0]), np.array([1.0, 0.0]))
    return float(slope), float(intercept)
