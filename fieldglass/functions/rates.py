"""Ratios, smoothing, scores and probability helpers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBABILITY_FLOOR = 1e-6


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """NULL, not an error, for a zero denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def positive_rate(numerator: Column, denominator: Column) -> Column:
    """NULL unless the denominator is positive."""
    return numerator.cast("double") / F.when(denominator > 0, denominator.cast("double"))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def smooth(successes: Column, trials: Column, prior: Column | float, weight: float) -> Column:
    """Additive smoothing towards `prior` worth `weight` trials."""
    rate = prior if isinstance(prior, Column) else F.lit(float(prior))
    return (successes + F.lit(float(weight)) * rate) / (trials + F.lit(float(weight)))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def rate_adjustment(rate: Column, reference: Column) -> Column:
    return clip(F.sqrt(rate / reference), 0.8, 1.2)


def clip_probability(p: Column) -> Column:
    return clip(p, PROBABILITY_FLOOR, 1 - PROBABILITY_FLOOR)


def logit(p: Column) -> Column:
    q = clip_probability(p)
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def apply_platt(p: Column, slope: Column | float, intercept: Column | float) -> Column:
    return sigmoid(F.lit(slope) * logit(p) + F.lit(intercept))


def count_bounds(predicted: Column, radius: Column | float) -> tuple[Column, Column]:
    """Whole-number bounds around a prediction: never negative, never inverted."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    lower = F.greatest(F.lit(0), F.ceil(predicted - r)).cast("int")
    upper = F.greatest(lower, F.floor(predicted + r).cast("int"))
    return lower, upper


def weighted_score(parts: list[tuple[Column, float]], mandatory: int = 0) -> tuple[Column, Column]:
    """Weighted mean over present parts and the weight they cover.

    NULL score and zero coverage when the mandatory part is missing.
    """
    needed = parts[mandatory][0].isNotNull()
    add = lambda a, b: a + b
    covered = reduce(add, [F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in parts])
    total = reduce(add, [F.coalesce(v.cast("double") * w, F.lit(0.0)) for v, w in parts])
    return F.when(needed, F.round(total / covered, 1)), F.when(needed, covered).otherwise(0.0)


def half_up(value: Column, digits: int = 0) -> Column:
    """Ties towards positive infinity, the rounding of the dashboard layer."""
    scale = 10**digits
    return F.floor(value * scale + 0.5) / scale


def half_even(value: Column, digits: int = 0) -> Column:
    """Ties to the even neighbour, the rounding of the array layer."""
    scale = 10**digits
    return F.rint(value * scale) / scale


def relative_change(current: Column, previous: Column, points: bool = False) -> Column:
    """Points difference, or change relative to |previous|; NULL where that is zero."""
    if points:
        return current - previous
    return (current - previous) / F.nullif(F.abs(previous), F.lit(0.0))
