"""Robust weights, pair uncertainties and quantiles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def huber_weight(value: Column, threshold: float) -> Column:
    return F.when(F.abs(value) <= threshold, 1.0).otherwise(threshold / F.abs(value))


def combined_sigma(first: Column, second: Column, has_sigma: Column, least: float) -> Column:
    """Uncertainty of a difference; members without a usable one count with the least."""
    one = lambda s: F.when(finite(s), F.abs(s)).otherwise(least)
    return F.when(has_sigma, F.hypot(one(first), one(second))).otherwise(2.0**0.5 * least)


def robust_rms(residual: Column, sigma: Column, threshold: float) -> Column:
    """Aggregate: root mean square weighted by Huber weight over variance."""
    w = huber_weight(residual / sigma, threshold) / (sigma * sigma)
    return F.sqrt(F.sum(w * residual * residual) / F.greatest(F.sum(w), F.lit(EPSILON)))


def quantile(values: Column, p: float) -> Column:
    """Aggregate: linearly interpolated quantile; p is brought into [0, 1]."""
    return F.percentile(values, min(1.0, max(0.0, p)))


def median(values: Column) -> Column:
    return F.percentile(values, 0.5)
