"""Folds over a short newest-first list of durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ewma(durations: Column, alpha: float = 0.3) -> Column:
    """Damped moving average that starts at the newest value and moves to older ones.

    A value above three times the running estimate counts as twice the estimate.
    """
    def step(e: Column, d: Column) -> Column:
        damped = F.when((e > 0) & (d > e * 3.0), F.least(d, e * 2.0)).otherwise(d)
        return alpha * damped + (1 - alpha) * e

    rest = F.slice(durations, 2, F.greatest(F.size(durations) - 1, F.lit(0)))
    return F.when(F.size(durations) > 0,
                  F.aggregate(rest, F.element_at(durations, 1), step))


def mean(xs: Column) -> Column:
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), F.size(xs))


def sample_std(xs: Column) -> Column:
    """Sample deviation of a list, 0 for a single value."""
    m, n = mean(xs), F.size(xs)
    sq = F.aggregate(F.transform(xs, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 1, F.sqrt(sq / (n - 1))).otherwise(F.lit(0.0))


def spread(std: Column, avg: Column) -> Column:
    """Coefficient of variation, 1 where the average is not positive."""
    return F.when(avg > 0, std / avg).otherwise(F.lit(1.0))


def quantity_factor(n: Column) -> Column:
    return F.least(F.lit(1.0), n / 10.0) * 0.5


def confidence(n: Column, cv: Column, single: float = 0.25) -> Column:
    """0 to 1: half from the number of samples, half from how little they vary."""
    steady = F.when(n == 1, F.lit(single)).otherwise((1 - F.least(F.lit(1.0), cv)) * 0.5)
    return F.when(n > 0, quantity_factor(n) + steady).otherwise(F.lit(0.0))
