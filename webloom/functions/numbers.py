"""Numeric expressions with the semantics that the scores are defined by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ramp(value: Column, low: float, high: float, inverse: bool = False) -> Column:
    """0 at or below ``low``, 1 at or above ``high``, linear between; null counts as no value and scores 0.

    ``inverse`` takes the complement first, so swapped bounds give the step that the page-speed score has."""
    share = (value - low) / (high - low)
    share = 1 - share if inverse else share
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share.cast("double"))), F.lit(0.0))


def half_up(value: Column) -> Column:
    """Round to the next integer, halves towards positive infinity (also for negative numbers)."""
    return F.floor(value + 0.5)


def ratio(part: Column, whole: Column, default: float = 0.0) -> Column:
    """part / whole, or ``default`` where there is nothing to divide by."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(default)).otherwise(part.cast("double") / whole)


def percent_change(old: Column, new: Column) -> Column:
    """Change in percent of the old value; from zero it is 0 (no change) or 100."""
    return F.when(old == 0, F.when(new == 0, 0.0).otherwise(100.0)).otherwise((new - old) / F.nullif(old, F.lit(0)) * 100)


def percentage(part: Column, total: Column) -> Column:
    """Share in percent with two decimals, 0 of nothing is 0."""
    return F.round(100 * ratio(part, total), 2)


def grade(value: Column, limits: list[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first limit that ``value`` reaches, limits falling."""
    out = None
    for limit, label in limits:
        out = F.when(value >= limit, label) if out is None else out.when(value >= limit, label)
    return out.otherwise(otherwise)


def below(value: Column, limits: list[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first limit that ``value`` does not exceed, limits rising."""
    out = None
    for limit, label in limits:
        out = F.when(value <= limit, label) if out is None else out.when(value <= limit, label)
    return out.otherwise(otherwise)


def points(rules: list[tuple[Column, float]]) -> Column:
    """Sum of the points of all conditions that hold; null does not hold."""
    total = F.lit(0.0)
    for condition, value in rules:
        total = total + F.when(condition, float(value)).otherwise(0.0)
    return total


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def pass_warn_fail(value: Column, good: Column, tolerable: Column, higher_is_better: Column) -> Column:
    """Status of a value against two thresholds in either direction; a null value fails."""
    return (
        F.when(F.when(higher_is_better, value >= good).otherwise(value <= good), "pass")
        .when(F.when(higher_is_better, value >= tolerable).otherwise(value <= tolerable), "warn")
        .otherwise("fail")
    )
