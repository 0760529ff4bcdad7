"""Scores, bands and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablepulse.config import CRITICAL, HIGH, INFO, LOW, MEDIUM


def bands(value: Column, steps: list[tuple[float, str]], rest: str, below: bool = False) -> Column:
    """Name of the first step that ``value`` reaches (or, with ``below``, falls short of).

    NULL stays NULL.
    """
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, name in steps:
        out = out.when(value < limit if below else value >= limit, F.lit(name))
    return out.otherwise(F.lit(rest))


def clamp_score(value: Column) -> Column:
    """Value moved into 0..100; NULL stays NULL, which ``greatest`` alone would skip."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))


def health_label(score: Column) -> Column:
    return bands(score, [(85, "Excellent"), (70, "Good"), (50, "Fair")], "At Risk")


def rate_band(percent: Column) -> Column:
    return bands(percent, [(5, "low"), (15, "medium")], "high", below=True)


def psi_band(psi: Column) -> Column:
    return bands(psi, [(0.1, "stable"), (0.2, "moderate")], "significant", below=True)


def quality_severity(score: Column) -> Column:
    return bands(score, [(90, INFO), (75, LOW), (60, MEDIUM), (40, HIGH)], CRITICAL)


def drift_severity(percent: Column) -> Column:
    return bands(percent, [(40, HIGH), (20, MEDIUM)], LOW)


def cost_severity(score: Column) -> Column:
    return bands(score, [(40, HIGH), (70, MEDIUM)], LOW, below=True)


def percent_true(condition: Column) -> Column:
    """Share of rows with a true condition, in percent; NULL counts as false."""
    return F.avg(F.when(condition, 100.0).otherwise(0.0))


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part`` of ``whole`` in percent, NULL when ``whole`` is 0."""
    return F.round(F.try_divide(part, whole) * 100, digits)
