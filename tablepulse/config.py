"""Thresholds, weights and prices; each job takes one of these as a parameter."""

from __future__ import annotations

from dataclasses import dataclass

# Severity names used by every score.
INFO, LOW, MEDIUM, HIGH, CRITICAL = "info", "low", "medium", "high", "critical"


@dataclass(frozen=True)
class QualityConfig:
    weight_null: float = 0.30
    weight_duplicate: float = 0.20
    weight_type: float = 0.25
    weight_freshness: float = 0.15
    weight_range: float = 0.10
    null_rate_threshold: float = 0.05
    type_mismatch_threshold: float = 0.01
    min_score: float = 80.0
    freshness_max_hours: float = 24.0


@dataclass(frozen=True)
class DriftConfig:
    bins: int = 10
    epsilon: float = 1e-6
    psi_threshold: float = 0.2
    p_value_threshold: float = 0.05
    categorical_threshold: float = 0.1
    min_rows: int = 10
    # p-values of windows up to this size on both sides are exact.
    exact_rows: int = 10_000
    # A column's sorted values are cut into ranges of about this many distinct values before running
    # sums are taken, into 2 ** range_bits of them at most.
    range_values: int = 128
    range_bits: int = 18


@dataclass(frozen=True)
class CostConfig:
    usd_per_credit: float = 3.0
    storage_usd_per_gb: float = 0.023
    budget_credits_per_day: float = 100.0
    lookback_days: int = 7
    horizon_days: int = 30
    lower_factor: float = 0.85
    upper_factor: float = 1.15


@dataclass(frozen=True)
class HealConfig:
    max_retries: int = 2
    # False: a quarantined run keeps the status "quarantined".
    # True: a resolved quarantine ends as "success".
    resolved_wins: bool = False
