"""Usage roll-up, cost score and forecast, for one warehouse or for all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepulse.config import CostConfig
from tablepulse.functions.scores import clamp_score, cost_severity
from tablepulse.functions.times import as_datetime, day_text, look_back
from tablepulse.operators.relational import equals_if_given

MODEL = "linear_extrapolation"
ALL = "ALL"


def daily_usage(
    usage: DataFrame,
    as_of: str,
    days: int = CostConfig.lookback_days,
    warehouse: str | None = None,
    group_by: Sequence[str] = (),
) -> DataFrame:
    """Credits and bytes of successful queries per day of the look-back."""
    rows = equals_if_given(usage.filter(F.col("execution_status") == "SUCCESS"), warehouse, "warehouse_name")
    return (
        look_back(rows, "start_time", as_of, days)
        .groupBy(*group_by, day_text(F.col("start_time")).alias("query_date"))
        .agg(F.sum("credits_used").alias("credits_day"), F.sum("bytes_scanned").cast("double").alias("bytes_day"))
    )


def daily_usage_from_records(
    records: DataFrame, as_of: str, days: int = CostConfig.lookback_days, group_by: Sequence[str] = ()
) -> DataFrame:
    """The same from the platform's own cost records, which carry no bytes."""
    return (
        look_back(records, "recorded_at", as_of, days)
        .groupBy(*group_by, day_text(F.col("recorded_at")).alias("query_date"))
        .agg(F.sum("credits_used").alias("credits_day"), F.lit(0.0).alias("bytes_day"))
    )


def usage_totals(daily: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Totals over the look-back; missing values count as 0."""
    return daily.groupBy(*group_by).agg(
        F.round(F.coalesce(F.sum("credits_day"), F.lit(0.0)), 6).alias("total_credits"),
        F.coalesce(F.sum("bytes_day"), F.lit(0.0)).alias("bytes_scanned"),
        F.count(F.lit(1)).alias("days_with_usage"),
    )


def daily_breakdown(daily: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    return daily.select(*group_by, F.col("query_date").alias("date"), F.round("credits_day", 6).alias("credits"))


def run_count(runs: DataFrame, as_of: str, days: int = CostConfig.lookback_days) -> DataFrame:
    """Runs started in the look-back, at least 1."""
    counted = look_back(runs, "started_at", as_of, days).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.greatest("n", F.lit(1)).alias("pipeline_run_count"))


def cost_score(daily_average: Column, config: CostConfig = CostConfig()) -> Column:
    """100 at no cost, 0 from the daily budget on."""
    return F.round(clamp_score(100.0 * (1.0 - daily_average / config.budget_credits_per_day)), 2)


def cost_measures(
    totals: DataFrame, runs: Column, days: int = CostConfig.lookback_days, config: CostConfig = CostConfig()
) -> DataFrame:
    """Money, averages, storage, forecast and score of usage totals.

    The daily average is taken over the look-back, with or without usage on a day.
    """
    credits = F.col("total_credits")
    return (
        totals.withColumn("lookback_days", F.lit(days))
        .withColumn("pipeline_run_count", runs.cast("bigint"))
        .withColumn("total_usd", F.round(credits * config.usd_per_credit, 4))
        .withColumn("daily_avg_credits", F.round(credits / max(days, 1), 6))
        .withColumn("cost_per_run", F.round(credits / F.greatest("pipeline_run_count", F.lit(1)), 6))
        .withColumn("storage_gb", F.round(F.col("bytes_scanned") / 1024**3, 4))
        .withColumn("storage_cost_usd", F.round(F.col("storage_gb") * config.storage_usd_per_gb, 4))
        .withColumn("forecast_credits_30d", F.round(F.col("daily_avg_credits") * config.horizon_days, 4))
        .withColumn("forecast_usd_30d", F.round(F.col("forecast_credits_30d") * config.usd_per_credit, 4))
        .withColumn("cost_score", cost_score(F.col("daily_avg_credits"), config))
        .withColumn("cost_severity", cost_severity(F.col("cost_score")))
    )


def forecast(measured: DataFrame, as_of: str, group_by: Sequence[str] = (), config: CostConfig = CostConfig()) -> DataFrame:
    """One row per group: credits over the horizon with bounds, dated at its end."""
    predicted = F.col("forecast_credits_30d")
    today = as_datetime(as_of).date()
    return measured.select(
        *group_by,
        F.date_add(F.lit(today), config.horizon_days).alias("forecast_date"),
        predicted.alias("predicted_credits"),
        F.round(predicted * config.lower_factor, 4).alias("lower_bound"),
        F.round(predicted * config.upper_factor, 4).alias("upper_bound"),
        F.lit(MODEL).alias("model_used"),
    )


def daily_forecast(
    measured: DataFrame, as_of: str, group_by: Sequence[str] = (), config: CostConfig = CostConfig()
) -> DataFrame:
    """One row per group and day of the horizon, as the forecast report reads them."""
    per_day = F.col("daily_avg_credits")
    today = as_datetime(as_of).date()
    days = F.sequence(F.lit(1), F.lit(config.horizon_days))
    return measured.select(*group_by, "daily_avg_credits", F.explode(days).alias("day_no")).select(
        *group_by,
        F.date_add(F.lit(today), F.col("day_no")).alias("forecast_date"),
        F.round(per_day, 4).alias("predicted_credits"),
        F.round(per_day * config.lower_factor, 4).alias("lower_bound"),
        F.round(per_day * config.upper_factor, 4).alias("upper_bound"),
        F.lit(MODEL).alias("model_used"),
    )


def cost_report(
    usage: DataFrame,
    runs: DataFrame,
    as_of: str,
    days: int = CostConfig.lookback_days,
    warehouse: str | None = None,
    group_by: Sequence[str] = ("warehouse_name",),
    config: CostConfig = CostConfig(),
) -> DataFrame:
    """Usage to cost measures in one go, per warehouse by default."""
    totals = usage_totals(daily_usage(usage, as_of, days, warehouse, group_by), group_by)
    return cost_measures(totals, run_count(runs, as_of, days).scalar(), days, config)
