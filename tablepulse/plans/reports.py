"""Monitoring reports over the fact tables.

Each report maps fact DataFrames to one DataFrame.  Reports on "the newest" rows
add the row id as last sort key, so that ties always resolve the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepulse.functions.names import label, run_label
from tablepulse.functions.scores import clamp_score, health_label, percent_true, psi_band, rate_band, share
from tablepulse.functions.times import day_text, look_ahead, look_back, moment, seconds_between
from tablepulse.operators.relational import (
    daily_stats,
    dataset_filter,
    distinct_values,
    equals_if_given,
    has_status,
    newest,
    pass_fail_counts,
    rows_of_latest,
)

# Health points of a detected drift by severity.
DRIFT_POINTS = {"LOW": 70.0, "MEDIUM": 40.0, "HIGH": 10.0}
DRIFT_POINTS_OTHER, DRIFT_POINTS_NONE, DRIFT_POINTS_UNKNOWN = 30.0, 100.0, 50.0


# --- runs --------------------------------------------------------------------

def _status_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(has_status("status", "success")).alias("success"),
        F.count_if(has_status("status", "failed", "error")).alias("failed"),
        F.count_if(has_status("status", "running")).alias("running"),
    ]


def run_stats(runs: DataFrame) -> DataFrame:
    return runs.agg(*_status_counts())


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return newest(runs, limit, "started_at", "id").select(
        "dataset_id", "dag_id", "run_id", "status", "rows_ingested", "started_at", "completed_at"
    )


def _duration(as_of: str) -> Column:
    """Seconds from start to end; an open run is measured to ``as_of``."""
    return seconds_between(F.col("started_at"), F.coalesce("completed_at", moment(as_of)))


def run_kpis(runs: DataFrame, as_of: str) -> DataFrame:
    return runs.agg(*_status_counts(), F.avg(_duration(as_of)).alias("avg_duration_sec")).withColumn(
        "success_rate", share(F.col("success"), F.col("total"))
    )


def recent_dag_runs(runs: DataFrame, as_of: str, limit: int = 15) -> DataFrame:
    return newest(runs, limit, "started_at", "id").select(
        "dag_id", "run_id", "status", "rows_ingested", "rows_rejected", "started_at", "completed_at",
        _duration(as_of).alias("duration_sec"),
    )


def duration_trend(runs: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Daily mean, shortest and longest duration of completed runs."""
    seconds = seconds_between(F.col("started_at"), F.col("completed_at"))
    completed = look_back(runs.filter(F.col("completed_at").isNotNull()), "started_at", as_of, days)
    return daily_stats(completed, "started_at", seconds).select(
        "day",
        F.col("avg_value").alias("avg_sec"),
        F.col("min_value").cast("double").alias("min_sec"),
        F.col("max_value").cast("double").alias("max_sec"),
    )


def task_timeline(tasks: DataFrame, runs: DataFrame, as_of: str, limit_runs: int = 5) -> DataFrame:
    """Tasks of the newest runs, which the limit bounds, with the parent's ``dag_id``."""
    top = newest(runs, limit_runs, "started_at", "id").select(
        F.col("id").alias("_id"), "dag_id", F.col("started_at").alias("run_started_at")
    )
    seconds = F.coalesce(F.col("duration_sec"), _duration(as_of).cast("double"))
    return (
        tasks.join(top, tasks["run_id"] == F.col("_id"))
        .orderBy(F.desc("run_started_at"), F.asc_nulls_last("started_at"), "run_id", "task_name")
        .select(
            "run_id", "dag_id", "task_name", "task_type", "status", "started_at", "completed_at",
            seconds.alias("duration_sec"), "retry_count",
        )
    )


def timeline_bars(timeline: DataFrame) -> DataFrame:
    """Timeline rows with a start, an end and a short run label."""
    return timeline.filter(F.col("started_at").isNotNull()).select(
        "task_name",
        "status",
        "started_at",
        F.coalesce("completed_at", "started_at").alias("completed_at"),
        run_label(F.col("dag_id"), F.col("run_id")).alias("run_label"),
    )


# --- lineage -----------------------------------------------------------------

def lineage_summary(lineage: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).alias(f"total_{column}")

    return (
        look_back(lineage, "event_at", as_of, days)
        .groupBy("source_layer", "target_layer")
        .agg(total("rows_in"), total("rows_out"), total("rows_rejected"), F.count(F.lit(1)).alias("run_count"))
        .orderBy("source_layer", "target_layer")
    )


def layer_stats(lineage: DataFrame) -> DataFrame:
    """Rows ever seen per layer; a total of 0 shows as NULL."""
    def total(layer: str, column: str) -> Column:
        return F.nullif(F.sum(F.when(F.upper("source_layer") == layer, F.col(column)).otherwise(0)), F.lit(0))

    return lineage.agg(
        total("BRONZE", "rows_in").alias("bronze_rows"),
        total("BRONZE", "rows_out").alias("silver_rows"),
        total("SILVER", "rows_out").alias("gold_rows"),
        F.coalesce(F.sum("rows_rejected"), F.lit(0)).alias("total_rejected"),
        F.max("event_at").alias("latest_event_at"),
    )


def flow_links(summary: DataFrame) -> DataFrame:
    """Forward and rejected edges of a lineage summary; edges without rows are left out."""
    layers = ["BRONZE", "SILVER", "GOLD"]
    source, target = F.upper("source_layer"), F.upper("target_layer")
    edges = F.array(
        F.struct(source.alias("source"), target.alias("target"), F.col("total_rows_out").alias("rows")),
        F.struct(source.alias("source"), F.lit("REJECTED").alias("target"), F.col("total_rows_rejected").alias("rows")),
    )
    return (
        summary.filter(source.isin(layers) & target.isin(layers))
        .select(F.inline(edges), "run_count")
        .filter(F.col("rows") > 0)
    )


# --- quality -----------------------------------------------------------------

QUALITY_RATES = ["null_rate", "duplicate_rate", "type_mismatch_rate"]


def latest_quality(metrics: DataFrame) -> DataFrame:
    return newest(metrics, 1, "evaluated_at", "id").select(
        F.col("quality_score").alias("score"), "passed", *QUALITY_RATES, "evaluated_at"
    )


def quality_trend(metrics: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return (
        look_back(metrics, "evaluated_at", as_of, days)
        .groupBy(day_text(F.col("evaluated_at")).alias("day"))
        .agg(F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_score"))
        .orderBy("day")
    )


def quality_datasets(metrics: DataFrame) -> DataFrame:
    return distinct_values(metrics, F.coalesce("silver_table", "dataset_id"), "dataset_label")


def _latest(column: str, alias: str) -> Column:
    """Value of the newest row, with the id deciding ties."""
    return F.max_by(column, F.struct("evaluated_at", "id")).alias(alias)


def quality_kpis(metrics: DataFrame, dataset: str | None = None) -> DataFrame:
    return (
        dataset_filter(metrics, dataset)
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            F.count_if(F.col("passed")).alias("passed_runs"),
            F.count_if(~F.col("passed")).alias("failed_runs"),
            percent_true(F.col("passed")).alias("pass_rate"),
            _latest("quality_score", "latest_score"),
            _latest("total_rows", "latest_total_rows"),
            _latest("null_rate", "latest_null_rate"),
            _latest("duplicate_rate", "latest_dup_rate"),
            _latest("type_mismatch_rate", "latest_type_rate"),
            _latest("range_fail_rate", "latest_range_rate"),
            _latest("freshness_hours", "latest_freshness_hours"),
            F.max("evaluated_at").alias("latest_evaluated_at"),
        )
        .withColumn("latest_total_rows", F.nullif("latest_total_rows", F.lit(0)))
    )


def quality_score_trend(metrics: DataFrame, as_of: str, days: int = 30, dataset: str | None = None) -> DataFrame:
    rows = look_back(dataset_filter(metrics, dataset), "evaluated_at", as_of, days)
    return daily_stats(rows, "evaluated_at", F.col("quality_score"), run_count=F.count(F.lit(1))).select(
        "day",
        F.col("avg_value").alias("avg_score"),
        F.col("min_value").alias("min_score"),
        F.col("max_value").alias("max_score"),
        "run_count",
    )


def quality_history(metrics: DataFrame, limit: int = 20, dataset: str | None = None) -> DataFrame:
    return newest(dataset_filter(metrics, dataset), limit, "evaluated_at", "id").select(
        "id", label("silver_table", "dataset_id").alias("dataset_label"), "quality_score", "total_rows", "passed",
        *QUALITY_RATES, "range_fail_rate", "freshness_hours", "evaluated_at",
    )


def quality_columns(column_metrics: DataFrame, runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """Column metrics of one run, by default of the newest."""
    if run_id is not None:
        rows = column_metrics.filter(F.col("quality_run_id") == run_id)
    else:
        rows = rows_of_latest(column_metrics, "quality_run_id", runs, "id", "evaluated_at")
    return rows.select("column_name", "metric_type", "metric_value", "threshold", "passed").orderBy(
        "column_name", "metric_type"
    )


def rate_distribution(kpis: DataFrame) -> DataFrame:
    """The four latest rates in percent with their band; unknown rates are left out."""
    names = {
        "Null Rate": "latest_null_rate",
        "Duplicate Rate": "latest_dup_rate",
        "Type Mismatch Rate": "latest_type_rate",
        "Range Fail Rate": "latest_range_rate",
    }
    cells = [F.struct(F.lit(k).alias("metric"), (F.col(v) * 100).cast("double").alias("percent")) for k, v in names.items()]
    return (
        kpis.select(F.inline(F.array(*cells)))
        .filter(F.col("percent").isNotNull())
        .withColumn("band", rate_band(F.col("percent")))
    )


def column_pass_fail(column_metrics: DataFrame) -> DataFrame:
    return pass_fail_counts(column_metrics, "column_name").orderBy("passed_count", "column_name")


# --- drift -------------------------------------------------------------------

def latest_drift(summary: DataFrame) -> DataFrame:
    return newest(summary, 1, "evaluated_at", "id").select(
        F.col("drift_severity").alias("severity"),
        F.col("drift_score").alias("score"),
        F.col("drift_detected").alias("detected"),
        "drifted_columns", "total_columns", "drift_pct", "evaluated_at",
    )


def drift_datasets(summary: DataFrame) -> DataFrame:
    return distinct_values(summary, F.col("dataset_id"), "dataset_id")


def drift_kpis(summary: DataFrame, dataset: str | None = None) -> DataFrame:
    """Drift KPIs; ``avg_psi`` is the historical name of the mean score."""
    return (
        equals_if_given(summary, dataset, "dataset_id")
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            F.count_if(F.col("drift_detected")).alias("detected_runs"),
            percent_true(F.col("drift_detected")).alias("detection_rate"),
            _latest("drift_score", "latest_score"),
            _latest("drift_severity", "latest_severity"),
            _latest("drifted_columns", "latest_drifted_columns"),
            _latest("total_columns", "latest_total_columns"),
            _latest("drift_pct", "latest_drift_pct"),
            F.avg("drift_score").alias("avg_score"),
            F.max("evaluated_at").alias("latest_evaluated_at"),
        )
        .withColumn("latest_drifted_columns", F.nullif("latest_drifted_columns", F.lit(0)))
        .withColumn("latest_total_columns", F.nullif("latest_total_columns", F.lit(0)))
        .withColumn("avg_psi", F.col("avg_score"))
    )


def drift_score_trend(summary: DataFrame, as_of: str, days: int = 30, dataset: str | None = None) -> DataFrame:
    rows = look_back(equals_if_given(summary, dataset, "dataset_id"), "evaluated_at", as_of, days)
    counts = {"run_count": F.count(F.lit(1)), "detected_count": F.count_if(F.col("drift_detected"))}
    return daily_stats(rows, "evaluated_at", F.col("drift_score"), **counts).select(
        "day",
        F.col("avg_value").alias("avg_score"),
        F.col("min_value").alias("min_score"),
        F.col("max_value").alias("max_score"),
        "run_count",
        "detected_count",
    )


def drift_history(runs: DataFrame, limit: int = 20, dataset: str | None = None) -> DataFrame:
    return newest(equals_if_given(runs, dataset, "dataset_id"), limit, "evaluated_at", "id").select(
        "id", "dataset_id", "overall_drift_score", "drift_detected", "reference_window_start", "reference_window_end",
        "current_window_start", "current_window_end", "evaluated_at",
    )


def drift_columns(column_metrics: DataFrame, runs: DataFrame, run_id: str | None = None, limit: int = 50) -> DataFrame:
    """Column drift of one run, by default of the newest, highest PSI first."""
    if run_id is not None:
        rows = column_metrics.filter(F.col("drift_run_id") == run_id)
    else:
        rows = rows_of_latest(column_metrics, "drift_run_id", runs, "id", "evaluated_at")
    return (
        rows.select(
            "column_name", "drift_method", "statistic_value", "p_value", "psi_score", "drift_detected", "severity"
        )
        .orderBy(F.desc_nulls_last("psi_score"), "column_name")
        .limit(limit)
    )


def detected_and_stable(trend: DataFrame) -> DataFrame:
    """Detected and stable runs per day of a drift trend."""
    return trend.select("day", "detected_count", (F.col("run_count") - F.col("detected_count")).alias("stable_count"))


def detected_and_stable_totals(trend: DataFrame) -> DataFrame:
    return trend.agg(
        F.sum("detected_count").alias("detected_total"),
        F.sum(F.col("run_count") - F.col("detected_count")).alias("stable_total"),
    )


def top_psi(column_metrics: DataFrame, n: int = 20) -> DataFrame:
    """Columns with the highest PSI and their band."""
    return (
        column_metrics.filter(F.col("psi_score").isNotNull())
        .groupBy("column_name")
        .agg(F.max("psi_score").alias("psi_score"))
        .orderBy(F.desc("psi_score"), "column_name")
        .limit(n)
        .withColumn("band", psi_band(F.col("psi_score")))
    )


def drifted_and_stable_columns(kpis: DataFrame) -> DataFrame:
    drifted = F.coalesce("latest_drifted_columns", F.lit(0))
    total = F.coalesce("latest_total_columns", F.lit(0))
    return kpis.filter(total > 0).select(
        drifted.alias("drifted"), F.greatest(F.lit(0), total - drifted).alias("stable")
    )


# --- cost --------------------------------------------------------------------

def latest_cost(summary: DataFrame) -> DataFrame:
    return newest(summary, 1, "evaluated_at", "id").select(
        F.col("cost_score").alias("score"),
        F.col("cost_severity").alias("severity"),
        "total_usd", "total_credits", "forecast_usd_30d", "daily_avg_credits", "evaluated_at",
    )


def cost_warehouses(summary: DataFrame) -> DataFrame:
    return distinct_values(summary, F.col("warehouse_name"), "warehouse_name")


def cost_kpis(
    summary: DataFrame, forecasts: DataFrame, as_of: str, warehouse: str | None = None, usd_per_credit: float = 3.0
) -> DataFrame:
    """Cost totals and the forecast of the next 30 days."""
    ahead = look_ahead(equals_if_given(forecasts, warehouse, "warehouse_name"), "forecast_date", as_of, 30)
    predicted = ahead.agg(F.sum(F.col("predicted_credits") * usd_per_credit).alias("usd"))
    return (
        equals_if_given(summary, warehouse, "warehouse_name")
        .agg(
            F.avg("cost_score").alias("cost_score"),
            F.sum("total_credits").alias("total_credits"),
            F.sum("total_usd").alias("total_cost_usd"),
            F.avg("total_credits").alias("daily_avg_credits"),
            F.max("evaluated_at").alias("latest_evaluated_at"),
        )
        .withColumn("forecast_cost_usd", predicted.scalar())
    )


def credit_trend(summary: DataFrame, as_of: str, days: int = 30, warehouse: str | None = None) -> DataFrame:
    return (
        look_back(equals_if_given(summary, warehouse, "warehouse_name"), "evaluated_at", as_of, days)
        .groupBy(day_text(F.col("evaluated_at")).alias("day"), "warehouse_name")
        .agg(F.sum("total_credits").alias("credits_used"), F.sum("total_usd").alias("cost_usd"))
        .orderBy("day", "warehouse_name")
    )


def credit_trend_by_day(trend: DataFrame) -> DataFrame:
    """A credit trend summed over the warehouses."""
    return (
        trend.groupBy("day")
        .agg(F.sum("credits_used").alias("credits_used"), F.sum("cost_usd").alias("cost_usd"))
        .orderBy("day")
    )


def cost_history(records: DataFrame, limit: int = 20, warehouse: str | None = None) -> DataFrame:
    return (
        equals_if_given(records, warehouse, "warehouse_name")
        .orderBy(F.desc_nulls_last("usage_date"), F.desc_nulls_last("created_at"), "id")
        .limit(limit)
        .select("id", "warehouse_name", "service_type", "credits_used", "cost_usd", "usage_date", "created_at")
    )


def cost_forecasts(
    forecasts: DataFrame, as_of: str, warehouse: str | None = None, days: int = 30, usd_per_credit: float = 3.0
) -> DataFrame:
    return (
        look_ahead(equals_if_given(forecasts, warehouse, "warehouse_name"), "forecast_date", as_of, days)
        .orderBy("forecast_date", "warehouse_name")
        .select(
            "forecast_date",
            "warehouse_name",
            F.col("predicted_credits").alias("forecast_credits"),
            (F.col("predicted_credits") * usd_per_credit).alias("forecast_cost_usd"),
            F.col("lower_bound").alias("confidence_lower"),
            F.col("upper_bound").alias("confidence_upper"),
        )
    )


# --- healing -----------------------------------------------------------------

def _recovered(*statuses: str) -> Column:
    return F.upper("recovery_status").isin(*statuses)


def heal_success(summary: DataFrame) -> DataFrame:
    """Recovered and quarantined events, success rate and mean repair time."""
    return summary.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_recovered("RESOLVED", "RECOVERED")).alias("recovered"),
        F.count_if(F.col("quarantined")).alias("quarantined"),
        F.avg("mttr_seconds").alias("avg_mttr"),
        F.max("evaluated_at").alias("evaluated_at"),
    ).withColumn("success_rate", share(F.col("recovered"), F.col("total")))


def _outcomes() -> list[Column]:
    return [F.count(F.lit(1)).alias("total")] + [
        F.count_if(_recovered(status.upper())).alias(status) for status in ("resolved", "failed", "escalated")
    ]


def heal_kpis(summary: DataFrame) -> DataFrame:
    return summary.agg(
        *_outcomes(),
        F.count_if(F.col("quarantined")).alias("quarantined"),
        F.avg("mttr_seconds").alias("avg_mttr"),
        F.max("evaluated_at").alias("latest_eval"),
    ).withColumn("recovery_rate", share(F.col("resolved"), F.col("total")))


def failure_distribution(summary: DataFrame) -> DataFrame:
    return (
        summary.filter(F.col("failure_type").isNotNull())
        .groupBy(F.upper("failure_type").alias("failure_type"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "failure_type")
    )


def heal_trend(summary: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return (
        look_back(summary, "evaluated_at", as_of, days)
        .groupBy(day_text(F.col("evaluated_at")).alias("day"))
        .agg(*_outcomes(), F.coalesce(F.avg("mttr_seconds"), F.lit(0.0)).alias("avg_mttr"))
        .withColumn("recovery_rate", share(F.col("resolved"), F.col("total")))
        .orderBy("day")
    )


def heal_history(summary: DataFrame, limit: int = 20, failure_type: str | None = None) -> DataFrame:
    wanted = failure_type.upper() if failure_type else None
    rows = equals_if_given(summary, wanted, F.upper("failure_type"))
    return newest(rows, limit, "evaluated_at", "id").select(
        "id", "dataset_id", "pipeline_run_id",
        F.upper("failure_type").alias("failure_type"),
        "healing_strategy",
        F.upper("recovery_status").alias("recovery_status"),
        "retry_count", "mttr_seconds", "actions_taken", "actions_succeeded", "quarantined", "evaluated_at",
    )


def heal_actions(actions: DataFrame, runs: DataFrame, heal_run_id: str | None = None, limit: int = 50) -> DataFrame:
    """Actions of one heal run, by default of the newest, oldest action first."""
    if heal_run_id is not None:
        rows = actions.filter(F.col("heal_run_id") == heal_run_id)
    else:
        rows = rows_of_latest(actions, "heal_run_id", runs, "id", "created_at")
    return (
        rows.orderBy(F.asc_nulls_last("executed_at"), "id")
        .limit(limit)
        .select("id", "heal_run_id", "action_type", "action_detail", "success", "executed_at")
    )


def recovery_breakdown(kpis: DataFrame) -> DataFrame:
    cells = [
        F.struct(F.lit(status.upper()).alias("recovery_status"), F.col(status).alias("count"))
        for status in ("resolved", "escalated", "failed")
    ]
    return kpis.select(F.inline(F.array(*cells)))


def mttr_trend(trend: DataFrame) -> DataFrame:
    return trend.filter(F.col("avg_mttr") > 0).select("day", "avg_mttr")


# --- overall -----------------------------------------------------------------

def overall_health(quality: DataFrame, cost: DataFrame, heals: DataFrame, drift: DataFrame) -> DataFrame:
    """Score between 0 and 100 from quality (40 %), cost, healing and drift (20 % each).

    Input are the fact tables; an empty one contributes 0, or 50 for drift.
    """
    newest_drift = latest_drift(drift).select(F.struct("detected", "severity").alias("drift"))
    parts = heal_success(heals).select(
        F.col("success_rate").cast("double").alias("heal"),
        latest_quality(quality).select(F.col("score").cast("double")).scalar().alias("quality"),
        latest_cost(cost).select(F.col("score").cast("double")).scalar().alias("cost"),
        newest_drift.scalar().alias("drift"),
    )
    severity = F.upper("drift.severity")
    by_severity = F.lit(None).cast("double")
    for name, points in DRIFT_POINTS.items():
        by_severity = F.when(severity == name, points).otherwise(by_severity)
    bonus = (
        F.when(F.col("drift.detected").isNull(), DRIFT_POINTS_UNKNOWN)
        .when(~F.col("drift.detected"), DRIFT_POINTS_NONE)
        .otherwise(F.coalesce(by_severity, F.lit(DRIFT_POINTS_OTHER)))
    )
    zero = F.lit(0.0)
    total = (
        F.coalesce("quality", zero) * 0.4 + F.coalesce("cost", zero) * 0.2 + F.coalesce("heal", zero) * 0.2 + bonus * 0.2
    )
    any_data = F.coalesce("quality", "cost", "heal").isNotNull() | F.col("drift.severity").isNotNull()
    return parts.select(clamp_score(total).alias("raw"), any_data.alias("any_data")).select(
        F.round("raw", 1).alias("score"), health_label(F.col("raw")).alias("label"), "any_data"
    )
