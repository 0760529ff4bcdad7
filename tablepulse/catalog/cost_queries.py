"""Cost roll-up, score and forecast over usage derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepulse.catalog import query
from tablepulse.catalog.tables import EVENTS_END
from tablepulse.functions.scores import cost_severity
from tablepulse.operators import cost
from tablepulse.sources import facts

GROUP = ["warehouse_name"]
RUNS_AS_OF = "1998-01-01 00:00:00"
SINCE = f"start_time >= TIMESTAMP '{EVENTS_END}' - INTERVAL 7 DAY"
DAILY = f"""
    dl AS (SELECT warehouse_name, strftime(start_time, '%Y-%m-%d') AS query_date, SUM(credits_used) AS credits_day, CAST(SUM(bytes_scanned) AS DOUBLE) AS bytes_day
           FROM v_usage WHERE execution_status = 'SUCCESS' AND {SINCE} GROUP BY ALL)"""
TOTALS = f"""
    {DAILY}, tt AS (SELECT warehouse_name, ROUND(SUM(credits_day), 6) AS total_credits, SUM(bytes_day) AS bytes_scanned, COUNT(*) AS days_with_usage FROM dl GROUP BY 1)"""
RUNS = f"(SELECT greatest(COUNT(*), 1) FROM v_runs WHERE started_at >= TIMESTAMP '{RUNS_AS_OF}' - INTERVAL 7 DAY)"
MEASURES = f"""
    {TOTALS}, a1 AS (SELECT *, CAST(7 AS INT) AS lookback_days, {RUNS} AS pipeline_run_count, ROUND(total_credits * 3, 4) AS total_usd,
        ROUND(total_credits / 7, 6) AS daily_avg_credits, ROUND(bytes_scanned / 1073741824, 4) AS storage_gb FROM tt),
    a2 AS (SELECT *, ROUND(total_credits / pipeline_run_count, 6) AS cost_per_run, ROUND(storage_gb * 0.023e0, 4) AS storage_cost_usd,
        ROUND(daily_avg_credits * 30, 4) AS forecast_credits_30d FROM a1),
    a3 AS (SELECT *, ROUND(forecast_credits_30d * 3, 4) AS forecast_usd_30d,
        ROUND(least(100.0e0, greatest(0.0e0, 100.0e0 * (1 - daily_avg_credits / 100))), 2) AS cost_score FROM a2),
    me AS (SELECT *, CASE WHEN cost_score < 40 THEN 'high' WHEN cost_score < 70 THEN 'medium' ELSE 'low' END AS cost_severity FROM a3)"""


def _daily(t):
    return cost.daily_usage(t["v_usage"], EVENTS_END, group_by=GROUP)


def _measures(t):
    totals = cost.usage_totals(_daily(t), GROUP)
    return cost.cost_measures(totals, cost.run_count(t["v_runs"], RUNS_AS_OF).scalar())


@query("co_01_daily_usage", f"""
    WITH {DAILY} SELECT warehouse_name, query_date, ROUND(credits_day, 6) AS credits_day, bytes_day FROM dl""")
def _(t):
    return _daily(t).withColumn("credits_day", F.round("credits_day", 6))


@query("co_01_daily_usage_of_warehouse", f"""
    WITH {DAILY} SELECT query_date, ROUND(credits_day, 6) AS credits_day, bytes_day FROM dl WHERE warehouse_name = 'view'""")
def _(t):
    daily = cost.daily_usage(t["v_usage"], EVENTS_END, warehouse="view")
    return daily.withColumn("credits_day", F.round("credits_day", 6))


@query("co_02_daily_usage_from_records", f"""
    SELECT strftime(recorded_at, '%Y-%m-%d') AS query_date, ROUND(SUM(credits_used), 6) AS credits_day, 0.0e0 AS bytes_day
    FROM v_cost_records WHERE recorded_at >= TIMESTAMP '{EVENTS_END}' - INTERVAL 7 DAY GROUP BY 1""")
def _(t):
    daily = cost.daily_usage_from_records(t["v_cost_records"], EVENTS_END)
    return daily.withColumn("credits_day", F.round("credits_day", 6))


@query("co_03_usage_totals", f"WITH {TOTALS} SELECT * FROM tt")
def _(t):
    return cost.usage_totals(_daily(t), GROUP)


@query("co_03_daily_breakdown", f"WITH {DAILY} SELECT warehouse_name, query_date AS date, ROUND(credits_day, 6) AS credits FROM dl")
def _(t):
    return cost.daily_breakdown(_daily(t), GROUP)


@query("co_04_run_count", f"SELECT {RUNS} AS pipeline_run_count")
def _(t):
    return cost.run_count(t["v_runs"], RUNS_AS_OF)


@query("co_04_run_count_at_least_one", "SELECT greatest(COUNT(*), 1) AS pipeline_run_count FROM v_runs WHERE started_at >= TIMESTAMP '2030-01-01'")
def _(t):
    return cost.run_count(t["v_runs"], "2030-01-08")


@query("co_05_measures", f"""
    WITH {MEASURES} SELECT warehouse_name, total_usd, daily_avg_credits, cost_per_run, storage_gb, storage_cost_usd, pipeline_run_count, lookback_days FROM me""")
def _(t):
    return _measures(t).select(
        "warehouse_name", "total_usd", "daily_avg_credits", "cost_per_run", "storage_gb", "storage_cost_usd",
        "pipeline_run_count", "lookback_days",
    )


@query("co_06_forecast", f"""
    WITH {MEASURES} SELECT warehouse_name, DATE '2024-03-01' AS forecast_date, forecast_credits_30d AS predicted_credits,
        ROUND(forecast_credits_30d * 0.85e0, 4) AS lower_bound, ROUND(forecast_credits_30d * 1.15e0, 4) AS upper_bound, 'linear_extrapolation' AS model_used FROM me""")
def _(t):
    return cost.forecast(_measures(t), EVENTS_END, GROUP)


@query("co_06_daily_forecast", f"""
    WITH {MEASURES} SELECT warehouse_name, CAST(DATE '2024-01-31' + CAST(i AS INT) AS DATE) AS forecast_date, ROUND(daily_avg_credits, 4) AS predicted_credits,
        ROUND(daily_avg_credits * 0.85e0, 4) AS lower_bound, ROUND(daily_avg_credits * 1.15e0, 4) AS upper_bound, 'linear_extrapolation' AS model_used
    FROM me, range(1, 31) r(i)""")
def _(t):
    return cost.daily_forecast(_measures(t), EVENTS_END, GROUP)


@query("co_07_cost_score", "SELECT p_partkey, ROUND(least(100.0e0, greatest(0.0e0, 100.0e0 * (1 - p_size * 2.5e0 / 100))), 2) AS cost_score FROM part")
def _(t):
    return t["part"].select("p_partkey", cost.cost_score(F.col("p_size") * 2.5).alias("cost_score"))


@query("co_08_severity", """
    SELECT p_partkey, CASE WHEN p_size * 2 < 40 THEN 'high' WHEN p_size * 2 < 70 THEN 'medium' ELSE 'low' END AS severity FROM part""")
def _(t):
    return t["part"].select("p_partkey", cost_severity(F.col("p_size") * 2).alias("severity"))


@query("co_09_cost_report", f"WITH {MEASURES} SELECT * FROM me")
def _(t):
    return _measures(t)


@query("snk_08_cost_records", f"""
    WITH {MEASURES} SELECT warehouse_name, 'PIPELINE_RUN' AS query_type, ROUND(total_credits, 6) AS credits_used, total_usd AS credits_usd,
        CAST(bytes_scanned AS BIGINT) AS bytes_scanned, TIMESTAMP '{EVENTS_END}' AS recorded_at FROM me""")
def _(t):
    measured = _measures(t)
    at = F.lit(EVENTS_END).cast("timestamp_ntz")
    context = {"id": F.col("warehouse_name"), "dataset_id": F.lit("d"), "evaluated_at": at}
    rows = facts.cost_facts(measured, cost.forecast(measured, EVENTS_END, GROUP), context)["cost_records"]
    return rows.select(
        "warehouse_name", "query_type", F.col("credits_used").cast("double").alias("credits_used"),
        F.col("credits_usd").cast("double").alias("credits_usd"), "bytes_scanned", "recorded_at",
    )
