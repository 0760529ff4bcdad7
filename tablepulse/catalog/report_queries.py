"""Monitoring reports on the derived fact views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepulse.catalog import query
from tablepulse.catalog.tables import EVENTS_END, ORDERS_END
from tablepulse.plans import reports

# The look-backs reach far enough to leave rows out on one side only.
DURATION_DAYS, LINEAGE_DAYS = 900, 400


def _rounded(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("mq_01_run_stats", """
    SELECT COUNT(*) AS total, COUNT(*) FILTER (lower(status) = 'success') AS success,
           COUNT(*) FILTER (lower(status) IN ('failed', 'error')) AS failed,
           COUNT(*) FILTER (lower(status) = 'running') AS running FROM v_runs""")
def _(t):
    return reports.run_stats(t["v_runs"])


@query("mq_02_recent_runs", """
    SELECT dataset_id, dag_id, run_id, status, rows_ingested, started_at, completed_at FROM v_runs
    ORDER BY started_at DESC NULLS LAST, id LIMIT 10""")
def _(t):
    return reports.recent_runs(t["v_runs"])


@query("mq_03_latest_quality", """
    SELECT quality_score AS score, passed, null_rate, duplicate_rate, type_mismatch_rate, evaluated_at
    FROM v_quality ORDER BY evaluated_at DESC NULLS LAST, id LIMIT 1""")
def _(t):
    return reports.latest_quality(t["v_quality"])


@query("mq_04_quality_trend", f"""
    SELECT strftime(evaluated_at, '%Y-%m-%d') AS day, ROUND(AVG(quality_score), 4) AS avg_score FROM v_quality
    WHERE evaluated_at >= TIMESTAMP '{EVENTS_END}' - INTERVAL 7 DAY GROUP BY ALL""")
def _(t):
    return _rounded(reports.quality_trend(t["v_quality"], EVENTS_END), "avg_score")


@query("mq_05_latest_drift", """
    SELECT drift_severity AS severity, drift_score AS score, drift_detected AS detected, drifted_columns, total_columns,
           drift_pct, evaluated_at FROM v_drift ORDER BY evaluated_at DESC NULLS LAST, id LIMIT 1""")
def _(t):
    return reports.latest_drift(t["v_drift"])


@query("mq_06_latest_cost", """
    SELECT cost_score AS score, cost_severity AS severity, total_usd, total_credits, forecast_usd_30d,
           daily_avg_credits, evaluated_at FROM v_cost ORDER BY evaluated_at DESC NULLS LAST, id LIMIT 1""")
def _(t):
    return reports.latest_cost(t["v_cost"])


HEAL_SUCCESS = """
    SELECT COUNT(*) AS total, COUNT(*) FILTER (upper(recovery_status) IN ('RESOLVED', 'RECOVERED')) AS recovered,
           COUNT(*) FILTER (quarantined) AS quarantined, ROUND(AVG(mttr_seconds), 4) AS avg_mttr,
           MAX(evaluated_at) AS evaluated_at,
           ROUND(COUNT(*) FILTER (upper(recovery_status) IN ('RESOLVED', 'RECOVERED')) * 1.0e0 / COUNT(*) * 100, 1) AS success_rate
    FROM v_heal"""


@query("mq_07_heal_success", HEAL_SUCCESS)
def _(t):
    return _rounded(reports.heal_success(t["v_heal"]), "avg_mttr")


@query("mq_08_overall_health", f"""
    WITH h AS ({HEAL_SUCCESS}),
    parts AS (SELECT
        (SELECT quality_score FROM v_quality ORDER BY evaluated_at DESC, id LIMIT 1) AS quality,
        (SELECT cost_score FROM v_cost ORDER BY evaluated_at DESC, id LIMIT 1) AS cost,
        (SELECT success_rate FROM h) AS heal,
        (SELECT CASE WHEN NOT drift_detected THEN 100.0e0 WHEN drift_severity = 'LOW' THEN 70 WHEN drift_severity = 'MEDIUM' THEN 40
                     WHEN drift_severity = 'HIGH' THEN 10 ELSE 30 END FROM v_drift ORDER BY evaluated_at DESC, id LIMIT 1) AS bonus),
    total AS (SELECT quality * 0.4e0 + cost * 0.2e0 + heal * 0.2e0 + bonus * 0.2e0 AS raw FROM parts)
    SELECT ROUND(raw, 1) AS score, CASE WHEN raw >= 85 THEN 'Excellent' WHEN raw >= 70 THEN 'Good' WHEN raw >= 50 THEN 'Fair'
           ELSE 'At Risk' END AS label, TRUE AS any_data FROM total""")
def _(t):
    return reports.overall_health(t["v_quality"], t["v_cost"], t["v_heal"], t["v_drift"])


SECONDS = f"date_diff('second', started_at, COALESCE(completed_at, TIMESTAMP '{ORDERS_END}'))"


@query("mq_09_run_kpis", f"""
    SELECT COUNT(*) AS total, COUNT(*) FILTER (lower(status) = 'success') AS success,
           COUNT(*) FILTER (lower(status) IN ('failed', 'error')) AS failed,
           COUNT(*) FILTER (lower(status) = 'running') AS running, ROUND(AVG({SECONDS}), 4) AS avg_duration_sec,
           ROUND(COUNT(*) FILTER (lower(status) = 'success') * 1.0e0 / COUNT(*) * 100, 1) AS success_rate FROM v_runs""")
def _(t):
    return _rounded(reports.run_kpis(t["v_runs"], ORDERS_END), "avg_duration_sec")


@query("mq_10_recent_dag_runs", f"""
    SELECT dag_id, run_id, status, rows_ingested, rows_rejected, started_at, completed_at, {SECONDS} AS duration_sec
    FROM v_runs ORDER BY started_at DESC NULLS LAST, id LIMIT 15""")
def _(t):
    return reports.recent_dag_runs(t["v_runs"], ORDERS_END)


@query("mq_11_duration_trend", f"""
    SELECT strftime(started_at, '%Y-%m-%d') AS day, ROUND(AVG(date_diff('second', started_at, completed_at)), 4) AS avg_sec,
           CAST(MIN(date_diff('second', started_at, completed_at)) AS DOUBLE) AS min_sec,
           CAST(MAX(date_diff('second', started_at, completed_at)) AS DOUBLE) AS max_sec
    FROM v_runs WHERE completed_at IS NOT NULL AND started_at >= TIMESTAMP '{ORDERS_END}' - INTERVAL {DURATION_DAYS} DAY
    GROUP BY ALL""")
def _(t):
    return _rounded(reports.duration_trend(t["v_runs"], ORDERS_END, DURATION_DAYS), "avg_sec")


TIMELINE = f"""
    SELECT t.run_id, r.dag_id, t.task_name, t.task_type, t.status, t.started_at, t.completed_at,
           COALESCE(t.duration_sec, CAST(date_diff('second', t.started_at, COALESCE(t.completed_at, TIMESTAMP '{ORDERS_END}')) AS DOUBLE)) AS duration_sec,
           t.retry_count
    FROM v_tasks t JOIN v_runs r ON r.id = t.run_id
    WHERE r.id IN (SELECT id FROM v_runs ORDER BY started_at DESC NULLS LAST, id LIMIT 25)"""


@query("mq_12_task_timeline", TIMELINE)
def _(t):
    return reports.task_timeline(t["v_tasks"], t["v_runs"], ORDERS_END, 25)


LINEAGE = f"""
    SELECT source_layer, target_layer, CAST(SUM(rows_in) AS BIGINT) AS total_rows_in, CAST(SUM(rows_out) AS BIGINT) AS total_rows_out,
           CAST(SUM(rows_rejected) AS BIGINT) AS total_rows_rejected, COUNT(*) AS run_count
    FROM v_lineage WHERE event_at >= TIMESTAMP '{ORDERS_END}' - INTERVAL {LINEAGE_DAYS} DAY GROUP BY ALL"""


@query("mq_13_lineage_summary", LINEAGE)
def _(t):
    return reports.lineage_summary(t["v_lineage"], ORDERS_END, LINEAGE_DAYS)


@query("mq_14_layer_stats", """
    SELECT CAST(SUM(CASE WHEN source_layer = 'BRONZE' THEN rows_in ELSE 0 END) AS BIGINT) AS bronze_rows,
           CAST(SUM(CASE WHEN source_layer = 'BRONZE' THEN rows_out ELSE 0 END) AS BIGINT) AS silver_rows,
           CAST(SUM(CASE WHEN source_layer = 'SILVER' THEN rows_out ELSE 0 END) AS BIGINT) AS gold_rows,
           CAST(SUM(rows_rejected) AS BIGINT) AS total_rejected, MAX(event_at) AS latest_event_at FROM v_lineage""")
def _(t):
    return reports.layer_stats(t["v_lineage"])


@query("mq_15_quality_datasets", """
    SELECT DISTINCT COALESCE(silver_table, dataset_id, 'unknown') AS dataset_label FROM v_quality
    WHERE silver_table IS NOT NULL OR dataset_id IS NOT NULL""")
def _(t):
    return reports.quality_datasets(t["v_quality"])


QUALITY_KPIS = """
    SELECT COUNT(*) AS total_runs, COUNT(*) FILTER (passed) AS passed_runs, COUNT(*) FILTER (NOT passed) AS failed_runs,
           ROUND(AVG(CASE WHEN passed THEN 100.0e0 ELSE 0.0e0 END), 4) AS pass_rate,
           arg_max_null(quality_score, (evaluated_at, id)) AS latest_score, arg_max_null(total_rows, (evaluated_at, id)) AS latest_total_rows,
           arg_max_null(null_rate, (evaluated_at, id)) AS latest_null_rate, arg_max_null(duplicate_rate, (evaluated_at, id)) AS latest_dup_rate,
           arg_max_null(type_mismatch_rate, (evaluated_at, id)) AS latest_type_rate, arg_max_null(range_fail_rate, (evaluated_at, id)) AS latest_range_rate,
           arg_max_null(freshness_hours, (evaluated_at, id)) AS latest_freshness_hours, MAX(evaluated_at) AS latest_evaluated_at
    FROM v_quality {where}"""


@query("mq_16_quality_kpis", QUALITY_KPIS.format(where=""))
def _(t):
    return _rounded(reports.quality_kpis(t["v_quality"]), "pass_rate")


@query("mq_16_quality_kpis_dataset", QUALITY_KPIS.format(where="WHERE COALESCE(silver_table, dataset_id) = 'error_silver'"))
def _(t):
    return _rounded(reports.quality_kpis(t["v_quality"], "error_silver"), "pass_rate")


@query("mq_17_quality_score_trend", f"""
    SELECT strftime(evaluated_at, '%Y-%m-%d') AS day, ROUND(AVG(quality_score), 4) AS avg_score, MIN(quality_score) AS min_score,
           MAX(quality_score) AS max_score, COUNT(*) AS run_count FROM v_quality
    WHERE evaluated_at >= TIMESTAMP '{EVENTS_END}' - INTERVAL 14 DAY GROUP BY ALL""")
def _(t):
    return _rounded(reports.quality_score_trend(t["v_quality"], EVENTS_END, 14), "avg_score")


@query("mq_18_quality_history", """
    SELECT id, COALESCE(silver_table, dataset_id, 'unknown') AS dataset_label, quality_score, total_rows, passed, null_rate,
           duplicate_rate, type_mismatch_rate, range_fail_rate, freshness_hours, evaluated_at
    FROM v_quality WHERE COALESCE(silver_table, dataset_id) = 'signup' ORDER BY evaluated_at DESC NULLS LAST, id LIMIT 20""")
def _(t):
    return reports.quality_history(t["v_quality"], dataset="signup")


@query("mq_19_quality_columns", """
    SELECT column_name, metric_type, metric_value, threshold, passed FROM v_quality_metrics
    WHERE quality_run_id = (SELECT id FROM v_quality ORDER BY evaluated_at DESC NULLS LAST, id LIMIT 1)""")
def _(t):
    return reports.quality_columns(t["v_quality_metrics"], t["v_quality"])


@query("mq_20_drift_datasets", "SELECT DISTINCT dataset_id FROM v_drift WHERE dataset_id IS NOT NULL")
def _(t):
    return reports.drift_datasets(t["v_drift"])


@query("mq_21_drift_kpis", """
    SELECT COUNT(*) AS total_runs, COUNT(*) FILTER (drift_detected) AS detected_runs,
           ROUND(AVG(CASE WHEN drift_detected THEN 100.0e0 ELSE 0.0e0 END), 4) AS detection_rate,
           arg_max_null(drift_score, (evaluated_at, id)) AS latest_score, arg_max_null(drift_severity, (evaluated_at, id)) AS latest_severity,
           NULLIF(arg_max_null(drifted_columns, (evaluated_at, id)), 0) AS latest_drifted_columns,
           NULLIF(arg_max_null(total_columns, (evaluated_at, id)), 0) AS latest_total_columns,
           arg_max_null(drift_pct, (evaluated_at, id)) AS latest_drift_pct, ROUND(AVG(drift_score), 6) AS avg_score,
           ROUND(AVG(drift_score), 6) AS avg_psi, MAX(evaluated_at) AS latest_evaluated_at
    FROM v_drift WHERE dataset_id = 'view'""")
def _(t):
    return _rounded(_rounded(reports.drift_kpis(t["v_drift"], "view"), "detection_rate"), "avg_score", "avg_psi", digits=6)


DRIFT_TREND = f"""
    SELECT strftime(evaluated_at, '%Y-%m-%d') AS day, ROUND(AVG(drift_score), 6) AS avg_score, MIN(drift_score) AS min_score,
           MAX(drift_score) AS max_score, COUNT(*) AS run_count, COUNT(*) FILTER (drift_detected) AS detected_count
    FROM v_drift WHERE evaluated_at >= TIMESTAMP '{EVENTS_END}' - INTERVAL 20 DAY GROUP BY ALL"""


@query("mq_22_drift_score_trend", DRIFT_TREND)
def _(t):
    return _rounded(reports.drift_score_trend(t["v_drift"], EVENTS_END, 20), "avg_score", digits=6)


@query("mq_23_drift_history", """
    SELECT id, dataset_id, overall_drift_score, drift_detected, reference_window_start, reference_window_end,
           current_window_start, current_window_end, evaluated_at
    FROM v_drift_runs ORDER BY evaluated_at DESC NULLS LAST, id LIMIT 20""")
def _(t):
    return reports.drift_history(t["v_drift_runs"])


@query("mq_24_drift_columns", """
    SELECT column_name, drift_method, statistic_value, p_value, psi_score, drift_detected, severity FROM v_drift_metrics
    WHERE drift_run_id = (SELECT id FROM v_drift_days ORDER BY evaluated_at DESC NULLS LAST, id LIMIT 1)
    ORDER BY psi_score DESC NULLS LAST, column_name LIMIT 50""")
def _(t):
    return reports.drift_columns(t["v_drift_metrics"], t["v_drift_days"])


@query("mq_25_cost_warehouses", "SELECT DISTINCT warehouse_name FROM v_cost WHERE warehouse_name IS NOT NULL")
def _(t):
    return reports.cost_warehouses(t["v_cost"])


COST_KPIS = """
    SELECT ROUND(AVG(cost_score), 4) AS cost_score, ROUND(SUM(total_credits), 4) AS total_credits,
           ROUND(SUM(total_usd), 4) AS total_cost_usd, ROUND(AVG(total_credits), 4) AS daily_avg_credits,
           MAX(evaluated_at) AS latest_evaluated_at,
           (SELECT ROUND(SUM(predicted_credits * 3), 4) FROM v_forecast WHERE forecast_date BETWEEN DATE '2024-01-10' AND DATE '2024-02-09' {forecast}) AS forecast_cost_usd
    FROM v_cost {summary}"""
COST_MONEY = ["cost_score", "total_credits", "total_cost_usd", "daily_avg_credits", "forecast_cost_usd"]


@query("mq_26_cost_kpis", COST_KPIS.format(forecast="", summary=""))
def _(t):
    return _rounded(reports.cost_kpis(t["v_cost"], t["v_forecast"], "2024-01-10"), *COST_MONEY)


@query("mq_26_cost_kpis_warehouse", COST_KPIS.format(
    forecast="AND warehouse_name = 'click'", summary="WHERE warehouse_name = 'click'"))
def _(t):
    return _rounded(reports.cost_kpis(t["v_cost"], t["v_forecast"], "2024-01-10", "click"), *COST_MONEY)


@query("mq_27_credit_trend", f"""
    SELECT strftime(evaluated_at, '%Y-%m-%d') AS day, warehouse_name, ROUND(SUM(total_credits), 4) AS credits_used,
           ROUND(SUM(total_usd), 4) AS cost_usd FROM v_cost
    WHERE evaluated_at >= TIMESTAMP '{EVENTS_END}' - INTERVAL 15 DAY GROUP BY ALL""")
def _(t):
    return _rounded(reports.credit_trend(t["v_cost"], EVENTS_END, 15), "credits_used", "cost_usd")


@query("mq_28_cost_history", """
    SELECT id, warehouse_name, service_type, credits_used, cost_usd, usage_date, created_at FROM v_cost_records
    ORDER BY usage_date DESC NULLS LAST, created_at DESC NULLS LAST, id LIMIT 20""")
def _(t):
    return reports.cost_history(t["v_cost_records"])


@query("mq_29_cost_forecasts", """
    SELECT forecast_date, warehouse_name, predicted_credits AS forecast_credits, ROUND(predicted_credits * 3, 4) AS forecast_cost_usd,
           lower_bound AS confidence_lower, upper_bound AS confidence_upper
    FROM v_forecast WHERE forecast_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")
def _(t):
    return _rounded(reports.cost_forecasts(t["v_forecast"], "2024-01-10", days=10), "forecast_cost_usd")


@query("mq_30_heal_kpis", """
    SELECT COUNT(*) AS total, COUNT(*) FILTER (upper(recovery_status) = 'RESOLVED') AS resolved,
           COUNT(*) FILTER (upper(recovery_status) = 'FAILED') AS failed,
           COUNT(*) FILTER (upper(recovery_status) = 'ESCALATED') AS escalated, COUNT(*) FILTER (quarantined) AS quarantined,
           ROUND(AVG(mttr_seconds), 4) AS avg_mttr, MAX(evaluated_at) AS latest_eval,
           ROUND(COUNT(*) FILTER (upper(recovery_status) = 'RESOLVED') * 1.0e0 / COUNT(*) * 100, 1) AS recovery_rate FROM v_heal""")
def _(t):
    return _rounded(reports.heal_kpis(t["v_heal"]), "avg_mttr")


@query("mq_31_failure_distribution", """
    SELECT upper(failure_type) AS failure_type, COUNT(*) AS count FROM v_heal WHERE failure_type IS NOT NULL GROUP BY upper(failure_type)""")
def _(t):
    return reports.failure_distribution(t["v_heal"])


HEAL_TREND = f"""
    SELECT strftime(evaluated_at, '%Y-%m-%d') AS day, COUNT(*) AS total,
           COUNT(*) FILTER (upper(recovery_status) = 'RESOLVED') AS resolved,
           COUNT(*) FILTER (upper(recovery_status) = 'FAILED') AS failed,
           COUNT(*) FILTER (upper(recovery_status) = 'ESCALATED') AS escalated,
           ROUND(AVG(mttr_seconds), 4) AS avg_mttr,
           ROUND(COUNT(*) FILTER (upper(recovery_status) = 'RESOLVED') * 1.0e0 / COUNT(*) * 100, 1) AS recovery_rate
    FROM v_heal WHERE evaluated_at >= TIMESTAMP '{EVENTS_END}' - INTERVAL 20 DAY GROUP BY ALL"""


@query("mq_32_heal_trend", HEAL_TREND)
def _(t):
    return _rounded(reports.heal_trend(t["v_heal"], EVENTS_END, 20), "avg_mttr")


@query("mq_33_heal_history", """
    SELECT id, dataset_id, pipeline_run_id, upper(failure_type) AS failure_type, healing_strategy,
           upper(recovery_status) AS recovery_status, retry_count, mttr_seconds, actions_taken, actions_succeeded,
           quarantined, evaluated_at
    FROM v_heal WHERE upper(failure_type) = 'SYSTEM' ORDER BY evaluated_at DESC NULLS LAST, id LIMIT 20""")
def _(t):
    return reports.heal_history(t["v_heal"], failure_type="system")


@query("mq_34_heal_actions", """
    SELECT id, heal_run_id, action_type, action_detail, success, executed_at FROM v_heal_actions
    WHERE heal_run_id = (SELECT id FROM v_heal ORDER BY evaluated_at DESC NULLS LAST, id LIMIT 1)""")
def _(t):
    runs = t["v_heal"].withColumnRenamed("evaluated_at", "created_at")
    return reports.heal_actions(t["v_heal_actions"], runs)


@query("mq_35_flow_links", f"""
    WITH s AS ({LINEAGE})
    SELECT source_layer AS source, target_layer AS target, total_rows_out AS rows, run_count FROM s WHERE total_rows_out > 0
    UNION ALL SELECT source_layer, 'REJECTED', total_rows_rejected, run_count FROM s WHERE total_rows_rejected > 0""")
def _(t):
    return reports.flow_links(reports.lineage_summary(t["v_lineage"], ORDERS_END, LINEAGE_DAYS))


@query("mq_36_timeline_bars", f"""
    WITH s AS ({TIMELINE})
    SELECT task_name, status, started_at, COALESCE(completed_at, started_at) AS completed_at,
           concat(COALESCE(dag_id, 'run'), ' · ', right(run_id, 8)) AS run_label FROM s WHERE started_at IS NOT NULL""")
def _(t):
    return reports.timeline_bars(reports.task_timeline(t["v_tasks"], t["v_runs"], ORDERS_END, 25))


@query("mq_37_rate_distribution", f"""
    WITH k AS ({QUALITY_KPIS.format(where='')}),
    m AS (SELECT 'Null Rate' AS metric, latest_null_rate * 100 AS percent FROM k UNION ALL
          SELECT 'Duplicate Rate', latest_dup_rate * 100 FROM k UNION ALL
          SELECT 'Type Mismatch Rate', latest_type_rate * 100 FROM k UNION ALL
          SELECT 'Range Fail Rate', latest_range_rate * 100 FROM k)
    SELECT metric, percent, CASE WHEN percent < 5 THEN 'low' WHEN percent < 15 THEN 'medium' ELSE 'high' END AS band
    FROM m WHERE percent IS NOT NULL""")
def _(t):
    return reports.rate_distribution(reports.quality_kpis(t["v_quality"]))


@query("mq_38_column_pass_fail", """
    SELECT column_name, COUNT(*) FILTER (passed) AS passed_count, COUNT(*) FILTER (NOT passed) AS failed_count
    FROM v_quality_metrics GROUP BY column_name""")
def _(t):
    return reports.column_pass_fail(t["v_quality_metrics"])


@query("mq_39_detected_and_stable", f"""
    WITH s AS ({DRIFT_TREND}) SELECT day, detected_count, run_count - detected_count AS stable_count FROM s""")
def _(t):
    return reports.detected_and_stable(reports.drift_score_trend(t["v_drift"], EVENTS_END, 20))


@query("mq_39_detected_and_stable_totals", f"""
    WITH s AS ({DRIFT_TREND})
    SELECT CAST(SUM(detected_count) AS BIGINT) AS detected_total, CAST(SUM(run_count - detected_count) AS BIGINT) AS stable_total FROM s""")
def _(t):
    return reports.detected_and_stable_totals(reports.drift_score_trend(t["v_drift"], EVENTS_END, 20))


@query("mq_40_top_psi", """
    SELECT column_name, MAX(psi_score) AS psi_score,
           CASE WHEN MAX(psi_score) < 0.1 THEN 'stable' WHEN MAX(psi_score) < 0.2 THEN 'moderate' ELSE 'significant' END AS band
    FROM v_drift_metrics WHERE psi_score IS NOT NULL GROUP BY column_name ORDER BY 2 DESC, 1 LIMIT 20""")
def _(t):
    return reports.top_psi(t["v_drift_metrics"])


@query("mq_41_drifted_and_stable_columns", """
    WITH k AS (SELECT arg_max_null(drifted_columns, (evaluated_at, id)) AS d, arg_max_null(total_columns, (evaluated_at, id)) AS n FROM v_drift)
    SELECT COALESCE(d, 0) AS drifted, greatest(0, n - COALESCE(d, 0)) AS stable FROM k WHERE n > 0""")
def _(t):
    return reports.drifted_and_stable_columns(reports.drift_kpis(t["v_drift"]))


@query("mq_42_credit_trend_by_day", f"""
    SELECT strftime(evaluated_at, '%Y-%m-%d') AS day, ROUND(SUM(total_credits), 4) AS credits_used,
           ROUND(SUM(total_usd), 4) AS cost_usd FROM v_cost
    WHERE evaluated_at >= TIMESTAMP '{EVENTS_END}' - INTERVAL 15 DAY GROUP BY ALL""")
def _(t):
    trend = reports.credit_trend(t["v_cost"], EVENTS_END, 15)
    return _rounded(reports.credit_trend_by_day(trend), "credits_used", "cost_usd")


@query("mq_43_recovery_breakdown", """
    SELECT s.recovery_status, COUNT(h.id) AS count FROM (VALUES ('RESOLVED'), ('ESCALATED'), ('FAILED')) s(recovery_status)
    LEFT JOIN v_heal h ON upper(h.recovery_status) = s.recovery_status GROUP BY s.recovery_status""")
def _(t):
    return reports.recovery_breakdown(reports.heal_kpis(t["v_heal"]))


@query("mq_44_mttr_trend", f"""
    WITH s AS ({HEAL_TREND}) SELECT day, avg_mttr FROM s WHERE avg_mttr > 0""")
def _(t):
    return _rounded(reports.mttr_trend(reports.heal_trend(t["v_heal"], EVENTS_END, 20)), "avg_mttr")
