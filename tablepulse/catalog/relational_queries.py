"""Filters, joins, set operations, grouped aggregates and top-n."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepulse.catalog import query
from tablepulse.catalog.tables import EVENTS_END, ORDERS_END
from tablepulse.functions.scores import percent_true
from tablepulse.functions.times import look_ahead, look_back
from tablepulse.operators import relational as r
from tablepulse.plans import reports


@query("flt_01_look_back", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{EVENTS_END}' - INTERVAL 7 DAY")
def _(t):
    return look_back(t["events"], "ts", EVENTS_END, 7).select("event_id")


@query("flt_02_look_ahead", """
    SELECT warehouse_name, forecast_date, predicted_credits FROM v_forecast
    WHERE forecast_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")
def _(t):
    return look_ahead(t["v_forecast"], "forecast_date", "2024-01-10", 10).select(
        "warehouse_name", "forecast_date", "predicted_credits"
    )


@query("flt_03_dataset_label", "SELECT id FROM v_quality WHERE COALESCE(silver_table, dataset_id) = 'signup'")
def _(t):
    return r.dataset_filter(t["v_quality"], "signup").select("id")


@query("flt_04_optional_equality", """
    SELECT 'warehouse' AS kind, COUNT(*) AS n FROM v_cost WHERE warehouse_name = 'click'
    UNION ALL SELECT 'dataset', COUNT(*) FROM v_drift WHERE dataset_id = 'view'
    UNION ALL SELECT 'failure', COUNT(*) FROM v_heal WHERE upper(failure_type) = 'SYSTEM'
    UNION ALL SELECT 'all', COUNT(*) FROM v_cost""")
def _(t):
    kinds = {
        "warehouse": r.equals_if_given(t["v_cost"], "click", "warehouse_name"),
        "dataset": r.equals_if_given(t["v_drift"], "view", "dataset_id"),
        "failure": r.equals_if_given(t["v_heal"], "SYSTEM", F.upper("failure_type")),
        "all": r.equals_if_given(t["v_cost"], None, "warehouse_name"),
    }
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in kinds.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("flt_06_status_match", "SELECT id, status FROM v_runs WHERE lower(status) IN ('failed', 'error')")
def _(t):
    return t["v_runs"].filter(r.has_status("status", "failed", "error")).select("id", "status")


@query("jn_01_tasks_with_runs", """
    SELECT r.dag_id, COUNT(*) AS tasks, COUNT(DISTINCT r.id) AS runs, ROUND(SUM(t.duration_sec), 2) AS seconds
    FROM v_tasks t JOIN v_runs r ON r.id = t.run_id GROUP BY r.dag_id""")
def _(t):
    runs = t["v_runs"].select("id", "dag_id")
    joined = t["v_tasks"].join(runs, F.col("run_id") == F.col("id"))
    return joined.groupBy("dag_id").agg(
        F.count("*").alias("tasks"), F.count_distinct("id").alias("runs"), F.round(F.sum("duration_sec"), 2).alias("seconds")
    )


@query("jn_02_tasks_of_top_runs", """
    SELECT run_id, task_name FROM v_tasks WHERE run_id IN (SELECT id FROM v_runs ORDER BY started_at DESC NULLS LAST, id LIMIT 40)""")
def _(t):
    top = r.newest(t["v_runs"], 40, "started_at", "id")
    return r.keep_matching_top(t["v_tasks"], "run_id", top, "id").select("run_id", "task_name")


@query("jn_05_rows_of_latest_run", """
    SELECT quality_run_id, column_name FROM v_quality_metrics
    WHERE quality_run_id = (SELECT id FROM v_quality ORDER BY evaluated_at DESC NULLS LAST, id LIMIT 1)""")
def _(t):
    return r.rows_of_latest(t["v_quality_metrics"], "quality_run_id", t["v_quality"], "id", "evaluated_at").select(
        "quality_run_id", "column_name"
    )


@query("set_01_distinct_labels", "SELECT DISTINCT silver_table AS label FROM v_quality WHERE silver_table IS NOT NULL")
def _(t):
    return r.distinct_values(t["v_quality"], F.col("silver_table"), "label")


@query("agg_01_conditional_counts", """
    SELECT dag_id, COUNT(*) FILTER (status = 'success') AS success, COUNT(*) FILTER (status = 'failed') AS failed
    FROM v_runs GROUP BY dag_id""")
def _(t):
    return t["v_runs"].groupBy("dag_id").agg(
        F.count_if(r.has_status("status", "success")).alias("success"),
        F.count_if(r.has_status("status", "failed", "error")).alias("failed"),
    )


@query("agg_02_latest_value", """
    SELECT dataset_id, arg_max_null(range_fail_rate, (evaluated_at, id)) AS latest FROM v_quality GROUP BY dataset_id""")
def _(t):
    return t["v_quality"].groupBy("dataset_id").agg(
        F.max_by("range_fail_rate", F.struct("evaluated_at", "id")).alias("latest")
    )


@query("agg_03_daily_stats", """
    SELECT strftime(ts, '%Y-%m-%d') AS day, ROUND(AVG(value), 4) AS avg_value, MIN(value) AS min_value, MAX(value) AS max_value,
           COUNT(*) AS n FROM events GROUP BY ALL""")
def _(t):
    daily = r.daily_stats(t["events"], "ts", F.col("value"), n=F.count(F.lit(1)))
    return daily.withColumn("avg_value", F.round("avg_value", 4))


@query("agg_04_percent_true", """
    SELECT event_type, ROUND(AVG(CASE WHEN value > 50 THEN 100.0e0 ELSE 0.0e0 END), 4) AS percent FROM v_events_dirty GROUP BY event_type""")
def _(t):
    return t["v_events_dirty"].groupBy("event_type").agg(F.round(percent_true(F.col("value") > 50), 4).alias("percent"))


@query("agg_05_sums_by_layer", """
    SELECT pipeline_run_id, CAST(SUM(CASE WHEN source_layer = 'BRONZE' THEN rows_out ELSE 0 END) AS BIGINT) AS silver_rows,
           CAST(SUM(CASE WHEN source_layer = 'SILVER' THEN rows_out ELSE 0 END) AS BIGINT) AS gold_rows
    FROM v_lineage GROUP BY pipeline_run_id""")
def _(t):
    def rows_out(layer):
        return F.sum(F.when(F.col("source_layer") == layer, F.col("rows_out")).otherwise(0))

    return t["v_lineage"].groupBy("pipeline_run_id").agg(
        rows_out("BRONZE").alias("silver_rows"), rows_out("SILVER").alias("gold_rows")
    )


@query("agg_06_sums_by_layer_pair", """
    SELECT source_layer, target_layer, CAST(SUM(rows_in) AS BIGINT) AS total_rows_in, CAST(SUM(rows_out) AS BIGINT) AS total_rows_out,
           CAST(SUM(rows_rejected) AS BIGINT) AS total_rows_rejected, COUNT(*) AS run_count FROM v_lineage GROUP BY ALL""")
def _(t):
    return reports.lineage_summary(t["v_lineage"], ORDERS_END, 10_000)


@query("agg_07_pass_fail_counts", """
    SELECT quality_run_id, COUNT(*) FILTER (passed) AS passed_count, COUNT(*) FILTER (NOT passed) AS failed_count
    FROM v_quality_metrics GROUP BY quality_run_id""")
def _(t):
    return r.pass_fail_counts(t["v_quality_metrics"], "quality_run_id")


@query("top_01_newest_runs", """
    SELECT id, completed_at FROM v_runs ORDER BY completed_at DESC NULLS LAST, id LIMIT 50""")
def _(t):
    return r.newest(t["v_runs"], 50, "completed_at", "id").select("id", "completed_at")


@query("top_02_latest_row", "SELECT event_id, ts FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 1")
def _(t):
    return r.newest(t["events"], 1, "ts", "event_id").select("event_id", "ts")


@query("top_03_two_keys", """
    SELECT drift_run_id, column_name, psi_score FROM v_drift_metrics
    ORDER BY psi_score DESC NULLS LAST, column_name, drift_run_id LIMIT 60""")
def _(t):
    return r.newest(t["v_drift_metrics"], 60, "psi_score", "column_name", "drift_run_id").select(
        "drift_run_id", "column_name", "psi_score"
    )


@query("top_04_newest_and_oldest", """
    (SELECT 'current' AS side, o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500)
    UNION ALL (SELECT 'reference', o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500)""")
def _(t):
    from tablepulse.operators.drift import SIDE, newest_and_oldest

    sides = newest_and_oldest(t["orders"], "o_orderdate", "o_orderkey", n=500)
    return sides.select(F.when(F.col(SIDE), "current").otherwise("reference").alias("side"), "o_orderkey")


@query("top_05_top_psi_columns", """
    SELECT column_name, MAX(psi_score) AS psi_score FROM v_drift_metrics WHERE psi_score IS NOT NULL
    GROUP BY column_name ORDER BY 2 DESC, 1 LIMIT 3""")
def _(t):
    return reports.top_psi(t["v_drift_metrics"], 3).drop("band")
