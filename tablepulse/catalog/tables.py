"""The given tables and the fact-shaped views derived from them.

The views are SQL that Spark and the comparison engine both run; they inject NULLs
and duplicates and give the given tables the shape of the fact tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Points in time just after the last event and the last ship date.
EVENTS_END = "2024-01-31 00:00:00"
ORDERS_END = "2001-11-05 00:00:00"
EVENTS_SPLIT = "2024-01-16 00:00:00"
LINES_SPLIT = "1998-06-01 00:00:00"

VIEWS = {
    "v_events_dirty": """
        SELECT event_id, ts, CASE WHEN event_id % 20 = 0 THEN NULL ELSE user_id END AS user_id, event_type,
               CASE WHEN event_id % 25 = 0 THEN NULL ELSE value END AS value, props
        FROM events
        UNION ALL
        SELECT event_id, ts, CASE WHEN event_id % 20 = 0 THEN NULL ELSE user_id END, event_type,
               CASE WHEN event_id % 25 = 0 THEN NULL ELSE value END, props
        FROM events WHERE event_id % 50 = 0""",
    "v_runs": """
        SELECT CAST(o.o_orderkey AS STRING) AS id, CAST(o.o_custkey AS STRING) AS dataset_id,
               o.o_orderpriority AS dag_id, concat('run_', CAST(o.o_orderkey AS STRING)) AS run_id,
               CASE o.o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
               COALESCE(l.n, 0) AS rows_ingested, COALESCE(l.r, 0) AS rows_rejected, o.o_orderdate AS started_at,
               CASE WHEN o.o_orderstatus = 'O' THEN NULL ELSE l.last_ship END AS completed_at
        FROM orders o LEFT JOIN (
          SELECT l_orderkey, COUNT(*) AS n, CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS r,
                 MAX(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    "v_tasks": """
        SELECT CAST(l_orderkey AS STRING) AS run_id, concat('task_', CAST(l_linenumber AS STRING)) AS task_name,
               l_returnflag AS task_type, CASE l_linestatus WHEN 'F' THEN 'success' ELSE 'running' END AS status,
               l_shipdate AS started_at, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate ELSE NULL END AS completed_at,
               CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS duration_sec,
               CAST(l_linenumber % 3 AS INT) AS retry_count, l_partkey, l_suppkey FROM lineitem""",
    "v_lineage": """
        SELECT run_id AS pipeline_run_id, dataset_id, started_at AS event_at, 'BRONZE' AS source_layer,
               'SILVER' AS target_layer, rows_ingested AS rows_in, rows_ingested - rows_rejected AS rows_out,
               rows_rejected FROM v_runs
        UNION ALL
        SELECT run_id, dataset_id, started_at, 'SILVER', 'GOLD', rows_ingested - rows_rejected, CAST(1 AS BIGINT),
               CAST(0 AS BIGINT) FROM v_runs WHERE status = 'success'""",
    "v_quality": """
        SELECT concat(event_type, '_', CAST(CAST(ts AS DATE) AS STRING)) AS id,
               CASE WHEN event_type = 'signup' THEN NULL ELSE concat(event_type, '_silver') END AS silver_table,
               event_type AS dataset_id, COUNT(*) AS total_rows,
               ROUND(SUM(CASE WHEN value IS NULL THEN 1 ELSE 0 END) * 1.0e0 / COUNT(*), 6) AS null_rate,
               ROUND(100.0e0 - 200.0e0 * SUM(CASE WHEN value IS NULL OR user_id IS NULL THEN 1 ELSE 0 END) / COUNT(*), 2) AS quality_score,
               SUM(CASE WHEN value IS NULL OR user_id IS NULL THEN 1 ELSE 0 END) * 10 <= COUNT(*) AS passed,
               ROUND((COUNT(*) - COUNT(DISTINCT event_id)) * 1.0e0 / COUNT(*), 6) AS duplicate_rate,
               ROUND(SUM(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) * 0.5e0 / COUNT(*), 6) AS type_mismatch_rate,
               CASE WHEN event_type = 'error' THEN NULL
                    ELSE ROUND(SUM(CASE WHEN value > 50 THEN 1 ELSE 0 END) * 1.0e0 / COUNT(*), 6) END AS range_fail_rate,
               ROUND(MIN(value), 2) AS freshness_hours,
               MAX(ts) AS evaluated_at
        FROM v_events_dirty GROUP BY event_type, CAST(ts AS DATE)""",
    "v_quality_metrics": """
        SELECT id AS quality_run_id, 'value' AS column_name, 'null_rate' AS metric_type, null_rate AS metric_value,
               0.05e0 AS threshold, null_rate <= 0.05e0 AS passed, evaluated_at FROM v_quality
        UNION ALL
        SELECT id, 'user_id', 'type_mismatch', 0.0e0, 0.01e0, TRUE, evaluated_at FROM v_quality""",
    "v_drift": """
        SELECT id, CASE WHEN total_rows % 9 = 0 THEN NULL ELSE dataset_id END AS dataset_id,
               ROUND(abs(quality_score - 80) / 100, 4) AS drift_score, quality_score < 80 AS drift_detected,
               CASE WHEN quality_score < 72 THEN 'HIGH' WHEN quality_score < 80 THEN 'MEDIUM' ELSE 'LOW' END AS drift_severity,
               CASE WHEN quality_score < 72 THEN 3 WHEN quality_score < 80 THEN 1 ELSE 0 END AS drifted_columns,
               4 AS total_columns,
               CASE WHEN quality_score < 72 THEN 75.0e0 WHEN quality_score < 80 THEN 25.0e0 ELSE 0.0e0 END AS drift_pct,
               evaluated_at FROM v_quality""",
    "v_drift_runs": """
        SELECT d.id, d.dataset_id, d.drift_score AS overall_drift_score, d.drift_detected,
               w.first_seen AS reference_window_start, d.evaluated_at AS reference_window_end,
               d.evaluated_at AS current_window_start, w.last_seen AS current_window_end, d.evaluated_at
        FROM v_drift d JOIN v_quality q ON d.id = q.id
        JOIN (SELECT dataset_id, MIN(evaluated_at) AS first_seen, MAX(evaluated_at) AS last_seen
              FROM v_quality GROUP BY dataset_id) w ON q.dataset_id = w.dataset_id""",
    "v_drift_metrics": """
        SELECT CAST(CAST(evaluated_at AS DATE) AS STRING) AS drift_run_id, dataset_id AS column_name,
               CASE WHEN dataset_id = 'view' THEN NULL ELSE ROUND(null_rate * 3, 6) END AS psi_score,
               ROUND(null_rate, 6) AS statistic_value, ROUND(1 - null_rate, 6) AS p_value,
               'ks_test+psi' AS drift_method, null_rate > 0.06e0 AS drift_detected,
               CASE WHEN null_rate > 0.06e0 THEN 'HIGH' ELSE 'LOW' END AS severity FROM v_quality""",
    "v_drift_days": """
        SELECT CAST(CAST(evaluated_at AS DATE) AS STRING) AS id, MAX(evaluated_at) AS evaluated_at
        FROM v_quality GROUP BY CAST(evaluated_at AS DATE)""",
    "v_usage": """
        SELECT event_id, event_type AS warehouse_name, ts AS start_time, ROUND(value / 100, 6) AS credits_used,
               user_id * 1000000 AS bytes_scanned,
               CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'SUCCESS' END AS execution_status FROM events""",
    "v_cost": """
        SELECT concat(warehouse_name, '_', CAST(CAST(start_time AS DATE) AS STRING)) AS id, warehouse_name,
               ROUND(SUM(credits_used), 4) AS total_credits, ROUND(SUM(credits_used) * 3, 4) AS total_usd,
               ROUND(greatest(0.0e0, 100 * (1 - SUM(credits_used) / 100)), 2) AS cost_score,
               CASE WHEN SUM(credits_used) > 60 THEN 'high' WHEN SUM(credits_used) > 30 THEN 'medium' ELSE 'low' END AS cost_severity,
               ROUND(SUM(credits_used) / 7, 4) AS daily_avg_credits,
               ROUND(SUM(credits_used) * 90 / 7, 4) AS forecast_usd_30d,
               MAX(start_time) AS evaluated_at
        FROM v_usage GROUP BY warehouse_name, CAST(start_time AS DATE)""",
    "v_cost_records": """
        SELECT CAST(event_id AS STRING) AS id, warehouse_name, 'COMPUTE' AS service_type, credits_used,
               ROUND(credits_used * 3, 6) AS cost_usd, CAST(start_time AS DATE) AS usage_date,
               start_time AS created_at, start_time AS recorded_at FROM v_usage""",
    "v_forecast": """
        SELECT warehouse_name, CAST(evaluated_at AS DATE) AS forecast_date, total_credits AS predicted_credits,
               ROUND(total_credits * 0.85e0, 6) AS lower_bound, ROUND(total_credits * 1.15e0, 6) AS upper_bound FROM v_cost""",
    "v_failures": """
        SELECT CAST(event_id AS STRING) AS event_id, CAST(user_id AS STRING) AS dataset_id,
               concat('run_', CAST(event_id AS STRING)) AS pipeline_run_id, ts AS detected_at,
               CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'Broker TIMEOUT on socket' WHEN 1 THEN 'null rate above limit'
                 WHEN 2 THEN 'PSI shift in column' WHEN 3 THEN 'out of memory' WHEN 4 THEN 'schema error: connection refused'
                 ELSE NULL END AS failure_reason,
               CAST(user_id % 4 AS INT) AS retry_count FROM events WHERE event_type = 'error'""",
    "v_heal": """
        SELECT event_id AS id, dataset_id, pipeline_run_id, detected_at AS evaluated_at, retry_count,
               CASE WHEN failure_reason IS NULL THEN 'system' WHEN failure_reason LIKE '%null%' THEN 'QUALITY'
                    WHEN failure_reason LIKE 'PSI%' THEN 'DRIFT' ELSE 'CONNECTION' END AS failure_type,
               CASE WHEN failure_reason LIKE '%null%' THEN 'quarantine' ELSE 'retry' END AS healing_strategy,
               CASE WHEN retry_count >= 2 THEN 'ESCALATED' WHEN retry_count = 1 THEN 'FAILED' ELSE 'resolved' END AS recovery_status,
               retry_count >= 2 AS quarantined, CAST(retry_count * 12.5e0 AS DOUBLE) AS mttr_seconds,
               CASE WHEN retry_count >= 2 THEN 2 ELSE 3 END AS actions_taken,
               CASE WHEN retry_count = 1 THEN 2 ELSE 3 END AS actions_succeeded FROM v_failures""",
    "v_heal_actions": """
        SELECT concat(id, '_1') AS id, id AS heal_run_id, 'UPDATE_PIPELINE_STATUS' AS action_type,
               concat('run ', pipeline_run_id, ' marked as healing') AS action_detail,
               retry_count <> 1 AS success, evaluated_at AS executed_at FROM v_heal
        UNION ALL
        SELECT concat(id, '_2'), id, 'UPDATE_PIPELINE_FINAL_STATUS', concat('run ends as ', lower(recovery_status)),
               TRUE, evaluated_at FROM v_heal""",
    "v_bronze": """
        SELECT CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE o_orderdate END AS _loaded_at, o_orderkey AS _row_number,
               o_orderpriority AS _pipeline_run_id, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders""",
    "v_schema_versions": """
        SELECT CAST(n_regionkey AS STRING) AS dataset_id, CAST(n_nationkey AS INT) AS version,
               concat('[{"name":"id","snowflake_type":"NUMBER(18,0)"},{"name":"', lower(n_name), '","snowflake_type":"FLOAT"}]') AS schema_json
        FROM nation""",
    "v_dataset_events": """
        SELECT CAST(o_custkey AS STRING) AS dataset_id, o_orderkey AS event_no, o_orderdate AS event_ts,
               CASE WHEN o_orderstatus = 'O' THEN concat('customer_', CAST(o_custkey AS STRING)) ELSE NULL END AS name,
               CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE NULL END AS domain,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'csv' WHEN '2-HIGH' THEN 'json' WHEN '5-LOW' THEN 'jsonl' ELSE NULL END AS source_type,
               CASE WHEN o_orderstatus = 'O' THEN concat('t', CAST(o_orderkey AS STRING), '_raw') ELSE NULL END AS bronze_table,
               CASE WHEN o_orderstatus = 'F' THEN concat('t', CAST(o_orderkey AS STRING), '_silver') ELSE NULL END AS silver_table,
               CASE WHEN o_orderstatus = 'P' THEN concat('t', CAST(o_orderkey AS STRING), '_gold') ELSE NULL END AS gold_table,
               o_totalprice > 50000 AS is_active
        FROM orders""",
    "v_datasets": """
        SELECT d.*, b.bronze_table, s.silver_table, g.gold_table, n.name, m.domain, y.source_type, a.is_active
        FROM (SELECT dataset_id, MIN(event_ts) AS created_at, MAX(event_ts) AS updated_at FROM v_dataset_events GROUP BY dataset_id) d
        LEFT JOIN (SELECT dataset_id, bronze_table FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_id ORDER BY event_ts DESC, event_no DESC) AS rn FROM v_dataset_events WHERE bronze_table IS NOT NULL) t WHERE rn = 1) b ON d.dataset_id = b.dataset_id
        LEFT JOIN (SELECT dataset_id, silver_table FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_id ORDER BY event_ts DESC, event_no DESC) AS rn FROM v_dataset_events WHERE silver_table IS NOT NULL) t WHERE rn = 1) s ON d.dataset_id = s.dataset_id
        LEFT JOIN (SELECT dataset_id, gold_table FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_id ORDER BY event_ts DESC, event_no DESC) AS rn FROM v_dataset_events WHERE gold_table IS NOT NULL) t WHERE rn = 1) g ON d.dataset_id = g.dataset_id
        LEFT JOIN (SELECT dataset_id, name FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_id ORDER BY event_ts DESC, event_no DESC) AS rn FROM v_dataset_events WHERE name IS NOT NULL) t WHERE rn = 1) n ON d.dataset_id = n.dataset_id
        LEFT JOIN (SELECT dataset_id, domain FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_id ORDER BY event_ts DESC, event_no DESC) AS rn FROM v_dataset_events WHERE domain IS NOT NULL) t WHERE rn = 1) m ON d.dataset_id = m.dataset_id
        LEFT JOIN (SELECT dataset_id, source_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_id ORDER BY event_ts DESC, event_no DESC) AS rn FROM v_dataset_events WHERE source_type IS NOT NULL) t WHERE rn = 1) y ON d.dataset_id = y.dataset_id
        LEFT JOIN (SELECT dataset_id, is_active FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_id ORDER BY event_ts DESC, event_no DESC) AS rn FROM v_dataset_events WHERE is_active IS NOT NULL) t WHERE rn = 1) a ON d.dataset_id = a.dataset_id""",
    "v_silver_known": """
        SELECT _pipeline_run_id, _loaded_at, _row_number FROM v_bronze WHERE o_orderstatus = 'F'""",
    "v_messages": """
        SELECT event_id AS seq, CASE event_type
                 WHEN 'error' THEN concat('{"event_id":"', CAST(event_id AS STRING), '","topic":')
                 WHEN 'click' THEN concat('{"event_id":"e', CAST(event_id AS STRING), '","topic":"quality.events","dataset_id":null,"published_at":"2024-01-31","payload":{"dataset_id":"d', CAST(user_id AS STRING), '","pipeline_run_id":"r', CAST(event_id AS STRING), '","rows_ingested":', CAST(user_id AS STRING), '}}')
                 WHEN 'view' THEN concat('{"event_id":"e', CAST(event_id AS STRING), '","topic":"drift.events","dataset_id":null,"published_at":"2024-01-31","payload":{"rows_ingested":7}}')
                 ELSE concat('{"event_id":"e', CAST(event_id AS STRING), '","topic":"raw.data.events","dataset_id":"d', CAST(user_id AS STRING), '","published_at":"2024-01-31","payload":{"dataset_name":"Set-', CAST(user_id AS STRING), '","schema_version":3,"rows_ingested":', CAST(user_id AS STRING), ',"rows_rejected":1}}')
               END AS value
        FROM events""",
}
NAME = re.compile(r"\bv_\w+")


def _needed(sql: str) -> list[str]:
    """Views that ``sql`` reads, each after those it is built on."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in NAME.findall(text):
            if name in VIEWS and name not in out:
                visit(VIEWS[name])
                out.append(name)

    visit(sql)
    return out


def with_views(sql: str, base: dict[str, str] | None = None) -> str:
    """``sql`` with the derived views it reads (and given base definitions) in front."""
    parts = [f"{name} AS ({body})" for name, body in (base or {}).items()]
    parts += [f"{name} AS ({VIEWS[name]})" for name in _needed(sql)]
    sql = sql.strip()
    if not parts:
        return sql
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.upper().startswith(start):
            return f"{start}{', '.join(parts)}, {sql[len(start):]}"
    return f"WITH {', '.join(parts)} {sql}"


class Tables:
    """Given tables and derived views of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        text = " ".join([*(VIEWS[v] for v in _needed(name))])
        base = {
            t: f"SELECT * FROM parquet.`{self.folder}/{t}.parquet`" for t in BASE if re.search(rf"\b{t}\b", text)
        }
        return self.spark.sql(with_views(f"SELECT * FROM {name}", base))
