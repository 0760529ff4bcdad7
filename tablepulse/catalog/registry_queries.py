"""Registry state from events: data sets from orders per customer, schemas from nations, runs from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepulse.catalog import query
from tablepulse.catalog.tables import ORDERS_END
from tablepulse.sources import registry

FIELDS = ["dataset_id", "name", "source_type", "domain", "bronze_table", "silver_table", "gold_table", "is_active", "created_at", "updated_at"]
LIST = ", ".join(FIELDS)


def _datasets(t):
    return registry.current_datasets(t["v_dataset_events"], "event_no").select(*FIELDS)


@query("reg_01_registrations", f"""
    SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, TIMESTAMP '{ORDERS_END}' AS event_ts, c_name AS name, lower(c_mktsegment) AS domain, TRUE AS is_active FROM customer""")
def _(t):
    rows = t["customer"].withColumn("dataset_id", F.col("c_custkey").cast("string"))
    events = registry.dataset_events(
        rows, F.lit(ORDERS_END).cast("timestamp_ntz"), name=F.col("c_name"), domain=F.lower("c_mktsegment"), is_active=F.lit(True)
    )
    return events.select("dataset_id", "event_ts", "name", "domain", "is_active")


@query("reg_02_latest_values", f"SELECT {LIST} FROM v_datasets")
def _(t):
    return _datasets(t)


@query("reg_03_find_by_id", f"SELECT {LIST} FROM v_datasets WHERE is_active AND dataset_id = '10'")
def _(t):
    return registry.find_dataset(_datasets(t), dataset_id="10")


@query("reg_03_find_by_name", f"SELECT {LIST} FROM v_datasets WHERE is_active AND name = 'customer_14'")
def _(t):
    return registry.find_dataset(_datasets(t), name="customer_14")


@query("reg_04_page", f"""
    SELECT {LIST} FROM v_datasets WHERE is_active AND lower(domain) = '2-high' AND lower(source_type) = 'csv'
    ORDER BY created_at DESC, dataset_id LIMIT 30 OFFSET 5""")
def _(t):
    return registry.page_of_datasets(_datasets(t), 30, 5, domain="2-HIGH", source_type="CSV")


@query("reg_05_count", "SELECT COUNT(*) AS cnt FROM v_datasets WHERE is_active")
def _(t):
    return registry.count_datasets(_datasets(t))


@query("reg_06_current_flags", """
    SELECT dataset_id, version, schema_json, version = MAX(version) OVER (PARTITION BY dataset_id) AS is_current FROM v_schema_versions""")
def _(t):
    return registry.with_current_flag(t["v_schema_versions"])


@query("reg_06_next_versions", """
    SELECT v.dataset_id, '[]' AS schema_json, CAST(MAX(v.version) + 1 AS INT) AS version FROM v_schema_versions v GROUP BY v.dataset_id
    UNION ALL SELECT 'new', '[]', 1""")
def _(t):
    versions = t["v_schema_versions"]
    known = versions.select("dataset_id").distinct()
    new = versions.select(F.lit("new").alias("dataset_id")).distinct()
    return registry.next_versions(versions, known.union(new).withColumn("schema_json", F.lit("[]")))


@query("reg_07_current_versions", """
    SELECT dataset_id, MAX(version) AS version, arg_max(schema_json, version) AS schema_json FROM v_schema_versions GROUP BY dataset_id""")
def _(t):
    return registry.current_versions(t["v_schema_versions"])


@query("reg_08_version_counts", "SELECT dataset_id, COUNT(*) AS cnt FROM v_schema_versions GROUP BY dataset_id")
def _(t):
    return registry.version_counts(t["v_schema_versions"])


def _run_events(t):
    runs = t["v_runs"]
    opened = registry.open_runs(runs.select("run_id", "dataset_id", "dag_id", F.col("started_at").alias("at")), F.col("at"))
    closed = registry.close_runs(
        runs.filter(F.col("completed_at").isNotNull()).select(
            "run_id", "rows_ingested", "rows_rejected", F.col("status").alias("outcome"), F.greatest("completed_at", F.expr("started_at + INTERVAL 1 SECOND")).alias("at")
        ),
        F.col("at"),
        F.col("outcome"),
    )
    return opened, closed


@query("reg_09_open_runs", """
    SELECT run_id, dataset_id, dag_id, 'running' AS status, 'api' AS triggered_by, started_at FROM v_runs""")
def _(t):
    opened, _ = _run_events(t)
    return opened.select("run_id", "dataset_id", "dag_id", "status", "triggered_by", "started_at")


@query("reg_10_current_runs", """
    SELECT id, run_id, dataset_id, dag_id, CASE WHEN completed_at IS NULL THEN 'running' ELSE status END AS status, started_at,
           CASE WHEN completed_at IS NULL THEN NULL ELSE rows_ingested END AS rows_ingested,
           CASE WHEN completed_at IS NULL THEN NULL ELSE rows_rejected END AS rows_rejected FROM v_runs""")
def _(t):
    opened, closed = _run_events(t)
    runs = registry.current_runs(opened.unionByName(closed, allowMissingColumns=True))
    return runs.select(F.concat(F.lit(""), F.regexp_replace("id", "^run_", "")).alias("id"), "run_id", "dataset_id", "dag_id", "status", "started_at", "rows_ingested", "rows_rejected")


@query("reg_11_dataset_details", f"""
    WITH c AS (SELECT dataset_id, MAX(version) AS version, arg_max(schema_json, version) AS doc, COUNT(*) AS n FROM v_schema_versions GROUP BY dataset_id)
    SELECT d.dataset_id, d.name, c.version, json_extract_string(doc, '$[0].name') AS first_column, json_extract_string(doc, '$[1].name') AS second_column,
           COALESCE(c.n, 0) AS schema_version_count FROM v_datasets d LEFT JOIN c ON d.dataset_id = c.dataset_id WHERE d.is_active""")
def _(t):
    details = registry.dataset_details(_datasets(t), t["v_schema_versions"])
    return details.select(
        "dataset_id", "name", "version", F.get("schema.name", F.lit(0)).alias("first_column"),
        F.get("schema.name", F.lit(1)).alias("second_column"), "schema_version_count",
    )
