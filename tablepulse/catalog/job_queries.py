"""Files, sinks and whole jobs; each run writes below a new shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.catalog import query
from tablepulse.catalog.drift_queries import ALL, COLUMNS, SEVERITY, SUMMARY
from tablepulse.catalog.healing_queries import ACTIONS, DECIDED
from tablepulse.catalog.quality_queries import DUPLICATES, METRICS, RATES, SCORED
from tablepulse.catalog.tables import EVENTS_END, LINES_SPLIT, ORDERS_END
from tablepulse.operators import drift, healing
from tablepulse.plans import jobs
from tablepulse.session import shared_folder
from tablepulse.sources.facts import FactStore
from tablepulse.sources.files import read_file
from tablepulse.sources.tables import first_existing

AT = "2002-01-01 00:00:00"


def _doubles(df):
    """Decimals as doubles, for the comparison."""
    return df.select(
        *[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema.fields]
    )


def _store(t):
    return FactStore(t.spark, shared_folder(t.spark))


@query("src_01_csv_file", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = f"{shared_folder(t.spark)}/customer.csv"
    t["customer"].toDF("C Custkey", "C-Name", "c_nationkey", "C  AcctBal", "C Mktsegment ").write.csv(path, header=True)
    rows = read_file(t.spark, path)
    return rows.withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query("src_02_json_lines", "SELECT event_id, user_id, event_type, value FROM v_events_dirty")
def _(t):
    path = f"{shared_folder(t.spark)}/events.jsonl"
    t["v_events_dirty"].select("event_id", "user_id", "event_type", "value").write.json(path)
    return read_file(t.spark, path).select("event_id", "user_id", "event_type", "value")


@query("src_07_usage_sources", f"""
    SELECT warehouse_name, COUNT(*) AS n FROM v_usage GROUP BY warehouse_name""")
def _(t):
    path = f"{shared_folder(t.spark)}/usage"
    t["v_usage"].write.parquet(path)
    schema = "warehouse_name string, start_time timestamp_ntz, credits_used double, bytes_scanned bigint"
    usage = first_existing(t.spark, ["missing_usage_table", path], schema, [None, None, 0.0, 0])
    return usage.groupBy("warehouse_name").agg(F.count("*").alias("n"))


def _ingest(t, store):
    path = f"{store.root}/upload/orders.csv"
    t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").write.csv(path, header=True)
    columns = T.StructType.fromDDL("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double")
    return columns, jobs.ingest_file(store, path, "Daily Orders", AT, file_schema=columns)


@query("sch_09_ingest", """
    SELECT md5('dataset|Daily Orders') AS dataset_id, 'daily_orders_raw' AS bronze_table, TRUE AS is_new_dataset, 1 AS schema_version,
        (SELECT COUNT(*) FROM orders) AS rows_ingested,
        left(sha256('[{"name": "o_custkey", "type": "NUMBER(18,0)"}, {"name": "o_orderkey", "type": "NUMBER(18,0)"}, {"name": "o_orderstatus", "type": "VARCHAR(65535)"}, {"name": "o_totalprice", "type": "FLOAT"}]'), 16) AS schema_fingerprint""")
def _(t):
    _, upload = _ingest(t, _store(t))
    return upload.select(
        "dataset_id", "bronze_table", "is_new_dataset", "schema_version", F.col("rows_ingested").cast("bigint").alias("rows_ingested"), "schema_fingerprint"
    )


@query("lin_03_layer_jobs", """
    SELECT 'BRONZE' AS source_layer, 'SILVER' AS target_layer, 'daily_orders_raw' AS source_table, 'daily_orders_silver' AS target_table,
        COUNT(*) AS rows_in, COUNT(*) AS rows_out, CAST(0 AS BIGINT) AS rows_rejected FROM orders
    UNION ALL SELECT 'SILVER', 'GOLD', 'daily_orders_silver', 'daily_orders_gold', COUNT(*), COUNT(DISTINCT o_orderstatus), 0 FROM orders""")
def _(t):
    """Ingest, both layer steps, and both again, which must add nothing."""
    store = _store(t)
    columns, upload = _ingest(t, store)
    row = upload.select("dataset_id", "pipeline_run_id").first()
    for _ in range(2):
        jobs.bronze_to_silver(store, row["dataset_id"], "daily_orders_raw", columns, row["pipeline_run_id"], AT)
        jobs.silver_to_gold(
            store, row["dataset_id"], "daily_orders_silver", columns, row["pipeline_run_id"], AT, key="o_orderstatus"
        )
    return store.read("dataset_lineage").select(
        "source_layer", "target_layer", "source_table", "target_table", "rows_in", "rows_out", "rows_rejected"
    )


# No types are registered here, so that every column passes the type test.
UNTYPED = METRICS.replace("FALSE AS type_ok", "TRUE AS type_ok")


@query("snk_06_quality_facts", f"""
    WITH {UNTYPED}, {DUPLICATES}, {RATES}, {SCORED}
    SELECT 'events' AS dataset_id, 'events_silver' AS silver_table, quality_score, total_rows, quality_score >= 80 AS passed, null_rate, duplicate_rate,
        type_mismatch_rate, range_fail_rate, freshness_hours, (SELECT COUNT(*) * 2 FROM m) AS metric_rows FROM s""")
def _(t):
    store = _store(t)
    rows = t["v_events_dirty"].withColumn("_silver_loaded_at", F.col("ts"))
    jobs.quality_job(store, rows, "events", "run_1", "events_silver", EVENTS_END)
    jobs.quality_job(store, rows, "events", "run_1", "events_silver", EVENTS_END)
    metrics = store.read("quality_metrics").agg(F.count("*").alias("n"))
    facts = _doubles(store.read("data_quality_metrics"))
    return facts.drop("id", "pipeline_run_id", "raw_metrics", "evaluated_at").withColumn("metric_rows", metrics.scalar())


@query("snk_07_drift_facts", f"""
    WITH RECURSIVE {ALL}, {SUMMARY}
    SELECT 'lines' AS dataset_id, drift_score, drift_pct > 0 AS drift_detected, {SEVERITY} AS drift_severity, CAST(drifted_columns AS INT) AS drifted_columns,
        CAST(total_columns AS INT) AS total_columns, drift_pct, avg_psi, avg_ks_stat, total_columns AS metric_rows FROM s""")
def _(t):
    store = _store(t)
    sides = drift.split_by_time(t["lineitem"], "l_shipdate", LINES_SPLIT)
    jobs.drift_job(store, sides, "lines", "run_1", "lines_silver", ORDERS_END, columns=COLUMNS)
    metrics = store.read("drift_metrics").agg(F.count("*").alias("n"))
    facts = _doubles(store.read("drift_summary")).withColumn("metric_rows", metrics.scalar())
    return facts.select(
        "dataset_id", "drift_score", "drift_detected", "drift_severity", "drifted_columns", "total_columns", "drift_pct", "avg_psi", "avg_ks_stat", "metric_rows"
    )


@query("snk_09_heal_facts", f"""
    WITH {ACTIONS}
    SELECT de.event_id AS id, failure_type, recovery_status, quarantined, CAST(COUNT(*) AS BIGINT) AS action_rows
    FROM de JOIN ac ON de.event_id = ac.event_id GROUP BY ALL""")
def _(t):
    store = _store(t)
    for _ in range(2):
        jobs.heal_job(store, t["v_failures"], EVENTS_END)
    actions = store.read("heal_actions").groupBy(F.col("heal_run_id").alias("id")).agg(F.count("*").alias("action_rows"))
    return store.read("heal_summary").join(actions, "id").select("id", "failure_type", "recovery_status", "quarantined", "action_rows")


@query("ext_03_result_rows", f"""
    WITH {DECIDED}
    SELECT 'self_healing_agent' AS agent, CASE WHEN recovery_status = 'ESCALATED' THEN 'escalated' ELSE 'resolved' END AS status,
        CASE WHEN recovery_status = 'ESCALATED' THEN 'high' ELSE 'low' END AS severity, healing_strategy AS action, event_id FROM de""")
def _(t):
    results = jobs.heal_job(_store(t), t["v_failures"], EVENTS_END)
    return results.select(
        "agent", "status", "severity", F.get("actions_taken", F.lit(0)).alias("action"), F.get_json_object("details", "$.event_id").alias("event_id")
    )
