"""Append-only fact tables: schemas and writers for all layers.

A fact table is a Parquet folder.  Rows are only ever appended, and current state is
derived by query, so that a failed or repeated job leaves no half-changed row.  Each
table has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.functions.keys import JSON, row_text
from tablepulse.sources import registry
from tablepulse.sources.splits import FILE, ROW_NO

# Columns and types of the fact tables.
SCHEMAS = {
    "dataset_events": "id string, dataset_id string, event_ts timestamp_ntz, name string, description string, "
    "source_type string, domain string, bronze_table string, silver_table string, gold_table string, is_active boolean, "
    "status string",
    "schema_versions": "id string, dataset_id string, version int, schema_json string, fingerprint string, "
    "created_at timestamp_ntz, change_summary string",
    "pipeline_runs": "id string, dataset_id string, dag_id string, run_id string, status string, "
    "triggered_by string, rows_ingested bigint, rows_rejected bigint, started_at timestamp_ntz, "
    "completed_at timestamp_ntz, error_message string, event_ts timestamp_ntz",
    "pipeline_tasks": "id string, run_id string, task_name string, task_type string, status string, "
    "started_at timestamp_ntz, completed_at timestamp_ntz, duration_sec double, retry_count int",
    "outbox": "id string, topic string, key string, value string, published_at timestamp_ntz",
    "outbox_sent": "id string, sent_at timestamp_ntz",
    "quality_runs": "id string, dataset_id string, pipeline_run_id string, schema_version int, "
    "total_rows bigint, quality_score decimal(5,2), evaluated_at timestamp_ntz",
    "quality_metrics": "quality_run_id string, column_name string, metric_type string, "
    "metric_value decimal(15,6), threshold decimal(15,6), passed boolean, evaluated_at timestamp_ntz",
    "data_quality_metrics": "id string, dataset_id string, pipeline_run_id string, silver_table string, "
    "quality_score decimal(5,2), total_rows bigint, passed boolean, null_rate decimal(8,6), "
    "duplicate_rate decimal(8,6), type_mismatch_rate decimal(8,6), range_fail_rate decimal(8,6), "
    "freshness_hours decimal(10,2), raw_metrics string, evaluated_at timestamp_ntz",
    "drift_runs": "id string, dataset_id string, pipeline_run_id string, reference_window_start timestamp_ntz, "
    "reference_window_end timestamp_ntz, current_window_start timestamp_ntz, current_window_end timestamp_ntz, "
    "overall_drift_score decimal(5,4), drift_detected boolean, evaluated_at timestamp_ntz",
    "drift_metrics": "drift_run_id string, column_name string, drift_method string, "
    "statistic_value decimal(15,8), p_value decimal(15,8), psi_score decimal(10,6), drift_detected boolean, "
    "severity string, evaluated_at timestamp_ntz",
    "drift_summary": "id string, dataset_id string, pipeline_run_id string, silver_table string, "
    "reference_table string, drift_score decimal(5,4), drift_detected boolean, drift_severity string, "
    "drifted_columns int, total_columns int, drift_pct decimal(5,2), avg_psi decimal(10,6), "
    "avg_ks_stat decimal(10,6), raw_metrics string, evaluated_at timestamp_ntz",
    "cost_records": "id string, dataset_id string, pipeline_run_id string, warehouse_name string, "
    "query_type string, credits_used decimal(15,8), credits_usd decimal(15,4), bytes_scanned bigint, "
    "recorded_at timestamp_ntz",
    "cost_forecasts": "id string, dataset_id string, warehouse_name string, forecast_date date, "
    "predicted_credits decimal(15,4), lower_bound decimal(15,4), upper_bound decimal(15,4), "
    "model_used string, created_at timestamp_ntz",
    "cost_summary": "id string, dataset_id string, pipeline_run_id string, warehouse_name string, "
    "lookback_days int, total_credits decimal(15,8), total_usd decimal(15,4), daily_avg_credits decimal(15,8), "
    "cost_per_run decimal(15,8), storage_gb decimal(15,4), storage_cost_usd decimal(15,4), "
    "forecast_credits_30d decimal(15,4), forecast_usd_30d decimal(15,4), cost_score decimal(6,2), "
    "cost_severity string, pipeline_run_count bigint, evaluated_at timestamp_ntz",
    "heal_runs": "id string, dataset_id string, pipeline_run_id string, failure_type string, "
    "failure_reason string, failed_task string, healing_strategy string, recovery_status string, "
    "retry_count int, mttr_seconds decimal(15,4), failure_detected_at timestamp_ntz, created_at timestamp_ntz",
    "heal_actions": "id string, heal_run_id string, action_type string, action_detail string, "
    "success boolean, executed_at timestamp_ntz",
    "heal_summary": "id string, dataset_id string, pipeline_run_id string, failure_type string, "
    "failure_reason string, healing_strategy string, recovery_status string, retry_count int, "
    "mttr_seconds decimal(15,4), actions_taken int, actions_succeeded int, quarantined boolean, "
    "evaluated_at timestamp_ntz",
    "dataset_lineage": "id string, dataset_id string, pipeline_run_id string, event_at timestamp_ntz, "
    "source_layer string, target_layer string, source_table string, target_table string, rows_in bigint, "
    "rows_out bigint, rows_rejected bigint, transformation_type string, notes string",
}
# Audit columns of the layers.
BRONZE_AUDIT = "_ingestion_id string, _ingestion_ts timestamp_ntz, _source_file string, _pipeline_run_id string, _schema_version int"
SILVER_AUDIT = (
    "_row_key string, _pipeline_run_id string, _bronze_loaded_at timestamp_ntz, _source_file string, "
    "_schema_version int, _quality_score double, _is_quarantined boolean, _silver_loaded_at timestamp_ntz"
)
GOLD_AUDIT = (
    "_pipeline_run_id string, _aggregation_key string, _row_count bigint, _quality_score_avg double, "
    "_aggregation_date date, _gold_loaded_at timestamp_ntz"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def bronze_schema(columns: T.StructType) -> T.StructType:
    return T.StructType([*struct(BRONZE_AUDIT).fields, *columns.fields])


def silver_schema(columns: T.StructType) -> T.StructType:
    return T.StructType([*struct(SILVER_AUDIT).fields, *columns.fields])


def gold_schema(columns: T.StructType) -> T.StructType:
    """Audit columns and the sum and mean of each numeric column."""
    numeric = [f.name for f in columns.fields if isinstance(f.dataType, T.NumericType)]
    measures = [T.StructField(f"{n}_{m}", T.DoubleType()) for n in numeric for m in ("sum", "avg")]
    return T.StructType([*struct(GOLD_AUDIT).fields, *measures])


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table by its declared schema; a table not yet written is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class FactStore:
    """Fact tables below one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        return read_table(self.spark, self.path(table), struct(SCHEMAS[table]))

    def report(self, table: str) -> DataFrame:
        """A fact table with the columns that the reports read.

        Runs are in their current state, one row each; usage records carry a date and a price.
        """
        rows = self.read(table)
        if table == "pipeline_runs":
            return registry.current_runs(rows, "id")
        if table == "cost_records":
            return rows.withColumns(
                {
                    "usage_date": F.col("recorded_at").cast("date"),
                    "service_type": F.lit("COMPUTE"),
                    "cost_usd": F.col("credits_usd"),
                    "created_at": F.col("recorded_at"),
                }
            )
        return rows

    def append(self, table: str, rows: DataFrame) -> None:
        as_fact(table, rows).write.mode("append").parquet(self.path(table))

    def append_new(self, table: str, rows: DataFrame, key: str = "id") -> None:
        """Append the rows whose key the table does not hold yet, so a repeated job adds nothing.

        A row without key gets a digest of its content as key.  Of the history only the keys
        that are new here are looked up, which a Bloom filter of them can prune.  Neither side is
        broadcast, as a batch may hold any number of keys.
        """
        content = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), JSON), 256)
        rows = rows.withColumn(key, F.coalesce(F.col(key).cast("string"), content))
        rows = as_fact(table, rows).dropDuplicates([key])
        known = self.read(table).select(key).join(rows.select(key).hint("merge"), key, "left_semi")
        self.append(table, rows.join(known.hint("merge"), key, "left_anti"))


def as_fact(table: str, rows: DataFrame) -> DataFrame:
    """Rows in the declared columns and types of a fact table.

    Missing columns become NULL, numbers are rounded to the declared scale.
    """
    out = []
    for field in struct(SCHEMAS[table]).fields:
        if field.name not in rows.columns:
            column: Column = F.lit(None)
        elif isinstance(field.dataType, T.DecimalType):
            column = F.round(F.col(field.name), field.dataType.scale)
        else:
            column = F.col(field.name)
        out.append(column.cast(field.dataType).alias(field.name))
    return rows.select(*out)


def run_id(*parts: Column) -> Column:
    """Id that a repeated job builds again from the same parts."""
    return F.md5(F.concat_ws("|", *parts))


def quality_facts(scored: DataFrame, metrics: DataFrame, context: Mapping[str, Column]) -> dict[str, DataFrame]:
    """Run header, column metrics and flat summary of a quality result.

    ``context`` gives ``id``, ``dataset_id``, ``pipeline_run_id``, ``silver_table``,
    ``schema_version`` and ``evaluated_at``.
    """
    rows = scored.withColumns(dict(context))
    raw = F.to_json(F.struct(*[c for c in scored.columns if c not in context]))
    return {
        "quality_runs": as_fact("quality_runs", rows),
        "quality_metrics": as_fact(
            "quality_metrics",
            metrics.withColumns({"quality_run_id": context["id"], "evaluated_at": context["evaluated_at"]}),
        ),
        "data_quality_metrics": as_fact("data_quality_metrics", rows.withColumn("raw_metrics", raw)),
    }


def drift_facts(summary: DataFrame, metrics: DataFrame, context: Mapping[str, Column]) -> dict[str, DataFrame]:
    """Run header, column metrics and flat summary of a comparison.

    ``context`` also gives the four window limits, where the windows have times.
    """
    rows = summary.withColumns(dict(context))
    raw = F.to_json(F.struct(*[c for c in summary.columns if c not in context]))
    return {
        "drift_runs": as_fact("drift_runs", rows.withColumn("overall_drift_score", F.col("drift_score"))),
        "drift_metrics": as_fact(
            "drift_metrics",
            metrics.withColumns({"drift_run_id": context["id"], "evaluated_at": context["evaluated_at"]}),
        ),
        "drift_summary": as_fact("drift_summary", rows.withColumn("raw_metrics", raw)),
    }


def cost_facts(measured: DataFrame, forecasts: DataFrame, context: Mapping[str, Column]) -> dict[str, DataFrame]:
    rows = measured.withColumns(dict(context))
    at = context["evaluated_at"]
    record = {
        "query_type": F.lit("PIPELINE_RUN"),
        "credits_used": F.col("total_credits"),
        "credits_usd": F.col("total_usd"),
        "recorded_at": at,
    }
    # The records come last: they may be the usage that the measures were taken from.
    return {
        "cost_forecasts": as_fact("cost_forecasts", forecasts.withColumns({**context, "created_at": at})),
        "cost_summary": as_fact("cost_summary", rows),
        "cost_records": as_fact("cost_records", rows.withColumns(record)),
    }


def heal_facts(summary: DataFrame, action_rows: DataFrame, at: Column) -> dict[str, DataFrame]:
    """Run header, actions and flat summary of healed events; ids follow the event ids."""
    rows = summary.withColumn("id", F.col("event_id"))
    found = F.coalesce("detected_at", at) if "detected_at" in rows.columns else at
    return {
        "heal_runs": as_fact("heal_runs", rows.withColumns({"failure_detected_at": found, "created_at": at})),
        "heal_actions": as_fact(
            "heal_actions",
            action_rows.withColumns(
                {
                    "id": run_id(F.col("event_id"), F.col("action_no").cast("string")),
                    "heal_run_id": F.col("event_id"),
                    "executed_at": at,
                }
            ),
        ),
        "heal_summary": as_fact("heal_summary", rows.withColumn("evaluated_at", at)),
    }


def bronze_rows(df: DataFrame, source_file: str, pipeline_run_id: str, schema_version: int, at: Column) -> DataFrame:
    """Data rows with Bronze audit columns; NaN becomes NULL.

    The ingestion id follows from run, place in the file and content, so a repeated load of
    the same file builds the same ids, and equal rows keep ids of their own.  The place is that of
    the columns ``_file`` and ``_row_no``, which do not depend on how files are split; rows without them are
    numbered as Spark deals them out.
    """
    data, audit = [], [c for c in (FILE, ROW_NO) if c in df.columns]
    columns = [c for c in df.columns if c not in audit]
    for name in columns:
        column = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            column = F.when(~F.isnan(column), column)
        data.append(column.alias(name))
    place = [F.col(c).cast("string") for c in audit] or [F.monotonically_increasing_id().cast("string")]
    return df.select(
        F.sha2(F.concat_ws("|", F.lit(pipeline_run_id), *place, row_text(df, columns)), 256).alias("_ingestion_id"),
        at.cast("timestamp_ntz").alias("_ingestion_ts"),
        F.lit(source_file).alias("_source_file"),
        F.lit(pipeline_run_id).alias("_pipeline_run_id"),
        F.lit(schema_version).alias("_schema_version"),
        *data,
    )
