"""Bronze to Silver to Gold, row counts per run and lineage rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.functions.keys import row_text
from tablepulse.operators.relational import data_columns, equals_if_given, newest, rows_not_in


def bronze_key(bronze: DataFrame) -> Column:
    """Key of a Bronze row over all runs, never NULL.

    Run with load time and row number where the table has both, else with the ingestion id.
    Rows in which one of them is NULL, and tables without them, are told apart by the content
    of all data columns as well.
    """
    placed = ["_loaded_at", "_row_number"]
    given = placed if set(placed) <= set(bronze.columns) else [c for c in ["_ingestion_id"] if c in bronze.columns]
    names = ["_pipeline_run_id", *given]
    by_content = F.sha2(row_text(bronze, [*names, *data_columns(bronze)]), 256)
    if not given:
        return by_content
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in given])
    return F.when(complete, F.sha2(row_text(bronze, names), 256)).otherwise(by_content)


def all_null(columns: list[str]) -> Column:
    """True where every given column is NULL."""
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNull() for c in columns], F.lit(True))


def to_silver(bronze: DataFrame, schema_version: int = 1) -> DataFrame:
    """Silver rows of Bronze rows: data columns plus key, audit and quarantine columns.

    A row without load time, or with nothing but NULLs, is flagged and kept.
    """
    columns = data_columns(bronze)
    loaded = next((c for c in ("_loaded_at", "_ingestion_ts") if c in bronze.columns), None)
    loaded_at = F.col(loaded) if loaded else F.lit(None).cast("timestamp_ntz")
    source = F.col("_source_file") if "_source_file" in bronze.columns else F.lit(None).cast("string")
    return bronze.select(
        bronze_key(bronze).alias("_row_key"),
        F.col("_pipeline_run_id"),
        loaded_at.alias("_bronze_loaded_at"),
        source.alias("_source_file"),
        F.lit(schema_version).alias("_schema_version"),
        F.lit(1.0).alias("_quality_score"),
        (loaded_at.isNull() | all_null(columns)).alias("_is_quarantined"),
        *[F.col(f"`{c}`") for c in columns],
    )


def silver_additions(
    bronze: DataFrame, silver: DataFrame, run_id: str | None = None, schema_version: int = 1, mode: str = "row"
) -> DataFrame:
    """Rows that Silver still lacks.

    ``row`` compares row keys, and equal keys count as one row; ``run_once`` skips
    every run of which Silver already holds a row.  The row key is one column
    without NULL; rows are shuffled by it once, for the comparison and for finding
    equal keys.
    """
    rows = to_silver(equals_if_given(bronze, run_id, "_pipeline_run_id"), schema_version)
    known = equals_if_given(silver, run_id, "_pipeline_run_id")
    if mode == "run_once":
        # Known runs are few next to the rows: only they are looked up, the rows stay where they are.
        runs = bronze.select("_pipeline_run_id").distinct().join(known.select("_pipeline_run_id").distinct(), "_pipeline_run_id")
        return rows_not_in(rows, runs, ["_pipeline_run_id"], few=True)
    placed = rows.repartition("_row_key")
    return placed.join(known.select("_row_key").hint("merge"), "_row_key", "left_anti").dropDuplicates(["_row_key"])


def to_gold(
    silver: DataFrame, key: str | None = None, run_id: str | None = None, numeric: bool = True,
    columns: list[str] | None = None,
) -> DataFrame:
    """Row count, mean quality and numeric roll-ups per run and key, without quarantined rows."""
    rows = equals_if_given(silver, run_id, "_pipeline_run_id").filter(~F.col("_is_quarantined"))
    aggregation_key = F.coalesce(F.col(key or "_pipeline_run_id").cast("string"), F.lit("unknown"))
    measures = [
        F.count(F.lit(1)).alias("_row_count"),
        F.avg(F.coalesce("_quality_score", F.lit(1.0))).alias("_quality_score_avg"),
    ]
    if numeric:
        measures += gold_measures(silver, columns)
    return rows.groupBy("_pipeline_run_id", aggregation_key.alias("_aggregation_key")).agg(*measures)


def gold_measures(silver: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Sum and mean of the numeric data columns, or of those named; whole numbers are summed without overflow."""
    numeric = [f for f in silver.schema.fields if isinstance(f.dataType, T.NumericType) and not f.name.startswith("_")]
    out = []
    for field in [f for f in numeric if columns is None or f.name in columns]:
        column = F.col(f"`{field.name}`")
        summand = column.cast("decimal(28,0)") if isinstance(field.dataType, T.IntegralType) else column
        out += [F.sum(summand).alias(f"{field.name}_sum"), F.avg(column).alias(f"{field.name}_avg")]
    return out


def run_counts(silver: DataFrame) -> DataFrame:
    """Merged and quarantined rows per run in one pass."""
    return silver.groupBy("_pipeline_run_id").agg(
        F.count(F.lit(1)).alias("rows_merged"), F.count_if(F.col("_is_quarantined")).alias("rows_quarantined")
    )


def gold_counts(gold: DataFrame) -> DataFrame:
    return gold.groupBy("_pipeline_run_id").agg(F.count(F.lit(1)).alias("gold_rows"))


def lineage_rows(
    counts: DataFrame,
    source_layer: str,
    target_layer: str,
    source_table: str,
    target_table: str,
    transformation: str = "copy",
) -> DataFrame:
    """Lineage rows from ``(dataset_id, pipeline_run_id, event_at, rows_in, rows_rejected[, rows_out])``."""
    rows_out = F.col("rows_out") if "rows_out" in counts.columns else F.col("rows_in") - F.col("rows_rejected")
    return counts.select(
        "dataset_id",
        "pipeline_run_id",
        "event_at",
        F.upper(F.lit(source_layer)).alias("source_layer"),
        F.upper(F.lit(target_layer)).alias("target_layer"),
        F.lit(source_table).alias("source_table"),
        F.lit(target_table).alias("target_table"),
        "rows_in",
        rows_out.alias("rows_out"),
        "rows_rejected",
        F.lit(transformation).alias("transformation_type"),
    )


def lineage_history(lineage: DataFrame, dataset_id: str | None, limit: int = 50, ties: tuple[str, ...] = ()) -> DataFrame:
    return newest(equals_if_given(lineage, dataset_id, "dataset_id"), limit, "event_at", *ties)
