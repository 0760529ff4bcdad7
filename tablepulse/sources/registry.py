"""Data set, schema version and run registries as event tables.

Events are appended, the current state of an entry is the latest non-NULL value of
each field, so an event only names the fields it changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepulse.operators.schema import parse_schema

DATASET_FIELDS = [
    "name", "description", "source_type", "domain", "bronze_table", "silver_table", "gold_table", "is_active", "status",
]
RUN_FIELDS = [
    "dataset_id", "dag_id", "status", "rows_ingested", "rows_rejected", "started_at", "completed_at", "error_message",
]


def latest_values(
    events: DataFrame, key: str, fields: Sequence[str], order: Sequence[str], *more: Column
) -> DataFrame:
    """Latest non-NULL value of each field per key, plus further aggregates."""
    known = [f for f in fields if f in events.columns]

    def latest(field: str) -> Column:
        return F.max_by(field, F.when(F.col(field).isNotNull(), F.struct(*order))).alias(field)

    return events.groupBy(key).agg(*[latest(f) for f in known], *more)


def dataset_events(rows: DataFrame, at: Column, **fields: Column) -> DataFrame:
    """Registration (or update) events for the keys in ``rows``; other fields stay NULL."""
    kinds = {"is_active": "boolean"}
    return rows.select(
        "dataset_id",
        at.alias("event_ts"),
        *[fields.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in DATASET_FIELDS],
    )


def current_datasets(events: DataFrame, *ties: str) -> DataFrame:
    """Current state of each data set with its first and last event time."""
    times = [F.min("event_ts").alias("created_at"), F.max("event_ts").alias("updated_at")]
    return latest_values(events, "dataset_id", DATASET_FIELDS, ["event_ts", *ties], *times)


def active_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.filter(F.col("is_active"))


def find_dataset(datasets: DataFrame, dataset_id: str | None = None, name: str | None = None) -> DataFrame:
    """Active data set by id or by name."""
    rows = active_datasets(datasets)
    if dataset_id is not None:
        rows = rows.filter(F.col("dataset_id") == dataset_id)
    if name is not None:
        rows = rows.filter(F.col("name") == name)
    return rows


def page_of_datasets(
    datasets: DataFrame, limit: int = 100, offset: int = 0, domain: str | None = None, source_type: str | None = None
) -> DataFrame:
    """One page of the active data sets, newest first.  Filters apply before paging."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must lie in 1..500 and offset must not be negative")
    rows = active_datasets(datasets)
    for column, value in (("domain", domain), ("source_type", source_type)):
        if value is not None:
            rows = rows.filter(F.lower(column) == value.lower())
    return rows.orderBy(F.desc("created_at"), "dataset_id").offset(offset).limit(limit)


def count_datasets(datasets: DataFrame) -> DataFrame:
    return active_datasets(datasets).agg(F.count(F.lit(1)).alias("cnt"))


def with_current_flag(versions: DataFrame) -> DataFrame:
    """Schema versions with ``is_current``: the highest version of a data set."""
    newest = F.max("version").over(Window.partitionBy("dataset_id"))
    return versions.withColumn("is_current", F.col("version") == newest)


def current_versions(versions: DataFrame) -> DataFrame:
    """Row of the highest version per data set."""
    rest = [c for c in versions.columns if c != "dataset_id"]
    return (
        versions.groupBy("dataset_id").agg(F.max_by(F.struct(*rest), "version").alias("row")).select("dataset_id", "row.*")
    )


def version_counts(versions: DataFrame) -> DataFrame:
    return versions.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("cnt"))


def next_versions(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """New version rows: the next number of each data set in ``documents``, from 1."""
    newest = versions.groupBy("dataset_id").agg(F.max("version").alias("_newest"))
    return (
        documents.join(newest, "dataset_id", "left")
        .withColumn("version", (F.coalesce("_newest", F.lit(0)) + 1).cast("int"))
        .drop("_newest")
    )


def current_runs(events: DataFrame, *ties: str) -> DataFrame:
    """Current state per run; a run opens as ``running`` and closes with a later event.

    Of events of one moment the one that completes the run counts, then ``ties``.
    """
    closes = "completed_at" in events.columns
    order = ["event_ts", *(["_closes"] if closes else []), *ties]
    rows = events.withColumn("_closes", F.col("completed_at").isNotNull()) if closes else events
    return latest_values(rows, "run_id", RUN_FIELDS, order).withColumn("id", F.col("run_id"))


def open_runs(rows: DataFrame, at: Column, triggered_by: str = "api") -> DataFrame:
    return rows.withColumns(
        {"status": F.lit("running"), "triggered_by": F.lit(triggered_by), "started_at": at, "event_ts": at}
    )


def close_runs(rows: DataFrame, at: Column, status: Column) -> DataFrame:
    """Closing events; ``rows`` carries run id, row counts and error message."""
    return rows.withColumns({"status": status, "completed_at": at, "event_ts": at})


def dataset_details(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """Active data sets with the columns of their current schema and their version count."""
    schemas = versions.groupBy("dataset_id").agg(
        F.max("version").alias("version"),
        F.max_by("schema_json", "version").alias("schema_json"),
        F.count(F.lit(1)).alias("schema_version_count"),
    )
    return (
        active_datasets(datasets)
        .join(schemas, "dataset_id", "left")
        .withColumn("schema", parse_schema(F.col("schema_json")))
        .withColumn("schema_version_count", F.coalesce("schema_version_count", F.lit(0)))
        .drop("schema_json")
    )
