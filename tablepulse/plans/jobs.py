"""Whole jobs: ingest, layer transitions, quality, drift, cost and healing runs.

A job reads and writes tables below one :class:`FactStore`.  Its ids follow from its
parameters, so running it again after a failure adds nothing twice.  The driver only
sees scalars and the one result row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.config import HIGH, CostConfig, DriftConfig, HealConfig, QualityConfig
from tablepulse.functions.scores import quality_severity
from tablepulse.functions.times import moment
from tablepulse.operators import cost, drift, healing, medallion, quality, schema
from tablepulse.operators.relational import rows_not_in
from tablepulse.sources import registry
from tablepulse.sources.envelopes import wrap
from tablepulse.sources.facts import (
    FactStore,
    bronze_rows,
    bronze_schema,
    cost_facts,
    drift_facts,
    gold_schema,
    heal_facts,
    quality_facts,
    read_table,
    run_id,
    silver_schema,
)
from tablepulse.sources.files import read_file, source_type, split_rejects
from tablepulse.sources.splits import FILE, ROW_NO


def stable_id(*parts: str) -> str:
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def _one(store: FactStore, **fields: object) -> DataFrame:
    """One row of literals."""
    return store.spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()])


def _held(store: FactStore, rows: DataFrame) -> DataFrame:
    """Schema metadata, one row per column of a table, as a fixed frame."""
    return store.spark.createDataFrame(rows.collect(), rows.schema)


def result_row(rows: DataFrame, agent: str, status: Column, severity: Column, actions: Column) -> DataFrame:
    """Job result with the source row as JSON details."""
    return rows.select(
        F.lit(agent).alias("agent"),
        status.alias("status"),
        severity.alias("severity"),
        actions.alias("actions_taken"),
        F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("details"),
    )


def _skipped(store: FactStore, agent: str, severity: str, reason: str) -> DataFrame:
    return _one(
        store, agent=agent, status="skipped", severity=severity, actions_taken=[f"skipped: {reason}"], details="{}"
    )


# --- ingest ------------------------------------------------------------------

def layer_path(store: FactStore, layer: str, table: str, version: int) -> str:
    """Folder of one schema version of a layer table."""
    return f"{store.root}/{layer}/{table}/v{version}"


def all_versions(store: FactStore, layer: str, table: str, dataset_id: str) -> DataFrame:
    """One table over all schema versions of a data set.

    Columns that a version lacks are NULL there; a column stored in different types is text.
    The versions, which are few, are looked up in the registry.
    """
    known = store.read("schema_versions").filter(F.col("dataset_id") == dataset_id)
    parts = []
    for row in known.select("version").distinct().orderBy("version").collect():
        try:
            parts.append(store.spark.read.parquet(layer_path(store, layer, table, row["version"])))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if not parts:
        raise ValueError(f"{layer} table {table} was never written")
    kinds: dict[str, set] = {}
    for part in parts:
        for field in part.schema.fields:
            kinds.setdefault(field.name, set()).add(field.dataType.simpleString())
    mixed = {name for name, found in kinds.items() if len(found) > 1}
    parts = [p.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in mixed else F.col(f"`{c}`") for c in p.columns]) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def register_dataset(store: FactStore, dataset_id: str, at: str, **fields: object) -> None:
    """Append a registry event that sets some fields of a data set; a known event adds nothing."""
    event_id = stable_id("dataset_event", dataset_id, at, *(f"{k}={v}" for k, v in sorted(fields.items())))
    event = _one(store, id=event_id, dataset_id=dataset_id, **fields).withColumn("event_ts", moment(at))
    store.append_new("dataset_events", event)


def datasets(store: FactStore) -> DataFrame:
    """Current state of all data sets."""
    return registry.current_datasets(store.read("dataset_events"), "id")


def ingest_file(
    store: FactStore,
    path: str,
    dataset: str,
    at: str,
    description: str = "",
    domain: str = "",
    file_schema: T.StructType | None = None,
    keep_rejects: bool = False,
) -> DataFrame:
    """Load a file into Bronze: infer, diff and register its schema, append rows, log the run, announce it.

    The text is scanned for the places of its records and then parsed once into a landing table;
    types, schema and rows are taken from there.  A malformed record fails the upload, or goes
    to the quarantine with ``keep_rejects``.  The upload event goes to ``outbox``.  Returns one row
    that describes the upload.
    """
    now = moment(at)
    dataset_id, run = stable_id("dataset", dataset), stable_id("run", dataset, path, at)
    # A malformed record only shows when all columns are parsed together, as they are for the landing table.
    landing = f"{store.root}/landing/{_bronze(dataset)}/{run}"
    rows = read_file(store.spark, path, file_schema, keep_rejects, places=True, landing=landing)
    rows, rejects = split_rejects(rows)
    places = [c for c in (FILE, ROW_NO) if c in rows.columns]

    inferred = _held(store, schema.infer_schema(rows.drop(*places)).withColumn("dataset_id", F.lit(dataset_id)))
    kinds = {row["column_name"]: row["logical_type"] for row in inferred.collect()}
    rows, lost = schema.promoted(rows, kinds)
    stored = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    storage = F.element_at(F.create_map(*[F.lit(x) for kv in stored.items() for x in kv]), F.col("column_name"))
    inferred = inferred.withColumn("storage_type", storage)
    if keep_rejects:
        record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in ("_lost", *places)]))
        rejects = rejects.unionByName(rows.filter(lost).select(record.alias(rejects.columns[0])))
        rows = rows.filter(~lost).drop("_lost")
    else:
        broken = F.when(lost, F.raise_error(F.lit(f"{path}: a value does not fit the type of its column")))
        rows = rows.filter(broken.cast("boolean").isNull()).drop("_lost")
    known = registry.current_versions(store.read("schema_versions").filter(F.col("dataset_id") == dataset_id))
    # Held before anything is written, since the new version becomes part of what is known.
    changes = _held(store, schema.schema_changes(schema.explode_schema(known, "dataset_id"), inferred, "dataset_id"))
    current = known.select("version").first()
    new = current is None
    changed = not new and not changes.isEmpty()
    version = 1 if new else current["version"] + changed

    if new:
        fields = {"name": dataset, "description": description, "domain": domain}
        layer = {"source_type": source_type(path), "bronze_table": _bronze(dataset), "is_active": True}
        register_dataset(store, dataset_id, at, **fields, **layer)
    if new or changed:
        if new:
            summary = _one(store, dataset_id=dataset_id, change_summary="Initial schema (version 1)")
        else:
            summary = schema.change_summaries(changes, "dataset_id")
        document = schema.schema_documents(inferred, "dataset_id")
        row = document.join(schema.fingerprints(inferred, "dataset_id"), "dataset_id").join(summary, "dataset_id")
        version_id = stable_id("schema", dataset_id, str(version))
        store.append_new(
            "schema_versions",
            row.withColumns({"id": F.lit(version_id), "version": F.lit(version), "created_at": now}),
        )

    header = {"id": run, "run_id": run, "dataset_id": dataset_id, "dag_id": "upload"}
    store.append_new("pipeline_runs", registry.open_runs(_one(store, **header), now))
    try:
        ingested = _write_bronze(store, rows, dataset, path, run, version, at)
        rejected = _write_quarantine(store, rejects, dataset, run) if keep_rejects else 0
    except Exception as error:
        failed = _one(store, **{**header, "id": f"{run}-failed"}, error_message=str(error))
        store.append_new("pipeline_runs", registry.close_runs(failed, now, F.lit("failed")))
        raise
    closed = _one(store, **{**header, "id": f"{run}-closed"}, rows_ingested=ingested, rows_rejected=rejected)
    store.append_new("pipeline_runs", registry.close_runs(closed, now, F.lit("success")))

    entry = F.struct("change_type", "column_name", "detail")
    listed = changes.groupBy("dataset_id").agg(F.sort_array(F.collect_list(entry)).alias("schema_changes"))
    upload = (
        schema.fingerprints(inferred, "dataset_id")
        .join(listed, "dataset_id", "left")
        .select(
            "dataset_id",
            F.lit(dataset).alias("dataset_name"),
            F.lit(new).alias("is_new_dataset"),
            F.lit(run).alias("pipeline_run_id"),
            F.lit(ingested).alias("rows_ingested"),
            F.lit(rejected).alias("rows_rejected"),
            F.lit(_bronze(dataset)).alias("bronze_table"),
            F.lit(version).alias("schema_version"),
            F.col("fingerprint").alias("schema_fingerprint"),
            "schema_changes",
            F.lit(at).alias("ingested_at"),
        )
    )
    event = upload_event(upload)
    store.append_new("outbox", event.withColumns({"id": run_id(F.lit("upload"), F.lit(run)), "published_at": now}))
    return upload


def send_outbox(store: FactStore, send: Callable[[DataFrame], None], at: str) -> DataFrame:
    """Hand the messages of ``outbox`` that were not sent yet to ``send``, and note them in ``outbox_sent``.

    ``send`` takes ``(topic, key, value)``, as :func:`tablepulse.sources.envelopes.publish_kafka` does.  What it
    fails on is not noted and goes out with the next call, so a message is sent once or more.
    Returns the number of messages sent.
    """
    pending = store.read("outbox").join(store.read("outbox_sent").select("id").hint("merge"), "id", "left_anti")
    send(pending.select("topic", "key", "value"))
    # What came into the outbox while the messages were sent stays pending, as ``pending`` keeps its list of files.
    sent = pending.select("id", moment(at).alias("sent_at"))
    store.append_new("outbox_sent", sent)
    return store.read("outbox_sent").filter(F.col("sent_at") == moment(at)).agg(F.count("*").alias("messages"))


def _write_bronze(
    store: FactStore, rows: DataFrame, dataset: str, path: str, run: str, version: int, at: str
) -> int:
    """Write the rows of a run; returns their number.

    The table is partitioned by run, so that later steps read the files of one run only.
    """
    bronze = layer_path(store, "bronze", _bronze(dataset), version)
    _replace_run(bronze_rows(rows, path, run, version, moment(at)), bronze, run)
    data = rows.drop(FILE, ROW_NO).schema
    return read_table(store.spark, bronze, bronze_schema(data)).filter(F.col("_pipeline_run_id") == run).count()


def _replace_run(rows: DataFrame, path: str, run: str) -> None:
    """Write the rows of a run, also none, in place of whatever a broken attempt left of it."""
    folder = f"{path}/_pipeline_run_id={quote(run, safe='')}"
    rows.drop("_pipeline_run_id").write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)


def _write_quarantine(store: FactStore, rejects: DataFrame, dataset: str, run: str) -> int:
    """Keep the raw records of a run that could not be read; returns their number."""
    folder = f"{store.root}/quarantine/{_bronze(dataset)}/{run}"
    rejects.write.mode("overwrite").parquet(folder)
    return store.spark.read.schema(rejects.schema).parquet(folder).count()


def upload_event(upload: DataFrame) -> DataFrame:
    """Message that announces an upload."""
    fields = [
        "dataset_id", "dataset_name", "is_new_dataset", "schema_version", "schema_fingerprint", "schema_changes",
        "pipeline_run_id", "rows_ingested",
    ]
    payload = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    events = upload.withColumn("event_id", run_id(F.lit("upload"), F.col("pipeline_run_id")))
    return wrap(events, F.lit("schema.events"), payload, F.col("ingested_at"))


def _bronze(dataset: str) -> str:
    body = "".join(c if c.isascii() and c.isalnum() else "_" for c in dataset.lower())
    return body.strip("_") + "_raw"


def _layer(table: str, layer: str) -> str:
    for suffix in ("_raw", "_silver"):
        table = table.removesuffix(suffix)
    return f"{table}_{layer}"


# --- layers ------------------------------------------------------------------

def _record_lineage(store: FactStore, counts: DataFrame, *names: str, transformation: str) -> DataFrame:
    rows = medallion.lineage_rows(counts, *names, transformation=transformation)
    rows = rows.withColumn("id", run_id(F.col("pipeline_run_id"), F.col("source_layer"), F.col("target_layer")))
    store.append_new("dataset_lineage", rows)
    return rows


def bronze_to_silver(
    store: FactStore, dataset_id: str, bronze_table: str, columns: T.StructType, run: str, at: str, version: int = 1,
    mode: str = "row",
) -> DataFrame:
    """Add one run's Bronze rows to Silver and record the lineage."""
    spark = store.spark
    source = read_table(spark, layer_path(store, "bronze", bronze_table, version), bronze_schema(columns))
    path = layer_path(store, "silver", _layer(bronze_table, "silver"), version)
    silver = read_table(spark, path, silver_schema(columns))
    if mode == "run_once":
        # The whole run is written again, so what a broken attempt left of it does not count as the run.
        rows = medallion.to_silver(source.filter(F.col("_pipeline_run_id") == run), version).dropDuplicates(["_row_key"])
        _replace_run(rows.withColumn("_silver_loaded_at", moment(at)), path, run)
    else:
        rows = medallion.silver_additions(source, silver, run, version, mode).withColumn("_silver_loaded_at", moment(at))
        rows.write.mode("append").partitionBy("_pipeline_run_id").parquet(path)
    register_dataset(store, dataset_id, at, silver_table=_layer(bronze_table, "silver"))

    written = read_table(spark, path, silver_schema(columns)).filter(F.col("_pipeline_run_id") == run)
    counts = medallion.run_counts(written).select(
        F.lit(dataset_id).alias("dataset_id"),
        F.col("_pipeline_run_id").alias("pipeline_run_id"),
        moment(at).alias("event_at"),
        F.col("rows_merged").alias("rows_in"),
        F.col("rows_quarantined").alias("rows_rejected"),
    )
    names = ("bronze", "silver", bronze_table, _layer(bronze_table, "silver"))
    return _record_lineage(store, counts, *names, transformation="merge_dedup")


def silver_to_gold(
    store: FactStore, dataset_id: str, silver_table: str, columns: T.StructType, run: str, at: str, version: int = 1,
    key: str | None = None,
) -> DataFrame:
    """Aggregate one run's Silver rows into Gold, once, and record the lineage."""
    spark = store.spark
    silver = read_table(spark, layer_path(store, "silver", silver_table, version), silver_schema(columns))
    path = layer_path(store, "gold", _layer(silver_table, "gold"), version)
    schema_ = gold_schema(columns)
    rows = medallion.to_gold(silver, key, run).withColumns(
        {"_aggregation_date": moment(at).cast("date"), "_gold_loaded_at": moment(at)}
    )
    _replace_run(rows.select(*[F.col(f.name).cast(f.dataType) for f in schema_.fields]), path, run)
    register_dataset(store, dataset_id, at, gold_table=_layer(silver_table, "gold"))

    counts = (
        medallion.run_counts(silver.filter(F.col("_pipeline_run_id") == run))
        .join(
            medallion.gold_counts(read_table(spark, path, schema_).filter(F.col("_pipeline_run_id") == run)),
            "_pipeline_run_id",
        )
        .select(
            F.lit(dataset_id).alias("dataset_id"),
            F.col("_pipeline_run_id").alias("pipeline_run_id"),
            moment(at).alias("event_at"),
            F.col("rows_merged").alias("rows_in"),
            F.col("gold_rows").alias("rows_out"),
            F.lit(0).alias("rows_rejected"),
        )
    )
    names = ("silver", "gold", silver_table, _layer(silver_table, "gold"))
    return _record_lineage(store, counts, *names, transformation="aggregate")


# --- monitoring runs ---------------------------------------------------------

def _context(run: str, dataset_id: str, pipeline_run_id: str, at: str, **more: str) -> dict[str, Column]:
    fields = {"id": run, "dataset_id": dataset_id, "pipeline_run_id": pipeline_run_id, **more}
    return {**{k: F.lit(v) for k, v in fields.items()}, "evaluated_at": moment(at)}


def _append_all(store: FactStore, facts: Mapping[str, DataFrame]) -> None:
    keys = {"quality_metrics": ["quality_run_id", "column_name", "metric_type"], "drift_metrics": ["drift_run_id", "column_name"]}
    for table, rows in facts.items():
        if table in keys:
            new = rows_not_in(rows, store.read(table), keys[table])
            new.write.mode("append").parquet(store.path(table))
        else:
            store.append_new(table, rows)


def quality_job(
    store: FactStore,
    df: DataFrame | None,
    dataset_id: str,
    pipeline_run_id: str,
    silver_table: str,
    at: str,
    schema_version: int = 1,
    config: QualityConfig = QualityConfig(),
    request: str = "",
) -> DataFrame:
    """Profile a table, append the quality facts and return the result row."""
    if df is None or df.isEmpty():
        return _skipped(store, "quality_agent", "low", "table is missing or has 0 rows")
    run = stable_id("quality", dataset_id, pipeline_run_id, at, *([request] if request else []))
    context = _context(run, dataset_id, pipeline_run_id, at, silver_table=silver_table)
    context["schema_version"] = F.lit(schema_version)
    # One row with one array entry per column; kept so that the table is scanned once.
    measured = quality.measure(df, types=registered_types(store, dataset_id)).persist()
    scored = quality.score(quality.rates(measured, at), config)
    metrics = quality.metric_rows(quality.column_metrics(measured), config=config)
    _append_all(store, quality_facts(scored, metrics, context))
    measured.unpersist()

    written = store.read("data_quality_metrics").filter(F.col("id") == run)
    status = F.when(F.col("passed"), F.lit("resolved")).otherwise(F.lit("escalated"))
    actions = F.array(
        F.concat(F.lit("loaded "), F.col("total_rows").cast("string"), F.lit(f" rows from {silver_table}")),
        F.concat(F.lit("quality score: "), F.format_number("quality_score", 1), F.lit("/100")),
    )
    return result_row(written, "quality_agent", status, quality_severity(F.col("quality_score")), actions)


def _asked(kind: str, requests: DataFrame, **fixed: str) -> DataFrame:
    """Context columns of each request; ids as those of the jobs for one request."""
    parts = [F.lit(kind), F.lit(fixed["dataset_id"]), F.col("pipeline_run_id"), F.col("at"), F.col("event_id")]
    return requests.select(
        run_id(*parts).alias("id"),
        "pipeline_run_id",
        "schema_version",
        F.to_timestamp_ntz(F.col("at"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("evaluated_at"),
        *[F.lit(value).alias(name) for name, value in fixed.items()],
    ).dropDuplicates(["id"])


def quality_jobs(
    store: FactStore, df: DataFrame | None, requests: DataFrame, dataset_id: str, silver_table: str,
    config: QualityConfig = QualityConfig(),
) -> None:
    """Profile a table once and append the quality facts of all requests for it.

    ``requests`` has ``event_id``, ``pipeline_run_id``, ``at`` and ``schema_version``, all without NULL.
    The facts are those of :func:`quality_job` for each of them.  A missing or empty table adds none.
    """
    if df is None:
        return
    asked = _asked("quality", requests, dataset_id=dataset_id, silver_table=silver_table)
    keys = asked.columns
    measured = quality.measure(df, types=registered_types(store, dataset_id)).persist()
    rows = asked.withColumn("_measured", measured.select(F.struct("*")).scalar()).filter("_measured IS NOT NULL")
    rows = rows.select(*keys, "_measured.*")
    scored = quality.score(quality.rates(rows, F.col("evaluated_at"), keys), config)
    metrics = quality.metric_rows(quality.column_metrics(rows, keys), keys, config)
    _append_all(store, quality_facts(scored, metrics, {k: F.col(k) for k in keys}))
    measured.unpersist()


def drift_jobs(
    store: FactStore, sides: DataFrame | None, requests: DataFrame, dataset_id: str, silver_table: str,
    reference_table: str, config: DriftConfig = DriftConfig(), ts: str | None = None,
) -> None:
    """Compare two windows once and append the drift facts of all requests for them.

    ``requests`` as in :func:`quality_jobs`; the facts are those of :func:`drift_job` for each of them.
    """
    if sides is None:
        return
    measured = drift.side_rows(sides, ts).first()
    if min(measured["current_rows"], measured["reference_rows"]) < config.min_rows:
        return
    asked = _asked("drift", requests, dataset_id=dataset_id, silver_table=silver_table, reference_table=reference_table)
    asked = asked.withColumns(_window_limits(measured))
    keys = asked.columns
    compared = drift.column_drift(sides, config=config).persist()
    summary = asked.withColumn("_found", drift.drift_summary(compared).select(F.struct("*")).scalar()).select(*keys, "_found.*")
    # One entry per compared column.
    entries = drift.drift_metric_rows(compared).agg(F.collect_list(F.struct("*"))).scalar()
    metrics = asked.withColumn("_found", entries).select(*keys, F.inline("_found"))
    _append_all(store, drift_facts(summary, metrics, {k: F.col(k) for k in keys}))
    compared.unpersist()


def _window_limits(measured: Row) -> dict[str, Column]:
    """First and last time of both windows, NULL where they have no time column."""
    names = [name for name in drift.WINDOW_LIMITS if name in measured]
    return {name: F.lit(measured[name]).cast("timestamp_ntz") for name in names}


def registered_types(store: FactStore, dataset_id: str) -> dict[str, str]:
    """Logical type per column of the current schema; one scalar per column reaches the driver."""
    versions = store.read("schema_versions").filter(F.col("dataset_id") == dataset_id)
    columns = schema.explode_schema(registry.current_versions(versions), "dataset_id")
    return {row["column_name"]: row["logical_type"] for row in columns.collect()}


def drift_job(
    store: FactStore,
    sides: DataFrame,
    dataset_id: str,
    pipeline_run_id: str,
    silver_table: str,
    at: str,
    reference_table: str | None = None,
    columns: Sequence[str] | None = None,
    config: DriftConfig = DriftConfig(),
    request: str = "",
    ts: str | None = None,
) -> DataFrame:
    """Compare two windows, append the drift facts and return the result row.

    ``ts`` names the time column whose first and last values become the window limits.
    """
    rows = drift.side_rows(sides, ts).first()
    if min(rows["current_rows"], rows["reference_rows"]) < config.min_rows:
        return _skipped(store, "drift_agent", "low", f"fewer than {config.min_rows} rows on a side")
    run = stable_id("drift", dataset_id, pipeline_run_id, at, *([request] if request else []))
    context = _context(
        run, dataset_id, pipeline_run_id, at, silver_table=silver_table, reference_table=reference_table or silver_table
    )
    context |= _window_limits(rows)
    # One row per compared column, used for three fact tables.
    compared = drift.column_drift(sides, columns, config=config).persist()
    _append_all(store, drift_facts(drift.drift_summary(compared), drift.drift_metric_rows(compared), context))
    compared.unpersist()

    written = store.read("drift_summary").filter(F.col("id") == run)
    status = F.when(F.col("drift_severity") == HIGH, F.lit("escalated")).otherwise(F.lit("resolved"))
    actions = F.array(
        F.lit(f"compared {rows['current_rows']} current rows vs {rows['reference_rows']} reference rows"),
        F.format_string("%d of %d columns drifted", "drifted_columns", "total_columns"),
    )
    return result_row(written, "drift_agent", status, F.col("drift_severity"), actions)


def cost_job(
    store: FactStore,
    usage: DataFrame,
    runs: DataFrame,
    dataset_id: str,
    pipeline_run_id: str,
    at: str,
    days: int = CostConfig.lookback_days,
    warehouse: str | None = None,
    config: CostConfig = CostConfig(),
    request: str = "",
) -> DataFrame:
    """Roll up, score and forecast usage per warehouse; one result row per warehouse."""
    measured = cost.cost_report(usage, runs, at, days, warehouse, config=config).persist()
    asked = [F.lit(request)] if request else []
    run = run_id(F.lit("cost"), F.lit(dataset_id), F.lit(pipeline_run_id), F.lit(at), F.col("warehouse_name"), *asked)
    context = {**_context("", dataset_id, pipeline_run_id, at), "id": run}
    _append_all(store, cost_facts(measured, cost.forecast(measured, at, ["warehouse_name"], config), context))
    measured.unpersist()

    written = store.read("cost_summary").filter(
        (F.col("dataset_id") == dataset_id) & (F.col("pipeline_run_id") == pipeline_run_id) & (F.col("evaluated_at") == moment(at))
    )
    status = F.when(F.col("cost_severity") == HIGH, F.lit("escalated")).otherwise(F.lit("resolved"))
    actions = F.array(
        F.concat(F.lit("total_credits="), F.format_number("total_credits", 4)),
        F.concat(F.lit("cost_score="), F.format_number("cost_score", 1), F.lit("/100")),
    )
    return result_row(written, "cost_agent", status, F.col("cost_severity"), actions)


def heal_job(store: FactStore, failures: DataFrame, at: str, config: HealConfig = HealConfig()) -> DataFrame:
    """Recover a backlog of failures: set the status of runs and data sets, put retry events into
    the outbox and append the heal facts.  One result row per event.

    ``outbox`` holds wrapped messages; :func:`tablepulse.sources.envelopes.publish_kafka` sends them.
    """
    now = moment(at)
    given = F.col("detected_at").cast("timestamp_ntz") if "detected_at" in failures.columns else F.lit(None).cast("timestamp_ntz")
    # What is recovered now was found when the event was published, if it says when.
    failures = failures.withColumns({"detected_at": given, "resolved_at": now})
    # Read by six tables; a lost executor only means that a part is decided again.
    decided = healing.decide(failures, config).persist()
    summary = healing.heal_summary(decided, with_origin=True)

    # First the changes, then the facts that report them; a repeated job adds neither twice.
    marks = healing.run_status_events(decided)
    final = F.col("status") != "healing"
    steps = marks.select(
        run_id(F.lit("heal"), F.col("event_id"), F.col("step").cast("string")).alias("id"),
        "run_id",
        "status",
        F.when(final, now).alias("completed_at"),
        now.alias("event_ts"),
    )
    store.append_new("pipeline_runs", steps)
    held = healing.dataset_status_events(decided)
    held = held.select(run_id(F.lit("heal"), F.col("event_id")).alias("id"), "dataset_id", "status", now.alias("event_ts"))
    store.append_new("dataset_events", held)
    retries = healing.recovery_events(decided)
    messages = wrap(retries, F.col("topic"), F.col("payload"), F.lit(at))
    messages = messages.withColumns({"id": F.md5("value"), "published_at": now})
    store.append_new("outbox", messages)
    _append_all(store, heal_facts(summary, healing.actions(decided), now))
    summary = summary.drop("failed_task", "detected_at")
    status = (
        F.when(F.col("recovery_status") == healing.ESCALATED, F.lit("escalated"))
        .when(F.col("recovery_status") == healing.FAILED, F.lit("failed"))
        .otherwise(F.lit("resolved"))
    )
    return result_row(summary, "self_healing_agent", status, F.col("severity"), F.array("healing_strategy"))
