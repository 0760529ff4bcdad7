"""Envelopes and streams over messages derived from events.

``st_01``, ``st_05``, ``st_07``, ``st_09`` and ``jn_08`` run real streams to their end before they return.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepulse.catalog import query
from tablepulse.catalog.tables import EVENTS_END
from tablepulse.session import shared_folder
from tablepulse.sources import envelopes, registry
from tablepulse.sources.facts import FactStore
from tablepulse.streaming import events, handlers, windows


@query("snk_05_envelopes", """
    SELECT 'quality.events' AS topic, COALESCE(CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR)) AS key,
        concat('{"event_id":"', CAST(event_id AS VARCHAR), '","topic":"quality.events","dataset_id":', CASE WHEN user_id IS NULL THEN 'null' ELSE concat('"', CAST(user_id AS VARCHAR), '"') END,
               ',"published_at":"2024-01-31T00:00:00","payload":', props, '}') AS value FROM v_events_dirty""")
def _(t):
    rows = t["v_events_dirty"].select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("dataset_id"), "props"
    )
    return envelopes.wrap(rows, F.lit("quality.events"), F.col("props"), F.lit("2024-01-31T00:00:00"))


@query("st_02_decoded_envelopes", """
    SELECT json_extract_string(value, '$.event_id') AS event_id, json_extract_string(value, '$.topic') AS topic, json_extract_string(value, '$.dataset_id') AS dataset_id
    FROM v_messages WHERE json_valid(value)""")
def _(t):
    good, _ = events.split_malformed(t["v_messages"])
    return good.select("event_id", "topic", "dataset_id")


@query("st_02_dead_letters", "SELECT value FROM v_messages WHERE NOT json_valid(value)")
def _(t):
    _, bad = events.split_malformed(t["v_messages"])
    return bad


CONTEXT = """
    j AS (SELECT json_extract_string(value, '$.event_id') AS event_id, COALESCE(json_extract_string(value, '$.dataset_id'), json_extract_string(value, '$.payload.dataset_id')) AS dataset_id,
        json_extract_string(value, '$.payload.pipeline_run_id') AS run, COALESCE(json_extract_string(value, '$.payload.dataset_name'), 'unknown') AS dataset_name,
        COALESCE(CAST(json_extract_string(value, '$.payload.schema_version') AS INT), 1) AS schema_version,
        COALESCE(CAST(json_extract_string(value, '$.payload.rows_ingested') AS BIGINT), 0) AS rows_ingested,
        COALESCE(CAST(json_extract_string(value, '$.payload.rows_rejected') AS BIGINT), 0) AS rows_rejected,
        json_extract_string(value, '$.topic') AS topic FROM v_messages WHERE json_valid(value)),
    cx AS (SELECT * FROM j WHERE dataset_id IS NOT NULL)"""


def _contexts(t):
    good, _ = events.split_malformed(t["v_messages"])
    return events.ingestion_context(good)


@query("st_03_ingestion_contexts", f"""
    WITH {CONTEXT} SELECT event_id, dataset_id, COALESCE(run, md5(event_id)) AS pipeline_run_id, dataset_name,
        concat(translate(lower(dataset_name), '-', '_'), '_raw') AS bronze_table, concat(translate(lower(dataset_name), '-', '_'), '_silver') AS silver_table,
        concat(translate(lower(dataset_name), '-', '_'), '_gold') AS gold_table, schema_version, rows_ingested, rows_rejected FROM cx""")
def _(t):
    return _contexts(t)


TOTALS = f"""
    WITH {CONTEXT} SELECT dataset_id, COUNT(*) AS events, CAST(SUM(rows_ingested) AS BIGINT) AS rows_ingested, CAST(SUM(rows_rejected) AS BIGINT) AS rows_rejected FROM cx GROUP BY dataset_id"""


@query("st_04_dataset_totals", TOTALS)
def _(t):
    return events.dataset_totals(_contexts(t))


@query("st_06_job_contexts", f"""
    WITH {CONTEXT} SELECT j.event_id, j.dataset_id, j.run AS pipeline_run_id, r.silver_table FROM j
    LEFT JOIN (SELECT concat('d', dataset_id) AS dataset_id, silver_table FROM v_datasets) r ON j.dataset_id = r.dataset_id""")
def _(t):
    good, _ = events.split_malformed(t["v_messages"])
    known = registry.current_datasets(t["v_dataset_events"], "event_no")
    known = known.withColumn("dataset_id", F.concat(F.lit("d"), "dataset_id"))
    return events.job_context(good, known).select("event_id", "dataset_id", "pipeline_run_id", "silver_table")


@query("st_08_topic_lag", """
    SELECT event_type AS topic, CAST(SUM(greatest(0, high - greatest(low, COALESCE(committed, low)))) AS BIGINT) AS lag FROM (
        SELECT event_type, CAST(ts AS DATE) AS part, MIN(event_id) AS low, MAX(event_id) AS high, MIN(CASE WHEN user_id > 100 THEN event_id END) AS committed FROM events GROUP BY 1, 2) o GROUP BY event_type""")
def _(t):
    offsets = t["events"].groupBy(F.col("event_type").alias("topic"), F.to_date("ts").alias("partition")).agg(
        F.min("event_id").alias("low"), F.max("event_id").alias("high"), F.min(F.when(F.col("user_id") > 100, F.col("event_id"))).alias("committed")
    )
    return events.topic_lag(offsets)


def _publish(t, path):
    """Write the messages to a folder of text files, as an event source."""
    t["v_messages"].select("value").write.text(path)


@query("st_01_streamed_totals", TOTALS)
def _(t):
    root = shared_folder(t.spark)
    _publish(t, f"{root}/in")
    good, bad = events.split_malformed(events.read_lines(t.spark, f"{root}/in"))

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/totals/batch_id={batch_id}")

    query = events.drain(events.dataset_totals(events.ingestion_context(good)), write, f"{root}/state", "complete")
    query.awaitTermination()
    dead = events.write_dead_letters(bad, f"{root}/dead", f"{root}/dead_state")
    dead.awaitTermination()
    totals = t.spark.read.parquet(f"{root}/totals")
    newest = totals.agg(F.max("batch_id").alias("batch_id"))
    return totals.join(F.broadcast(newest), "batch_id", "left_semi").drop("batch_id")


@query("st_07_events_once", f"""
    WITH {CONTEXT} SELECT event_id AS id, dataset_id, rows_ingested, 'SILVER' AS target_layer FROM cx""")
def _(t):
    """The messages are delivered twice and drained by two runs of the stream."""
    root = shared_folder(t.spark)
    store = FactStore(t.spark, f"{root}/facts")
    for delivery in (1, 2):
        t["v_messages"].select("value").write.mode("append").text(f"{root}/in")
        good, _ = events.split_malformed(events.read_lines(t.spark, f"{root}/in"))
        rows = events.ingestion_context(good).select(
            F.col("event_id").alias("id"), "dataset_id", F.col("rows_ingested").alias("rows_in"), F.lit("SILVER").alias("target_layer")
        )
        events.drain(rows, events.append_once(store, "dataset_lineage"), f"{root}/state").awaitTermination()
    return store.read("dataset_lineage").select("id", "dataset_id", F.col("rows_in").alias("rows_ingested"), "target_layer")


@query("st_09_window_metrics", """
    SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS window_end, event_type,
        COUNT(*) AS total_rows, MAX(ts) AS latest_event, COUNT(*) FILTER (user_id IS NULL) AS user_id_nulls, COUNT(*) FILTER (value IS NULL) AS value_nulls
    FROM events GROUP BY ALL""")
def _(t):
    root = shared_folder(t.spark)
    # A pattern, because the table may be one file or a folder of files.
    source = t.spark.readStream.schema(t["events"].schema).parquet(f"{t.folder}/events.parque[t]")
    metrics = windows.window_metrics(source, "ts", ["user_id", "value"], group_by=["event_type"])
    windows.start_window_metrics(metrics, f"{root}/metrics", f"{root}/state").awaitTermination()
    out = windows.read_window_metrics(t.spark, f"{root}/metrics", ["event_type"])
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end", "latest_event")}
    return out.withColumns(times)


@query("st_09_late_rows", """
    WITH d AS (SELECT *, event_id % 5 = 0 AS second, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start FROM events),
    l AS (SELECT MAX(ts) - INTERVAL 1 HOUR AS closed FROM d WHERE NOT second)
    SELECT window_start, event_type, CASE WHEN second AND window_start + INTERVAL 15 MINUTE <= closed THEN 'late' ELSE 'on_time' END AS arrival,
        COUNT(*) AS total_rows, COUNT(*) FILTER (value IS NULL) AS value_nulls FROM d, l GROUP BY ALL""")
def _(t):
    """A fifth of the events comes in a second delivery, mostly after its windows closed: counted apart, not lost."""
    root = shared_folder(t.spark)
    second = F.col("event_id") % 5 == 0
    for delivery in (~second, second):
        t["events"].filter(delivery).write.mode("append").parquet(f"{root}/in")
        source = t.spark.readStream.schema(t["events"].schema).parquet(f"{root}/in")
        windows.start_counted_windows(source, "ts", ["value"], f"{root}/metrics", f"{root}/state", group_by=["event_type"]).awaitTermination()
    found = windows.read_counted_windows(t.spark, f"{root}/metrics", ["event_type"])
    return found.select("window_start", "event_type", "arrival", "total_rows", "value_nulls")


def _messages(rows, topic, payload):
    """Envelopes as text lines for rows with ``event_id`` and ``dataset_id``."""
    named = rows.withColumn("payload", F.to_json(F.struct(*payload)))
    return envelopes.wrap(named, F.lit(topic), F.col("payload"), F.lit("2024-01-31T00:00:00")).select("value")


@query("jn_08_changing_registry", """
    SELECT CAST(event_id AS VARCHAR) AS event_id, concat('d', event_id % 30) AS dataset_id,
        CASE WHEN n_nationkey IS NULL THEN NULL ELSE concat(n_name, CASE WHEN event_id % 2 = 1 AND n_regionkey = 1 THEN '_v2' ELSE '_v1' END) END AS silver_table
    FROM events LEFT JOIN nation ON n_nationkey = event_id % 30""")
def _(t):
    """A stream in two batches; between them the registry gives the data sets of one region other tables."""
    root = shared_folder(t.spark)
    store = FactStore(t.spark, f"{root}/facts")

    def register(nations, version, at):
        store.append_new("dataset_events", nations.select(
            F.concat_ws("-", "n_nationkey", F.lit(version)).alias("id"), F.concat(F.lit("d"), "n_nationkey").alias("dataset_id"),
            F.lit(at).alias("event_ts"), F.concat("n_name", F.lit(version)).alias("silver_table"),
        ))

    def keep(batch, batch_id):
        batch.select("event_id", "dataset_id", "silver_table").write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    rows = t["events"].select(
        F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("d"), F.col("event_id") % 30).alias("dataset_id"), F.col("event_type")
    )
    register(t["nation"], "_v1", "2024-01-01 00:00:00")
    handler = events.enriched(keep, lambda: registry.current_datasets(store.read("dataset_events"), "id"))
    for rest in (0, 1):
        _messages(rows.filter(F.col("event_id").cast("bigint") % 2 == rest), "quality.events", ["event_type"]).write.mode("append").text(f"{root}/in")
        good, _ = events.split_malformed(events.read_lines(t.spark, f"{root}/in"))
        events.drain(good, handler, f"{root}/state").awaitTermination()
        register(t["nation"].filter("n_regionkey = 1"), "_v2", "2024-01-02 00:00:00")
    return t.spark.read.parquet(f"{root}/out").drop("batch_id")


@query("st_05_requests_by_table", """
    SELECT CAST(c_custkey AS VARCHAR) AS pipeline_run_id, CASE c_custkey % 3 WHEN 0 THEN 'orders' WHEN 1 THEN 'part' ELSE 'supplier' END AS silver_table,
        CASE c_custkey % 3 WHEN 0 THEN (SELECT COUNT(*) FROM orders) WHEN 1 THEN (SELECT COUNT(*) FROM part) ELSE (SELECT COUNT(*) FROM supplier) END AS total_rows,
        2 * CASE c_custkey % 3 WHEN 0 THEN (SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'orders') WHEN 1 THEN (SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'part')
            ELSE (SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'supplier') END AS metric_rows
    FROM customer""")
def _(t):
    """One request per customer for one of three tables: three profiles, facts for every request."""
    root = shared_folder(t.spark)
    store = FactStore(t.spark, f"{root}/facts")
    table = F.element_at(F.array(*[F.lit(n) for n in ("orders", "part", "supplier")]), (F.col("c_custkey") % 3 + 1).cast("int"))
    key = F.col("c_custkey").cast("string")
    rows = t["customer"].select(key.alias("event_id"), F.lit("d").alias("dataset_id"), key.alias("pipeline_run_id"), table.alias("silver_table"))
    _messages(rows, "quality.events", ["pipeline_run_id", "silver_table"]).write.text(f"{root}/in")
    good, _ = events.split_malformed(events.read_lines(t.spark, f"{root}/in"))
    events.drain(good, handlers.quality_handler(store, lambda name: t[name], "2024-01-31 00:00:00"), f"{root}/state").awaitTermination()
    metrics = store.read("quality_metrics").groupBy(F.col("quality_run_id").alias("id")).agg(F.count("*").alias("metric_rows"))
    facts = store.read("data_quality_metrics").join(metrics, "id")
    return facts.select("pipeline_run_id", "silver_table", "total_rows", "metric_rows")
