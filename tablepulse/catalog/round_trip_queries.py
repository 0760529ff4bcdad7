"""What files, repeated runs and jobs leave behind, read back and compared with the source."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.catalog import query
from tablepulse.catalog.healing_queries import ACTIONS, DECIDED
from tablepulse.catalog.tables import EVENTS_END, LINES_SPLIT
from tablepulse.operators import drift, healing, medallion, quality
from tablepulse.plans import jobs, reports
from tablepulse.session import shared_folder
from tablepulse.sources.envelopes import publish_text, unwrap
from tablepulse.sources.facts import FactStore
from tablepulse.sources.files import read_file, source_type, split_rejects

AT, LATER = "2002-01-01 00:00:00", "2002-01-02 00:00:00"


def _store(t):
    return FactStore(t.spark, shared_folder(t.spark))


@contextmanager
def small_splits(spark, size: int):
    """Splits of ``size`` bytes for the scans that run inside."""
    names = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 0}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


# --- files -------------------------------------------------------------------

@query("src_01_quoted_texts", "SELECT doc_id, text FROM documents")
def _(t):
    path = f"{shared_folder(t.spark)}/texts.csv"
    options = {"header": True, "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    t["documents"].select("doc_id", "text").write.options(**options).csv(path)
    return read_file(t.spark, path).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


@query("src_01_split_quoted", "SELECT doc_id, replace(text, chr(13), '') AS text, lang, source, n_chars FROM documents")
def _(t):
    """One large quoted file in many splits, line breaks inside its texts."""
    path = f"{shared_folder(t.spark)}/documents.csv"
    options = {"header": True, "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    t["documents"].withColumn("text", F.regexp_replace("text", "\r", "")).coalesce(1).write.options(**options).csv(path)
    with small_splits(t.spark, 64 << 10):
        return read_file(t.spark, path, t["documents"].schema, landing=f"{shared_folder(t.spark)}/landing")


@query("src_01_missing_tokens", "SELECT event_id, user_id, event_type, value FROM v_events_dirty")
def _(t):
    path = f"{shared_folder(t.spark)}/events.csv"
    rows = t["v_events_dirty"]
    mark = F.when(F.col("event_id") % 2 == 0, "N/A").otherwise("NaN")
    texts = rows.select("event_id", "event_type", *[F.coalesce(F.col(c).cast("string"), mark).alias(c) for c in ("user_id", "value")])
    texts.write.csv(path, header=True)
    kinds = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double"}
    found = read_file(t.spark, path, multi_line=False)
    # A column that kept its marks would be a text, and the cast of them an error.
    return found.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])


@query("src_03_readers_by_extension", """
    SELECT s_suppkey, s_name, s_nationkey, s_acctbal, source_type FROM supplier, (VALUES ('csv'), ('json'), ('jsonl')) k(source_type)""")
def _(t):
    """The whole table as three kinds of file; the extension, in any case, chooses the reader."""
    root, rows = shared_folder(t.spark), t["supplier"].select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    paths = [f"{root}/supplier.{extension}" for extension in ("CSV", "Json", "JSONL")]
    rows.write.csv(paths[0], header=True)
    rows.write.json(paths[1])
    rows.write.json(paths[2])
    found = [read_file(t.spark, path, rows.schema).withColumn("source_type", F.lit(source_type(path))) for path in paths]
    return reduce(DataFrame.unionByName, found)


@query("src_05_quarantined_records", "SELECT c_custkey, c_name, c_custkey % 7 <> 0 AS kept FROM customer")
def _(t):
    """Every seventh record lacks its end: it goes to quarantine as it stands, all others are read."""
    root, rows = shared_folder(t.spark), t["customer"].select("c_custkey", "c_name")
    path = f"{root}/customers.jsonl"
    whole = F.to_json(F.struct("c_custkey", "c_name"))
    rows.select(F.when(F.col("c_custkey") % 7 == 0, F.substring(whole, 1, F.length(whole) - 1)).otherwise(whole)).write.text(path)
    good, bad = split_rejects(read_file(t.spark, path, rows.schema, rejects=True, landing=f"{root}/landing"))
    mended = F.from_json(F.concat("_corrupt_record", F.lit("}")), rows.schema).alias("row")
    quarantined = bad.select(mended).select("row.*", F.lit(False).alias("kept"))
    return good.select("c_custkey", "c_name", F.lit(True).alias("kept")).unionByName(quarantined)


def _texts_of_orders(t):
    return t["orders"].select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("o_orderdate"), "o_orderpriority",
    )


@query("sch_09_promoted_types", """
    SELECT o_orderkey, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS o_orderdate, o_orderpriority FROM orders""")
def _(t):
    """Texts are stored in the types that they were promoted to."""
    store = _store(t)
    path = f"{store.root}/upload/orders.jsonl"
    _texts_of_orders(t).write.json(path)
    upload = jobs.ingest_file(store, path, "Text Orders", AT).first()
    bronze = t.spark.read.parquet(jobs.layer_path(store, "bronze", upload["bronze_table"], 1))
    return bronze.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("sch_09_mismatch_of_promoted_types", "SELECT 0.0e0 AS type_mismatch_rate, COUNT(*) AS total_rows FROM orders")
def _(t):
    store = _store(t)
    path = f"{store.root}/upload/orders.jsonl"
    _texts_of_orders(t).write.json(path)
    upload = jobs.ingest_file(store, path, "Text Orders", AT).first()
    bronze = t.spark.read.parquet(jobs.layer_path(store, "bronze", upload["bronze_table"], 1))
    jobs.quality_job(store, bronze, upload["dataset_id"], "r", "orders", AT)
    return store.read("data_quality_metrics").select(F.col("type_mismatch_rate").cast("double").alias("type_mismatch_rate"), "total_rows")


@query("sch_09_two_versions", """
    SELECT c_custkey, c_name, NULL::DOUBLE AS c_acctbal FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 1""")
def _(t):
    """A column is added by the second upload; the table over both versions has all rows."""
    store = _store(t)
    rows = t["customer"].select("c_custkey", "c_name", "c_acctbal")
    kinds = T.StructType.fromDDL("c_custkey bigint, c_name string, c_acctbal double")
    first, second = f"{store.root}/upload/first.csv", f"{store.root}/upload/second.csv"
    rows.filter("c_custkey % 2 = 0").drop("c_acctbal").write.csv(first, header=True)
    rows.filter("c_custkey % 2 = 1").write.csv(second, header=True)
    jobs.ingest_file(store, first, "Customers", AT, file_schema=T.StructType(kinds.fields[:2]))
    row = jobs.ingest_file(store, second, "Customers", LATER, file_schema=kinds).first()
    found = jobs.all_versions(store, "bronze", row["bronze_table"], row["dataset_id"])
    return found.select("c_custkey", "c_name", "c_acctbal")


@query("snk_05_upload_event", """
    SELECT 'schema.events' AS topic, md5('dataset|Customers') AS dataset_id, COUNT(*) AS rows_ingested FROM customer""")
def _(t):
    store = _store(t)
    path = f"{store.root}/upload/customers.csv"
    t["customer"].select("c_custkey", "c_name").write.csv(path, header=True)
    upload = jobs.ingest_file(store, path, "Customers", AT, file_schema=T.StructType.fromDDL("c_custkey bigint, c_name string"))
    field = lambda name: F.get_json_object("value", f"$.{name}")
    return jobs.upload_event(upload).select(
        field("topic").alias("topic"), field("dataset_id").alias("dataset_id"), field("payload.rows_ingested").cast("bigint").alias("rows_ingested")
    )


# --- rows that must not be lost ----------------------------------------------

@query("snk_01_rerun_after_partial_write", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    """A load that broke off left a part of its rows; the repeated load replaces them."""
    store = _store(t)
    path = f"{store.root}/upload/orders.csv"
    rows = t["orders"].select("o_orderkey", "o_totalprice")
    rows.write.csv(path, header=True)
    kinds = T.StructType.fromDDL("o_orderkey bigint, o_totalprice double")
    row = jobs.ingest_file(store, path, "Orders", AT, file_schema=kinds).first()
    bronze = jobs.layer_path(store, "bronze", row["bronze_table"], 1)
    part = t.spark.read.parquet(bronze).filter("o_orderkey % 3 = 0")
    left = f"{store.root}/left"
    part.write.parquet(left)
    t.spark.read.parquet(left).write.mode("overwrite").partitionBy("_pipeline_run_id").parquet(bronze)
    jobs.ingest_file(store, path, "Orders", AT, file_schema=kinds)
    return t.spark.read.parquet(bronze).select("o_orderkey", "o_totalprice")


@query("snk_01_ids_over_splits", """
    SELECT c_custkey, c_name, c_acctbal, 1 AS ids FROM customer""")
def _(t):
    """The same file loaded with two split sizes: every row keeps its ingestion id."""
    store = _store(t)
    path = f"{store.root}/upload/customers.csv"
    t["customer"].coalesce(1).write.csv(path, header=True)
    loads = []
    for size in (16 << 10, 1 << 30):
        with small_splits(t.spark, size):
            row = jobs.ingest_file(store, path, "Customers", AT, file_schema=t["customer"].schema).first()
        bronze = t.spark.read.parquet(jobs.layer_path(store, "bronze", row["bronze_table"], 1))
        folder = f"{store.root}/loaded/{size}"
        bronze.write.parquet(folder)
        loads.append(t.spark.read.parquet(folder).select("c_custkey", "c_name", "c_acctbal", "_ingestion_id"))
    both = loads[0].unionByName(loads[1])
    ids = F.count_distinct("_ingestion_id").cast("int").alias("ids")
    return both.groupBy("c_custkey", "c_name", "c_acctbal").agg(ids)


@query("snk_05_outbox_of_uploads", """
    SELECT 'schema.events' AS topic, md5('dataset|Customers') AS key, COUNT(*) AS rows_ingested, 1 AS n, CAST(1 AS BIGINT) AS sent, CAST(0 AS BIGINT) AS sent_again FROM customer""")
def _(t):
    """An upload puts its event into the outbox; sending empties it once."""
    store = _store(t)
    path = f"{store.root}/upload/customers.csv"
    t["customer"].write.csv(path, header=True)
    for _ in range(2):
        jobs.ingest_file(store, path, "Customers", AT, file_schema=t["customer"].schema)
    folder = f"{store.root}/sent"
    send = lambda messages: publish_text(messages, folder)
    sent = jobs.send_outbox(store, send, AT).first()["messages"]
    again = jobs.send_outbox(store, send, LATER).first()["messages"]
    messages = unwrap(t.spark.read.text(folder))
    return messages.groupBy("topic", F.col("dataset_id").alias("key")).agg(
        F.max(F.get_json_object("payload", "$.rows_ingested").cast("bigint")).alias("rows_ingested"), F.count("*").cast("int").alias("n")
    ).withColumns({"sent": F.lit(sent).cast("bigint"), "sent_again": F.lit(again).cast("bigint")})


@query("lin_03_rerun_after_partial_write", "SELECT o_orderpriority AS _aggregation_key, COUNT(*) AS _row_count FROM orders GROUP BY 1")
def _(t):
    """Gold of a run of which a broken attempt left some rows."""
    store = _store(t)
    columns = T.StructType.fromDDL("o_orderkey bigint, o_orderpriority string")
    path = f"{store.root}/upload/orders.csv"
    t["orders"].select("o_orderkey", "o_orderpriority").write.csv(path, header=True)
    row = jobs.ingest_file(store, path, "Orders", AT, file_schema=columns).first()
    args = (columns, row["pipeline_run_id"], AT)
    jobs.bronze_to_silver(store, row["dataset_id"], "orders_raw", *args)
    jobs.silver_to_gold(store, row["dataset_id"], "orders_silver", *args, key="o_orderpriority")
    gold = jobs.layer_path(store, "gold", "orders_gold", 1)
    left = f"{store.root}/left"
    t.spark.read.parquet(gold).filter("_aggregation_key < '3'").write.parquet(left)
    t.spark.read.parquet(left).write.mode("overwrite").partitionBy("_pipeline_run_id").parquet(gold)
    jobs.silver_to_gold(store, row["dataset_id"], "orders_silver", *args, key="o_orderpriority")
    return t.spark.read.parquet(gold).select("_aggregation_key", "_row_count")


@query("med_01_close_rows", "SELECT COUNT(*) AS n FROM events")
def _(t):
    """Rows of one run and number whose load times lie microseconds apart."""
    rows = t["events"].select(
        F.lit("r").alias("_pipeline_run_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id / 1000000)").alias("_loaded_at"),
        F.lit(1).alias("_row_number"), "event_id",
    )
    return medallion.silver_additions(rows, medallion.to_silver(rows).filter("false")).agg(F.count("*").alias("n"))


@query("med_01_rows_without_number", "SELECT event_id FROM events")
def _(t):
    rows = t["events"].select(
        F.lit("r").alias("_pipeline_run_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("_loaded_at"),
        F.lit(None).cast("bigint").alias("_row_number"), "event_id",
    )
    return medallion.silver_additions(rows, medallion.to_silver(rows).filter("false")).select("event_id")


@query("dq_03_nested_times", "SELECT COUNT(*) AS total_rows, CAST(0 AS BIGINT) AS duplicate_count FROM events")
def _(t):
    moment = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id / 1000000)")
    nested = t["events"].select(F.struct(moment.alias("at")).alias("s"))
    return quality.duplicate_rows(nested).select("total_rows", "duplicate_count")


MANY = 24


@query("med_04_many_measures", f"""
    SELECT o_orderpriority AS _pipeline_run_id, {", ".join(f"CAST(SUM(o_orderkey + {i}) AS BIGINT) AS c{i}_sum" for i in range(MANY))}
    FROM orders GROUP BY 1""")
def _(t):
    rows = t["orders"].select(
        F.col("o_orderpriority").alias("_pipeline_run_id"), F.lit(False).alias("_is_quarantined"), F.lit(1.0).alias("_quality_score"),
        *[(F.col("o_orderkey") + i).alias(f"c{i}") for i in range(MANY)],
    )
    gold = medallion.to_gold(rows)
    return gold.select("_pipeline_run_id", *[F.col(f"c{i}_sum").cast("bigint").alias(f"c{i}_sum") for i in range(MANY)])


# --- healing -----------------------------------------------------------------

@query("he_05_long_reasons", """
    SELECT CAST(doc_id AS VARCHAR) AS event_id, sha256(concat('data set d held back: ', 'null: ', text)) AS detail FROM documents
    WHERE NOT regexp_matches(lower('null: ' || text), 'snowflake|kafka|timeout|connection|socket|network|refused|broker|ssl|tls')""")
def _(t):
    """Reasons of any length stay whole."""
    failures = t["documents"].select(
        F.col("doc_id").cast("string").alias("event_id"), F.lit("d").alias("dataset_id"), F.lit("r").alias("pipeline_run_id"),
        F.concat(F.lit("null: "), "text").alias("failure_reason"), F.lit(0).alias("retry_count"),
    )
    rows = healing.actions(healing.decide(failures)).filter("action_type = 'QUARANTINE_DATASET'")
    return rows.select("event_id", F.sha2("action_detail", 256).alias("detail"))


def _healed(t, runs=1):
    store = _store(t)
    for _ in range(runs):
        jobs.heal_job(store, t["v_failures"], EVENTS_END)
    return store


@query("he_07_status_of_datasets", f"WITH {DECIDED} SELECT DISTINCT dataset_id, 'quarantined' AS status FROM de WHERE quarantined")
def _(t):
    return jobs.datasets(_healed(t)).select("dataset_id", "status")


@query("he_08_status_of_runs", f"WITH {DECIDED} SELECT pipeline_run_id AS run_id, final_status AS status FROM de")
def _(t):
    return _healed(t).report("pipeline_runs").select("run_id", "status")


@query("he_09_outbox", f"""
    WITH {DECIDED} SELECT event_id, CASE WHEN failure_type = 'DRIFT' THEN 'drift.events' ELSE 'quality.events' END AS topic, failure_type FROM de WHERE retried""")
def _(t):
    field = lambda name: F.get_json_object("value", f"$.{name}")
    sent = _healed(t).read("outbox")
    return sent.select(field("event_id").alias("event_id"), "topic", field("payload.failure_type").alias("failure_type"))


@query("he_05_actions_of_job", f"WITH {ACTIONS} SELECT action_type, success, COUNT(*) AS n FROM (SELECT *, TRUE AS success FROM ac) GROUP BY ALL")
def _(t):
    """The repeated job adds nothing."""
    return _healed(t, runs=2).read("heal_actions").groupBy("action_type", "success").agg(F.count("*").alias("n"))


# --- reports over facts of the jobs -------------------------------------------

@query("mq_02_recent_runs_of_jobs", f"WITH {DECIDED} SELECT run_id, status FROM (SELECT pipeline_run_id AS run_id, final_status AS status FROM de) ORDER BY run_id LIMIT 10")
def _(t):
    return reports.recent_runs(_healed(t).report("pipeline_runs"), 10).select("run_id", "status")


@query("mq_23_windows_of_jobs", f"""
    SELECT 'lines' AS dataset_id, MIN(l_shipdate) FILTER (l_shipdate < TIMESTAMP '{LINES_SPLIT}') AS reference_window_start,
        MAX(l_shipdate) FILTER (l_shipdate < TIMESTAMP '{LINES_SPLIT}') AS reference_window_end,
        MIN(l_shipdate) FILTER (l_shipdate >= TIMESTAMP '{LINES_SPLIT}') AS current_window_start,
        MAX(l_shipdate) FILTER (l_shipdate >= TIMESTAMP '{LINES_SPLIT}') AS current_window_end FROM lineitem""")
def _(t):
    """The drift job writes the limits of both windows over all columns of the table."""
    store = _store(t)
    sides = drift.split_by_time(t["lineitem"], "l_shipdate", LINES_SPLIT)
    jobs.drift_job(store, sides, "lines", "run_1", "lines_silver", AT, ts="l_shipdate")
    return reports.drift_history(store.report("drift_runs")).select("dataset_id", *drift.WINDOW_LIMITS)


@query("mq_28_cost_history_of_jobs", """
    SELECT warehouse_name, ROUND(SUM(credits_used), 4) AS credits_used, ROUND(SUM(credits_used) * 3, 4) AS cost_usd, 'COMPUTE' AS service_type
    FROM v_usage WHERE execution_status = 'SUCCESS' AND start_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY warehouse_name""")
def _(t):
    store = _store(t)
    runs = store.read("pipeline_runs")
    jobs.cost_job(store, t["v_usage"], runs, "d", "r", EVENTS_END)
    rows = reports.cost_history(store.report("cost_records"), 100)
    rounded = [F.round(F.col(c).cast("double"), 4).alias(c) for c in ("credits_used", "cost_usd")]
    return rows.select("warehouse_name", *rounded, "service_type")


@query("st_07_events_without_id", "SELECT COUNT(*) AS n FROM events")
def _(t):
    """Facts without id stay apart, and a repeated append adds none."""
    store = _store(t)
    rows = t["events"].select(F.lit(None).cast("string").alias("id"), F.col("event_id").cast("string").alias("dataset_id"))
    for _ in range(2):
        store.append_new("dataset_events", rows)
    return store.read("dataset_events").agg(F.count("*").alias("n"))
