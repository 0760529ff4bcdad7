"""Whole jobs on small files: versions, layers, facts, repeats."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.config import DriftConfig, HealConfig
from tablepulse.operators import cost, drift, healing, medallion
from tablepulse.plans import jobs
from tablepulse.sources.facts import SCHEMAS, FactStore, bronze_schema, gold_schema, silver_schema, struct
from tablepulse.sources.files import UnreadableFile

AT = "2024-01-01 00:00:00"


@pytest.fixture
def store(spark, tmp_path):
    return FactStore(spark, str(tmp_path / "facts"))


def upload(store, tmp_path, name, text, at=AT):
    path = tmp_path / name
    path.write_text(text)
    return jobs.ingest_file(store, str(path), "Sales Data", at)


def test_uploads_and_schema_versions(store, tmp_path):
    first = upload(store, tmp_path, "a.csv", "id,amount\n1,2.5\n2,3.5\n3,1.0\n")
    row = first.first()
    assert (row["is_new_dataset"], row["schema_version"], row["rows_ingested"]) == (True, 1, 3)
    assert row["bronze_table"] == "sales_data_raw"
    event = json.loads(jobs.upload_event(first).first()["value"])
    assert event["topic"] == "schema.events" and event["payload"]["rows_ingested"] == 3
    assert event["dataset_id"] == event["payload"]["dataset_id"] == row["dataset_id"]

    same = upload(store, tmp_path, "b.csv", "id,amount\n4,2.5\n", "2024-01-02 00:00:00").first()
    assert (same["is_new_dataset"], same["schema_version"], same["schema_changes"]) == (False, 1, None)

    changed = upload(store, tmp_path, "c.csv", "id,city\n5,Oslo\n", "2024-01-03 00:00:00").first()
    assert changed["schema_version"] == 2
    assert [(c["change_type"], c["column_name"]) for c in changed["schema_changes"]] == [
        ("ADD_COLUMN", "city"), ("DROP_COLUMN", "amount"),
    ]
    versions = {r["version"]: r["change_summary"] for r in store.read("schema_versions").collect()}
    assert versions == {1: "Initial schema (version 1)", 2: "ADD_COLUMN: city; DROP_COLUMN: amount"}
    assert [(r["name"], r["bronze_table"]) for r in jobs.datasets(store).collect()] == [("Sales Data", "sales_data_raw")]


def test_repeated_upload_adds_nothing(store, tmp_path):
    for _ in range(2):
        row = upload(store, tmp_path, "a.csv", "id,amount\n1,2.5\n2,3.5\n").first()
        assert row["rows_ingested"] == 2
    bronze = store.spark.read.parquet(jobs.layer_path(store, "bronze", "sales_data_raw", 1))
    assert bronze.count() == 2
    assert store.read("pipeline_runs").count() == 2  # opened and closed once


def test_malformed_records_go_to_quarantine_or_fail_the_run(store, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,amount\n1,2.5\nx,1.0\n3,4.0\n")
    columns = T.StructType.fromDDL("id int, amount double")
    row = jobs.ingest_file(store, str(path), "Kept", AT, file_schema=columns, keep_rejects=True).first()
    assert (row["rows_ingested"], row["rows_rejected"]) == (2, 1)
    with pytest.raises(UnreadableFile):
        jobs.ingest_file(store, str(path), "Strict", AT, file_schema=columns)
    runs = {r["status"] for r in store.read("pipeline_runs").collect()}
    assert {"running", "success"} <= runs


def test_failed_write_closes_the_run(store, tmp_path, monkeypatch):
    def broken(*args):
        raise OSError("disk full")

    monkeypatch.setattr(jobs, "_write_bronze", broken)
    with pytest.raises(OSError):
        upload(store, tmp_path, "a.csv", "id,amount\n1,2.5\n")
    failed = store.read("pipeline_runs").filter("status = 'failed'").first()
    assert failed["error_message"] == "disk full"


def test_layers(store, tmp_path):
    row = upload(store, tmp_path, "a.csv", "id,amount\n1,2.5\n1,2.5\n,\n2,4.0\n").first()
    columns = T.StructType.fromDDL("id int, amount double")
    for _ in range(2):
        jobs.bronze_to_silver(store, row["dataset_id"], "sales_data_raw", columns, row["pipeline_run_id"], AT)
        jobs.silver_to_gold(store, row["dataset_id"], "sales_data_silver", columns, row["pipeline_run_id"], AT, key="id")
    silver = store.spark.read.parquet(jobs.layer_path(store, "silver", "sales_data_silver", 1))
    # Equal rows of a file stay apart, the row of NULLs is kept and flagged.
    assert silver.count() == 4 and silver.filter("_is_quarantined").count() == 1
    entry = jobs.datasets(store).first()
    assert (entry["bronze_table"], entry["silver_table"], entry["gold_table"]) == ("sales_data_raw", "sales_data_silver", "sales_data_gold")
    gold = {r["_aggregation_key"]: r for r in store.spark.read.parquet(jobs.layer_path(store, "gold", "sales_data_gold", 1)).collect()}
    assert {k: (r["_row_count"], r["amount_sum"]) for k, r in gold.items()} == {"1": (2, 5.0), "2": (1, 4.0)}
    lineage = {r["target_layer"]: (r["rows_in"], r["rows_out"], r["rows_rejected"]) for r in store.read("dataset_lineage").collect()}
    assert lineage == {"SILVER": (4, 3, 1), "GOLD": (4, 2, 0)}


def test_layer_schemas():
    columns = T.StructType.fromDDL("id bigint, name string, score double")
    assert bronze_schema(columns).names[-3:] == ["id", "name", "score"]
    assert "_is_quarantined" in silver_schema(columns).names
    assert gold_schema(columns).names[-4:] == ["id_sum", "id_avg", "score_sum", "score_avg"]
    wide = T.StructType([T.StructField(f"c{i}", T.IntegerType()) for i in range(30)])
    assert len([n for n in gold_schema(wide).names if n.endswith("_sum")]) == 30


def test_quality_job(store):
    df = store.spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, s string")
    for _ in range(2):
        result = jobs.quality_job(store, df, "d1", "r1", "t_silver", AT).first()
    assert result["agent"] == "quality_agent" and result["status"] == "resolved"
    assert json.loads(result["details"])["total_rows"] == 3
    assert store.read("data_quality_metrics").count() == 1
    assert store.read("quality_metrics").count() == 4


def test_quality_job_skips_missing_and_empty_tables(store):
    assert jobs.quality_job(store, None, "d", "r", "t", AT).first()["status"] == "skipped"
    empty = store.spark.createDataFrame([], "k int")
    assert jobs.quality_job(store, empty, "d", "r", "t", AT).first()["status"] == "skipped"


def test_drift_job(store):
    rows = [(float(i % 7), side) for i in range(60) for side in (True, False)]
    sides = store.spark.createDataFrame(rows, "v double, _is_current boolean")
    result = jobs.drift_job(store, sides, "d1", "r1", "t_silver", AT).first()
    assert (result["status"], result["severity"]) == ("resolved", "low")
    assert store.read("drift_metrics").count() == 1 and store.read("drift_summary").count() == 1
    skipped = jobs.drift_job(store, sides, "d1", "r2", "t_silver", AT, config=DriftConfig(min_rows=1000)).first()
    assert skipped["status"] == "skipped"


def test_cost_job(store):
    usage = store.spark.createDataFrame(
        [("w1", "2023-12-30 01:00:00", 350.0, 10**9, "SUCCESS"), ("w1", "2023-12-30 02:00:00", 9.0, 1, "FAIL"),
         ("w2", "2023-12-31 01:00:00", 7.0, 0, "SUCCESS"), ("w2", "2023-12-01 01:00:00", 50.0, 0, "SUCCESS")],
        "warehouse_name string, start_time string, credits_used double, bytes_scanned bigint, execution_status string",
    ).withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
    runs = store.spark.createDataFrame([("a", AT)], "id string, started_at string").withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))
    results = {json.loads(r["details"])["warehouse_name"]: r for r in jobs.cost_job(store, usage, runs, "d", "r", AT).collect()}
    assert results["w1"]["severity"] == "medium" and results["w2"]["severity"] == "low"
    summary = {r["warehouse_name"]: r for r in store.read("cost_summary").collect()}
    assert float(summary["w1"]["total_usd"]) == 1050.0
    assert float(summary["w1"]["daily_avg_credits"]) == 50.0
    assert float(summary["w1"]["cost_score"]) == 50.0
    assert float(summary["w2"]["forecast_credits_30d"]) == 30.0
    forecast = {r["warehouse_name"]: r for r in store.read("cost_forecasts").collect()}
    assert float(forecast["w2"]["lower_bound"]) == 25.5 and str(forecast["w2"]["forecast_date"]) == "2024-01-31"


def test_cost_without_usage(spark):
    usage = spark.createDataFrame([], "warehouse_name string, start_time timestamp_ntz, credits_used double, bytes_scanned bigint, execution_status string")
    runs = spark.createDataFrame([], "id string, started_at timestamp_ntz")
    row = cost.cost_report(usage, runs, AT, group_by=()).first()
    assert (row["total_credits"], row["cost_score"], row["pipeline_run_count"]) == (0.0, 100.0, 1)


FAILURES = [
    ("e1", "d1", "r1", "Kafka broker down", 0), ("e2", "d1", "r2", "NULL values found", 0), ("e3", "d2", "r3", "PSI too high", 2),
    ("e4", "d2", "r4", None, 1), ("e5", None, None, "x" * 3000, 5), ("e6", "d3", "r6", "schema error: connection refused", None),
]


def test_heal_job(store):
    failures = store.spark.createDataFrame(FAILURES, "event_id string, dataset_id string, pipeline_run_id string, failure_reason string, retry_count int")
    for _ in range(2):
        results = jobs.heal_job(store, failures, AT).collect()
    assert len(results) == 6
    got = {r["id"]: r for r in store.read("heal_summary").collect()}
    assert {k: (r["failure_type"], r["recovery_status"]) for k, r in got.items()} == {
        "e1": ("CONNECTION", "RESOLVED"), "e2": ("QUALITY", "RESOLVED"), "e3": ("DRIFT", "ESCALATED"),
        "e4": ("SYSTEM", "RESOLVED"), "e5": ("SYSTEM", "ESCALATED"), "e6": ("CONNECTION", "RESOLVED"),
    }
    assert got["e5"]["actions_succeeded"] == 0 and got["e1"]["actions_succeeded"] == 3
    runs = {r["run_id"]: r["status"] for r in store.report("pipeline_runs").collect()}
    assert runs == {"r1": "success", "r2": "quarantined", "r3": "quarantined", "r4": "success", "r6": "success"}
    status = {r["dataset_id"]: r["status"] for r in jobs.datasets(store).collect()}
    assert status == {"d1": "quarantined", "d2": "quarantined"}
    sent = [json.loads(r["value"]) for r in store.read("outbox").collect()]
    assert sorted(e["event_id"] for e in sent) == ["e1", "e4", "e6"]
    assert {e["payload"]["trigger"] for e in sent} == {"self_healing_retry"}
    assert len(got["e5"]["failure_reason"]) > 2000
    assert store.read("heal_actions").count() == 3 + 2 + 2 + 3 + 2 + 3
    final = {r["event_id"]: r["final_status"] for r in healing.decide(failures).collect()}
    assert final["e2"] == "quarantined" and final["e1"] == "success" and final["e3"] == "quarantined"
    parity = {r["event_id"]: r["final_status"] for r in healing.decide(failures, HealConfig(resolved_wins=True)).collect()}
    assert parity["e2"] == "success" and parity["e3"] == "quarantined"


def test_failures_without_target_fail(store):
    rows = [("a", None, None, "timeout", 0), ("b", None, "r", "null values", 0), ("c", "d", "r", "timeout", 0)]
    failures = store.spark.createDataFrame(rows, "event_id string, dataset_id string, pipeline_run_id string, failure_reason string, retry_count int")
    assert {r["recovery_status"] for r in healing.decide(failures.limit(2)).collect()} == {"FAILED"}
    statuses = [r["status"] for r in jobs.heal_job(store, failures, AT).collect()]
    assert sorted(statuses) == ["failed", "failed", "resolved"]


def test_close_rows_stay_apart(spark):
    rows = [("r", "2024-01-01 00:00:00.0001", 1, 5), ("r", "2024-01-01 00:00:00.0009", 1, 5), ("r", "2024-01-01 00:00:00", None, 5),
            ("r", "2024-01-01 00:00:00", None, 6)]
    bronze = spark.createDataFrame(rows, "_pipeline_run_id string, _loaded_at string, _row_number bigint, a int")
    bronze = bronze.withColumn("_loaded_at", F.col("_loaded_at").cast("timestamp_ntz"))
    assert medallion.silver_additions(bronze, medallion.to_silver(bronze).limit(0)).count() == 4
    plain = bronze.select("_pipeline_run_id", F.col("_loaded_at").alias("t"))
    assert medallion.silver_additions(plain, medallion.to_silver(plain).limit(0)).count() == 3


def test_upload_after_a_partial_write(store, tmp_path):
    text = "id,amount\n" + "".join(f"{i},{i}.5\n" for i in range(50))
    row = upload(store, tmp_path, "a.csv", text).first()
    bronze = jobs.layer_path(store, "bronze", row["bronze_table"], 1)
    kept = store.spark.read.parquet(bronze).limit(10).collect()
    part = store.spark.createDataFrame(kept, store.spark.read.parquet(bronze).schema)
    part.write.mode("overwrite").partitionBy("_pipeline_run_id").parquet(bronze)
    again = upload(store, tmp_path, "a.csv", text).first()
    assert again["rows_ingested"] == 50 and store.spark.read.parquet(bronze).count() == 50


def test_promoted_types_are_stored(store, tmp_path):
    text = "".join(json.dumps({"code": str(i), "day": "01/07/2024", "ok": "yes", "name": f"n{i}"}) + "\n" for i in range(3))
    row = upload(store, tmp_path, "a.jsonl", text).first()
    bronze = store.spark.read.parquet(jobs.layer_path(store, "bronze", row["bronze_table"], 1))
    kinds = {f.name: f.dataType.simpleString() for f in bronze.schema.fields if not f.name.startswith("_")}
    assert kinds == {"code": "bigint", "day": "timestamp_ntz", "ok": "boolean", "name": "string"}
    data = bronze.select("code", "day", "ok", "name")
    result = jobs.quality_job(store, data, row["dataset_id"], "r", "t", AT).first()
    assert float(json.loads(result["details"])["type_mismatch_rate"]) == 0.0


def test_facts_without_id_are_kept(store):
    rows = store.spark.createDataFrame([(None, "d1"), (None, "d2"), ("x", "d3")], "id string, dataset_id string")
    for _ in range(2):
        store.append_new("dataset_events", rows)
    assert sorted(r["dataset_id"] for r in store.read("dataset_events").collect()) == ["d1", "d2", "d3"]


def test_reports_read_the_written_facts(store, tmp_path):
    from tablepulse.plans import reports

    upload(store, tmp_path, "a.csv", "id,amount\n1,2.5\n")
    runs = store.report("pipeline_runs")
    assert runs.count() == 1 and reports.recent_runs(runs, 5).first()["status"] == "success"
    assert reports.cost_history(store.report("cost_records")).count() == 0


def test_silver_key_falls_back_to_content(spark):
    bronze = spark.createDataFrame([("r", 1, None), ("r", 1, None), ("r", None, 1)], "_pipeline_run_id string, a int, b int")
    silver = medallion.to_silver(bronze)
    assert silver.select("_row_key").distinct().count() == 2
    assert medallion.silver_additions(bronze, silver.limit(0)).count() == 2
    assert medallion.silver_additions(bronze, silver).count() == 0


def test_rows_without_load_time_are_inserted_once(spark):
    bronze = spark.createDataFrame([("r", None, 1, 5)], "_pipeline_run_id string, _loaded_at timestamp_ntz, _row_number bigint, a int")
    silver = medallion.silver_additions(bronze, medallion.to_silver(bronze).limit(0))
    assert silver.first()["_is_quarantined"]
    assert medallion.silver_additions(bronze, silver).count() == 0


@pytest.mark.parametrize("table", sorted(SCHEMAS))
def test_missing_fact_table_reads_as_empty(store, table):
    df = store.read(table)
    assert df.count() == 0 and df.schema.names == struct(SCHEMAS[table]).names


def test_gold_sums_do_not_overflow(spark):
    big = 2**62
    silver = spark.createDataFrame([("r", False, 1.0, big)] * 5, "_pipeline_run_id string, _is_quarantined boolean, _quality_score double, a bigint")
    assert int(medallion.to_gold(silver).first()["a_sum"]) == 5 * big


def test_p_value_of_huge_windows(spark):
    n = F.lit(10**12)
    row = spark.range(1).select(drift.ks_p_value(F.lit(1e-9), n, n).alias("same"), drift.ks_p_value(F.lit(0.01), n, n).alias("other")).first()
    assert (row["same"], row["other"]) == (1.0, 0.0)


def test_drift_windows_of_one_small_table_overlap(spark):
    df = spark.range(10).select("id", F.timestamp_seconds("id").alias("ts"))
    rows = drift.side_rows(drift.newest_and_oldest(df, "ts", n=25_000)).first()
    assert (rows["current_rows"], rows["reference_rows"]) == (10, 10)


def test_upload_reads_its_file_for_the_landing_table_only(store, tmp_path, monkeypatch):
    """Once the records have landed, the file is not needed any more."""
    own = jobs.read_file

    def read_and_remove(spark, path, *args, **options):
        rows = own(spark, path, *args, **options)
        (tmp_path / "a.csv").unlink()
        return rows

    monkeypatch.setattr(jobs, "read_file", read_and_remove)
    row = upload(store, tmp_path, "a.csv", 'id,note\n1,"two\nlines"\n2,plain\n').first()
    bronze = store.spark.read.parquet(jobs.layer_path(store, "bronze", "sales_data_raw", 1))
    assert row["rows_ingested"] == 2 and sorted(r.note for r in bronze.collect()) == ["plain", "two\nlines"]
    assert not [c for c in bronze.columns if c in ("_file", "_row_no")]


def test_equal_rows_of_a_file_have_ids_of_their_own(store, tmp_path):
    upload(store, tmp_path, "a.csv", "id,amount\n" + "1,2.5\n" * 50)
    bronze = store.spark.read.parquet(jobs.layer_path(store, "bronze", "sales_data_raw", 1))
    assert bronze.select("_ingestion_id").distinct().count() == 50


def test_silver_adds_nothing_after_a_reload_with_other_splits(store, tmp_path):
    text = "id,amount\n" + "".join(f"{i},2.5\n" for i in range(300))
    columns = T.StructType.fromDDL("id int, amount double")
    before = store.spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("200", "1000000"):
        store.spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            row = upload(store, tmp_path, "a.csv", text).first()
        finally:
            store.spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        jobs.bronze_to_silver(store, row["dataset_id"], "sales_data_raw", columns, row["pipeline_run_id"], AT)
    assert store.spark.read.parquet(jobs.layer_path(store, "silver", "sales_data_silver", 1)).count() == 300


def test_a_run_without_rows_replaces_what_was_left(store, tmp_path):
    row = upload(store, tmp_path, "a.csv", "id,amount\n1,2.5\n").first()
    folder = jobs.layer_path(store, "bronze", "sales_data_raw", 1)
    left = store.spark.read.parquet(folder)
    jobs._replace_run(store.spark.createDataFrame([], left.schema), folder, row["pipeline_run_id"])
    assert store.spark.read.schema(left.schema).parquet(folder).count() == 0


def test_outbox_keeps_what_could_not_be_sent(store, tmp_path):
    upload(store, tmp_path, "a.csv", "id,amount\n1,2.5\n")

    def fails(messages):
        raise OSError("no broker")

    with pytest.raises(OSError):
        jobs.send_outbox(store, fails, AT)
    seen = []
    send = lambda messages: seen.extend(messages.collect())
    assert jobs.send_outbox(store, send, AT).first()["messages"] == 1
    jobs.send_outbox(store, send, "2024-01-02 00:00:00")
    assert len(seen) == 1 and json.loads(seen[0]["value"])["payload"]["rows_ingested"] == 1
