"""Envelopes and streams: malformed, repeated and late events, restarts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tablepulse.plans import reports
from tablepulse.sources import envelopes
from tablepulse.sources.facts import SCHEMAS, FactStore
from tablepulse.streaming import events, windows


def message(event_id, dataset_id=None, topic="quality.events", **payload):
    return json.dumps({"event_id": event_id, "topic": topic, "dataset_id": dataset_id, "published_at": "2024-01-01", "payload": payload})


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_wrap_and_unwrap(spark):
    rows = spark.createDataFrame([("e1", None, '{"a": 1, "b": null}'), ("e2", "d", '{"t": "x}y"}'), ("e3", "", None)], "event_id string, dataset_id string, payload string")
    wrapped = envelopes.wrap(rows, F.lit("t"), F.col("payload"), F.lit("2024")).collect()
    assert [r["key"] for r in wrapped] == ["e1", "d", "e3"]
    assert json.loads(wrapped[0]["value"])["payload"] == {"a": 1, "b": None}
    assert json.loads(wrapped[1]["value"])["payload"] == {"t": "x}y"}
    assert json.loads(wrapped[2]["value"])["payload"] is None
    back = envelopes.unwrap(lines(spark, *[r["value"] for r in wrapped])).collect()
    assert [(r["event_id"], r["_malformed"]) for r in back] == [("e1", False), ("e2", False), ("e3", False)]


@pytest.mark.parametrize("text", ["{", "", "[1]", "5", '"x"', "null", "not json"])
def test_malformed(spark, text):
    good, bad = events.split_malformed(lines(spark, text, message("e1", "d")))
    assert [r["event_id"] for r in good.collect()] == ["e1"]
    assert [r["value"] for r in bad.collect()] == [text]


def test_contexts(spark):
    good, _ = events.split_malformed(
        lines(
            spark,
            message("e1", "d1", dataset_name="My-Set", schema_version=4, rows_ingested=10),
            message("e2", None, **{"pipeline_run_id": "r2", "rows_ingested": "oops"}).replace('"payload": {', '"payload": {"dataset_id": "d2", '),
            message("e3"),
        )
    )
    got = {r["event_id"]: r for r in events.ingestion_context(good).collect()}
    assert set(got) == {"e1", "e2"}
    assert (got["e1"]["silver_table"], got["e1"]["schema_version"], got["e1"]["rows_ingested"]) == ("my_set_silver", 4, 10)
    assert (got["e2"]["dataset_id"], got["e2"]["pipeline_run_id"], got["e2"]["schema_version"], got["e2"]["rows_ingested"]) == ("d2", "r2", 1, 0)
    registry = spark.createDataFrame([("d1", "one_silver"), ("d2", "")], "dataset_id string, silver_table string")
    jobs = {r["event_id"]: r for r in events.job_context(good, registry).collect()}
    assert jobs["e1"]["silver_table"] == jobs["e1"]["reference_table"] == "one_silver"
    assert jobs["e2"]["silver_table"] is None and jobs["e3"]["dataset_id"] is None
    assert jobs["e3"]["failure_reason"] == "unknown failure" and jobs["e3"]["lookback_days"] == 7


def test_lag(spark):
    offsets = spark.createDataFrame([("t", 0, 10, 4), ("t", 5, 10, 2), ("t", 0, 3, None), ("u", 0, 5, 9)], "topic string, low bigint, high bigint, committed bigint")
    assert {r["topic"]: r["lag"] for r in events.topic_lag(offsets).collect()} == {"t": 6 + 5 + 3, "u": 0}


def test_kafka_options():
    options = events.kafka_options("host:9092", "quality.events", 500)
    assert options["subscribe"] == "quality.events" and options["maxOffsetsPerTrigger"] == "500"
    assert options["startingOffsets"] == "earliest"


def drain(spark, root, handler, max_files=1):
    good, _ = events.split_malformed(events.read_lines(spark, f"{root}/in", max_files))
    query = events.drain(good, handler, f"{root}/state")
    query.awaitTermination()
    return query


def test_routing_restart_and_repeats(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = FactStore(spark, str(tmp_path / "facts"))

    def record(batch, batch_id):
        rows = events.job_context(batch).select(F.col("event_id").alias("id"), "dataset_id", F.col("topic").alias("notes"))
        store.append_new("dataset_lineage", rows)

    handler = events.route({"quality.events": record, "drift.events": record})
    (folder / "1.txt").write_text("\n".join([message("e1", "d1"), "{broken", message("e2", "d1", "drift.events"), message("e9", "d1", "other")]))
    drain(spark, tmp_path, handler)
    # A new run of the same stream only sees new files; e2 is delivered again.
    (folder / "2.txt").write_text("\n".join([message("e2", "d1", "drift.events"), message("e3", "d2"), message("e3", "d2")]))
    drain(spark, tmp_path, handler)
    drain(spark, tmp_path, handler)
    got = sorted((r["id"], r["notes"]) for r in store.read("dataset_lineage").collect())
    assert got == [("e1", "quality.events"), ("e2", "drift.events"), ("e3", "quality.events")]


def test_replayed_batch_adds_nothing(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    batch = spark.createDataFrame([("a",), ("b",)], "id string")
    handler = events.append_once(store, "dataset_lineage")
    handler(batch, 7)
    handler(batch, 7)
    assert store.read("dataset_lineage").count() == 2


def test_dead_letters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("\n".join(["{broken", message("e1", "d")]))
    _, bad = events.split_malformed(events.read_lines(spark, str(tmp_path / "in")))
    events.write_dead_letters(bad, str(tmp_path / "dead"), str(tmp_path / "dead_state")).awaitTermination()
    assert [r["value"] for r in spark.read.text(str(tmp_path / "dead")).collect()] == ["{broken"]


def test_repeats_inside_the_watermark(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([("e1", "2024-01-01 00:00:00"), ("e1", "2024-01-01 00:10:00"), ("e2", "2024-01-01 00:20:00")], "event_id string, ts string")
    rows.coalesce(1).write.json(str(source))
    stream = spark.readStream.schema("event_id string, ts timestamp").json(str(source))
    out = str(tmp_path / "out")
    query = (
        events.without_repeats(stream, "ts").writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == ["e1", "e2"]


def test_windows_count_late_rows_until_the_watermark(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(*rows):
        spark.createDataFrame(rows, "ts string, v double").coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema("ts timestamp, v double").json(source)
        metrics = windows.window_metrics(stream, "ts", ["v"], late="30 minutes")
        windows.start_window_metrics(metrics, out, state).awaitTermination()

    arrive(("2024-01-01 00:01:00", 1.0), ("2024-01-01 00:02:00", None), ("2024-01-01 00:40:00", 1.0))
    arrive(("2024-01-01 00:12:00", None))  # late, inside the allowance
    arrive(("2024-01-01 03:00:00", 1.0))
    arrive(("2024-01-01 00:03:00", 1.0))  # too late
    got = {r["window_start"].isoformat(): (r["total_rows"], r["v_nulls"]) for r in windows.read_window_metrics(spark, out).collect()}
    assert got == {"2024-01-01T00:00:00": (3, 2), "2024-01-01T00:30:00": (1, 0), "2024-01-01T03:00:00": (1, 0)}


def test_reports_on_empty_facts(spark):
    empty = {t: spark.createDataFrame([], SCHEMAS[t]) for t in SCHEMAS}
    health = reports.overall_health(empty["data_quality_metrics"], empty["cost_summary"], empty["heal_summary"], empty["drift_summary"]).first()
    # No drift row counts as 50 points of 20 percent.
    assert (health["score"], health["label"], health["any_data"]) == (10.0, "At Risk", False)
    kpis = reports.quality_kpis(empty["data_quality_metrics"]).first()
    assert kpis["total_runs"] == 0 and kpis["pass_rate"] is None
    assert reports.run_kpis(empty["pipeline_runs"], "2024-01-01").first()["success_rate"] is None
    assert reports.cost_kpis(empty["cost_summary"], empty["cost_forecasts"], "2024-01-01").first()["total_credits"] is None
    assert reports.task_timeline is not None and reports.heal_kpis(empty["heal_summary"]).first()["total"] == 0


def test_health_points_by_severity(spark):
    empty = {t: spark.createDataFrame([], SCHEMAS[t]) for t in ("data_quality_metrics", "cost_summary", "heal_summary")}
    for severity, detected, score in [("low", True, 14.0), ("HIGH", True, 2.0), ("odd", True, 6.0), ("HIGH", False, 20.0)]:
        drift = spark.createDataFrame([("a", severity, detected)], "id string, drift_severity string, drift_detected boolean").withColumns(
            {"drift_score": F.lit(0.5), "drifted_columns": F.lit(1), "total_columns": F.lit(2), "drift_pct": F.lit(50.0), "evaluated_at": F.lit("2024-01-01")}
        )
        assert reports.overall_health(empty["data_quality_metrics"], empty["cost_summary"], empty["heal_summary"], drift).first()["score"] == score


def test_jobs_of_a_batch(spark, tmp_path):
    from tablepulse.operators import drift
    from tablepulse.plans import jobs
    from tablepulse.streaming import handlers

    at = "2024-01-02 00:00:00"
    store = FactStore(spark, str(tmp_path / "facts"))
    jobs.register_dataset(store, "d1", at, name="one", silver_table="one_silver", is_active=True)
    table = spark.range(100).select((F.col("id") % 7).alias("v"), F.timestamp_seconds("id").alias("ts"))
    usage = spark.createDataFrame([("w", 5.0, 10, "SUCCESS")], "warehouse_name string, credits_used double, bytes_scanned bigint, execution_status string")
    usage = usage.withColumn("start_time", F.lit("2024-01-01").cast("timestamp_ntz"))
    runs = spark.createDataFrame([], SCHEMAS["pipeline_runs"])
    route = events.route(
        {
            "quality.events": handlers.quality_handler(store, lambda name: table if name == "one_silver" else None, at),
            "drift.events": handlers.drift_handler(store, lambda a, b: drift.split_by_time(table, "ts", "1970-01-01 00:00:50"), at),
            "cost.events": handlers.cost_handler(store, usage, runs, at),
            "heal.commands": handlers.heal_handler(store, at),
        }
    )
    (tmp_path / "in").mkdir()
    sent = [
        message("e1", "d1", pipeline_run_id="r1"),
        message("e2", "d1", pipeline_run_id="r1"),
        message("e3", "unknown"),
        message("e4", "d1", "drift.events", pipeline_run_id="r1"),
        message("e5", "d1", "cost.events", lookback_days=3),
        message("e6", "d1", "heal.commands", failure_reason="socket closed", retry_count=1),
    ]
    (tmp_path / "in" / "1.txt").write_text("\n".join(sent))
    drain(spark, tmp_path, route)
    quality = store.read("data_quality_metrics").collect()
    assert [(r["dataset_id"], r["silver_table"], r["total_rows"]) for r in quality] == [("d1", "one_silver", 100)] * 2  # one result per request
    assert store.read("drift_summary").first()["total_columns"] == 1
    assert store.read("cost_summary").first()["lookback_days"] == 3
    assert [(r["id"], r["failure_type"]) for r in store.read("heal_summary").collect()] == [("e6", "CONNECTION")]


def test_late_and_undated_rows_are_counted_apart(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(*rows):
        spark.createDataFrame(rows, "ts string, v double").coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema("ts timestamp, v double").json(source)
        windows.start_counted_windows(stream, "ts", ["v"], out, state, late="30 minutes", keep_late=True).awaitTermination()

    arrive(("2024-01-01 00:01:00", 1.0), ("2024-01-01 00:40:00", None), (None, 5.0))
    arrive(("2024-01-01 00:12:00", None))  # the window ends after 00:40 less 30 minutes
    arrive(("2024-01-01 03:00:00", 1.0))
    arrive(("2024-01-01 00:03:00", 7.0), ("2024-01-01 02:31:00", 1.0))
    rows = windows.read_counted_windows(spark, out).collect()
    got = {(r["window_start"] and r["window_start"].isoformat()[11:16], r["arrival"]): (r["total_rows"], r["v_nulls"]) for r in rows}
    assert got == {
        ("00:00", "on_time"): (2, 1), ("00:30", "on_time"): (1, 1), ("03:00", "on_time"): (1, 0), ("02:30", "on_time"): (1, 0),
        ("00:00", "late"): (1, 0), (None, "undated"): (1, 0),
    }
    assert sorted((r["v"], r["arrival"]) for r in spark.read.parquet(f"{out}/rows").collect()) == [(5.0, "undated"), (7.0, "late")]


def test_handler_of_an_enriched_batch(spark):
    batch = spark.createDataFrame([("e1", "d1"), ("e2", None)], "event_id string, dataset_id string").withColumns(
        {c: F.lit(None).cast("string") for c in ("topic", "published_at", "payload")}
    )
    seen, state = [], ["one"]
    handler = events.enriched(
        lambda rows, batch_id: seen.append({r["event_id"]: r["silver_table"] for r in rows.collect()}),
        lambda: spark.createDataFrame([("d1", state[0])], "dataset_id string, silver_table string"),
    )
    handler(batch, 0)
    state[0] = "two"
    handler(batch, 1)
    assert seen == [{"e1": "one", "e2": None}, {"e1": "two", "e2": None}]


def test_requests_of_one_table_share_a_scan(spark, tmp_path):
    from tablepulse.operators import drift
    from tablepulse.plans import jobs
    from tablepulse.streaming import handlers

    at = "2024-01-02 00:00:00"
    store, single = FactStore(spark, str(tmp_path / "facts")), FactStore(spark, str(tmp_path / "single"))
    table = spark.range(100).select((F.col("id") % 7).alias("v"), F.timestamp_seconds("id").alias("ts"))
    sides = drift.split_by_time(table, "ts", "1970-01-01 00:00:50")
    loaded = []

    def load(*names):
        loaded.append(names)
        return {"a": table, "b": sides, "empty": table.limit(0)}.get(names[0])

    sent = [message(f"e{i}", "d1", pipeline_run_id=f"r{i}", silver_table="a") for i in range(30)]
    sent += [message("x", "d1", silver_table="gone"), message("y", "d1", silver_table="empty")]
    good, _ = events.split_malformed(lines(spark, *sent))
    for _ in range(2):  # a replayed batch adds nothing
        handlers.quality_handler(store, load, at)(good, 0)
    assert sorted(loaded) == sorted([("a",), ("gone",), ("empty",)] * 2)
    assert store.read("data_quality_metrics").count() == 30 and store.read("quality_metrics").count() == 30 * 4

    loaded.clear()
    good, _ = events.split_malformed(lines(spark, *[message(f"e{i}", "d1", "drift.events", pipeline_run_id="r", silver_table="b") for i in range(20)]))
    handlers.drift_handler(store, load, at, ts="ts")(good, 0)
    assert loaded == [("b", "b")]
    assert store.read("drift_summary").count() == store.read("drift_metrics").count() == 20
    limits = store.read("drift_runs").select(*drift.WINDOW_LIMITS).distinct().collect()
    assert [[v.isoformat()[-8:] for v in r] for r in limits] == [["00:00:00", "00:00:49", "00:00:50", "00:01:39"]]

    # The facts are those of the jobs for one request.
    published = "2024-01-01 00:00:00"
    jobs.quality_job(single, table, "d1", "r3", "a", published, request="e3")
    jobs.drift_job(single, sides, "d1", "r", "b", published, request="e3", ts="ts")
    for name in ("data_quality_metrics", "drift_runs", "drift_summary"):
        one = single.read(name).first()
        assert store.read(name).filter(F.col("id") == one["id"]).first() == one


def test_known_facts_are_not_broadcast(spark, tmp_path):
    """What a fact table holds already grows with its history, however well it compresses."""
    from tablepulse.operators.relational import rows_not_in

    store = FactStore(spark, str(tmp_path / "facts"))
    rows = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("d").alias("dataset_id"))
    store.append_new("dataset_lineage", rows)
    plans = []
    store.append = lambda table, new: plans.append(new)
    store.append_new("dataset_lineage", rows)
    plans.append(rows_not_in(rows, store.read("dataset_lineage"), ["id", "dataset_id"]))
    for new in plans:
        assert new.count() == 0
        assert "BroadcastHashJoin" not in new._jdf.queryExecution().executedPlan().toString()
