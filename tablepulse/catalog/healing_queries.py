"""Failure classification and recovery over the error events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepulse.catalog import query
from tablepulse.catalog.tables import EVENTS_END
from tablepulse.config import HealConfig
from tablepulse.operators import healing
from tablepulse.sources import facts

TYPE = """
    ft AS (SELECT *, CASE WHEN failure_reason IS NULL THEN 'SYSTEM'
        WHEN regexp_matches(lower(failure_reason), 'snowflake|kafka|timeout|connection|socket|network|refused|broker|ssl|tls') THEN 'CONNECTION'
        WHEN regexp_matches(lower(failure_reason), 'null|duplicate|schema|type mismatch|quality|completeness|freshness|range|validation') THEN 'QUALITY'
        WHEN regexp_matches(lower(failure_reason), 'drift|distribution|psi|ks_test|shift|evidently') THEN 'DRIFT' ELSE 'SYSTEM' END AS failure_type,
        detected_at + INTERVAL 1 HOUR * retry_count AS resolved_at FROM v_failures)"""
DECIDED = f"""
    {TYPE}, g AS (SELECT *, CASE WHEN failure_type = 'QUALITY' THEN 'quarantine' ELSE 'retry' END AS healing_strategy FROM ft),
    h AS (SELECT *, healing_strategy = 'retry' AND retry_count < 2 AS retried, NOT (healing_strategy = 'retry' AND retry_count < 2) AS quarantined,
        CASE WHEN healing_strategy = 'retry' AND retry_count >= 2 THEN 'ESCALATED' ELSE 'RESOLVED' END AS recovery_status FROM g),
    de AS (SELECT *, CASE WHEN quarantined THEN 'quarantined' ELSE 'success' END AS final_status FROM h)"""
ACTIONS = f"""
    {DECIDED}, ac AS (
        SELECT event_id, 1 AS action_no, 'UPDATE_PIPELINE_STATUS' AS action_type, concat('run ', pipeline_run_id, ' marked as healing') AS action_detail FROM de WHERE retried
        UNION ALL SELECT event_id, 2, 'EMIT_RECOVERY_EVENT', concat('asked for a retry after a failure of type ', failure_type) FROM de WHERE retried
        UNION ALL SELECT event_id, 1, 'QUARANTINE_AFTER_MAX_RETRIES', concat('held back, tried again ', CAST(retry_count AS VARCHAR), ' times') FROM de WHERE recovery_status = 'ESCALATED'
        UNION ALL SELECT event_id, 1, 'QUARANTINE_DATASET', concat('data set ', dataset_id, ' held back: ', failure_reason) FROM de WHERE failure_type = 'QUALITY'
        UNION ALL SELECT event_id, CASE WHEN retried THEN 3 ELSE 2 END, 'UPDATE_PIPELINE_FINAL_STATUS', concat('run ends as ', final_status) FROM de)"""


def _failures(t):
    return t["v_failures"].withColumn("resolved_at", F.expr("detected_at + make_dt_interval(0, retry_count)"))


def _decided(t):
    return healing.decide(_failures(t))


@query("he_01_failure_types", f"WITH {TYPE} SELECT event_id, failure_type FROM ft")
def _(t):
    return healing.classify(t["v_failures"]).select("event_id", "failure_type")


@query("he_01_types_of_texts", f"""
    SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'snowflake|kafka|timeout|connection|socket|network|refused|broker|ssl|tls') THEN 'CONNECTION'
        WHEN regexp_matches(lower(text), 'null|duplicate|schema|type mismatch|quality|completeness|freshness|range|validation') THEN 'QUALITY'
        WHEN regexp_matches(lower(text), 'drift|distribution|psi|ks_test|shift|evidently') THEN 'DRIFT' ELSE 'SYSTEM' END AS failure_type FROM documents""")
def _(t):
    return healing.classify(t["documents"], "text").select("doc_id", "failure_type")


@query("he_02_strategies", f"WITH {DECIDED} SELECT event_id, healing_strategy FROM de")
def _(t):
    return healing.classify(t["v_failures"]).select("event_id", healing.strategy(F.col("failure_type")).alias("healing_strategy"))


@query("he_03_retry_gate", f"WITH {DECIDED} SELECT event_id, retried, quarantined, recovery_status FROM de")
def _(t):
    return _decided(t).select("event_id", "retried", "quarantined", "recovery_status")


@query("he_04_final_status", f"WITH {DECIDED} SELECT event_id, final_status FROM de")
def _(t):
    return _decided(t).select("event_id", "final_status")


@query("he_04_final_status_resolved_wins", f"""
    WITH {DECIDED} SELECT event_id, CASE WHEN recovery_status = 'RESOLVED' THEN 'success' ELSE 'quarantined' END AS final_status FROM de""")
def _(t):
    return healing.decide(_failures(t), HealConfig(resolved_wins=True)).select("event_id", "final_status")


@query("he_05_actions", f"WITH {ACTIONS} SELECT *, TRUE AS success FROM ac")
def _(t):
    return healing.actions(_decided(t))


@query("he_06_action_counts", f"""
    WITH {ACTIONS} SELECT ac.event_id, CAST(COUNT(*) AS INT) AS actions_taken, CAST(COUNT(*) AS INT) AS actions_succeeded,
        ANY_VALUE(de.retry_count) * 3600.0e0 AS mttr_seconds FROM ac JOIN de ON ac.event_id = de.event_id GROUP BY 1""")
def _(t):
    return healing.heal_summary(_decided(t)).select("event_id", "actions_taken", "actions_succeeded", "mttr_seconds")


@query("he_07_quarantined_datasets", f"""
    WITH {DECIDED} SELECT dataset_id, 'quarantined' AS status, COUNT(*) AS events FROM de WHERE quarantined GROUP BY dataset_id""")
def _(t):
    return healing.dataset_status_events(_decided(t)).groupBy("dataset_id", "status").agg(F.count("*").alias("events"))


@query("he_08_run_status", f"WITH {DECIDED} SELECT pipeline_run_id AS run_id, final_status AS status FROM de")
def _(t):
    events = healing.run_status_events(_decided(t))
    return healing.current_status(events, "run_id", "event_ts", "event_id", "step")


@query("he_08_dataset_run_status", f"""
    WITH {DECIDED} SELECT dataset_id AS run_id, arg_max(final_status, (detected_at, event_id)) AS status FROM de GROUP BY dataset_id""")
def _(t):
    events = healing.run_status_events(_decided(t), "dataset_id")
    return healing.current_status(events, "run_id", "event_ts", "event_id", "step")


@query("he_09_recovery_events", f"""
    WITH {DECIDED} SELECT event_id, dataset_id, CASE WHEN failure_type = 'DRIFT' THEN 'drift.events' ELSE 'quality.events' END AS topic,
        concat('{{"trigger":"self_healing_retry","pipeline_run_id":"', pipeline_run_id, '","failure_type":"', failure_type, '"}}') AS payload FROM de WHERE retried""")
def _(t):
    return healing.recovery_events(_decided(t))


@query("he_10_summary", f"""
    WITH {DECIDED} SELECT event_id, dataset_id, pipeline_run_id, failure_type, COALESCE(failure_reason, '') AS failure_reason, healing_strategy, recovery_status,
        retry_count, retry_count * 3600.0e0 AS mttr_seconds, CASE WHEN retried THEN 3 ELSE 2 END AS actions_taken, CASE WHEN retried THEN 3 ELSE 2 END AS actions_succeeded,
        quarantined, CASE WHEN recovery_status = 'ESCALATED' THEN 'high' ELSE 'low' END AS severity FROM de""")
def _(t):
    return healing.heal_summary(_decided(t))


@query("snk_09_heal_runs", f"""
    WITH {DECIDED} SELECT event_id AS id, failure_type, recovery_status, retry_count, retry_count * 3600.0e0 AS mttr_seconds, TIMESTAMP '{EVENTS_END}' AS created_at FROM de""")
def _(t):
    decided = _decided(t)
    at = F.lit(EVENTS_END).cast("timestamp_ntz")
    rows = facts.heal_facts(healing.heal_summary(decided), healing.actions(decided), at)["heal_runs"]
    return rows.select(
        "id", "failure_type", "recovery_status", "retry_count", F.col("mttr_seconds").cast("double").alias("mttr_seconds"), "created_at"
    )
