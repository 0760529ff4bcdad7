"""Failure events to recovery decisions, a whole backlog at a time."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepulse.config import HIGH, LOW, HealConfig
from tablepulse.functions.times import seconds_between

# Failure types in order of precedence with the words that mark them.
KEYWORDS = {
    "CONNECTION": ["snowflake", "kafka", "timeout", "connection", "socket",
                   "network", "refused", "broker", "ssl", "tls"],
    "QUALITY": ["null", "duplicate", "schema", "type mismatch", "quality",
                "completeness", "freshness", "range", "validation"],
    "DRIFT": ["drift", "distribution", "psi", "ks_test", "shift", "evidently"],
}
OTHER = "SYSTEM"
RETRY, QUARANTINE = "retry", "quarantine"
RESOLVED, FAILED, ESCALATED = "RESOLVED", "FAILED", "ESCALATED"
# Topic that a retried failure is sent to.
RETRY_TOPICS = {"CONNECTION": "quality.events", "SYSTEM": "quality.events", "DRIFT": "drift.events"}


def failure_type(lowered: Column) -> Column:
    """First type with a word that occurs in the lower-case reason; no reason means SYSTEM."""
    out = F.when(lowered.isNull(), F.lit(OTHER))
    for name, words in KEYWORDS.items():
        out = out.when(reduce(or_, [lowered.contains(w) for w in words]), F.lit(name))
    return out.otherwise(F.lit(OTHER))


def classify(failures: DataFrame, reason: str = "failure_reason") -> DataFrame:
    """Adds ``failure_type``; the reason is put into lower case once for all words."""
    lowered = failures.withColumn("_lowered", F.lower(reason))
    return lowered.withColumn("failure_type", failure_type(F.col("_lowered"))).drop("_lowered")


def strategy(kind: Column) -> Column:
    return F.when(kind == "QUALITY", F.lit(QUARANTINE)).otherwise(F.lit(RETRY))


def decide(failures: DataFrame, config: HealConfig = HealConfig()) -> DataFrame:
    """Type, strategy, outcome and final run status of every failure event.

    Input: ``event_id, dataset_id, failure_reason, retry_count`` and optionally
    ``pipeline_run_id``, ``failed_task``, ``detected_at`` and ``resolved_at``.  A decision
    whose target is not known (a retry without run, a quarantine without data set) cannot
    be carried out: it fails.
    """
    def optional(name: str, kind: str) -> Column:
        return F.col(name) if name in failures.columns else F.lit(None).cast(kind)

    retry = (F.col("healing_strategy") == RETRY) & (F.col("retry_count") < config.max_retries)
    exhausted = (F.col("healing_strategy") == RETRY) & (F.col("retry_count") >= config.max_retries)
    done = F.col("recovery_status") == RESOLVED
    if not config.resolved_wins:
        done = done & ~F.col("quarantined")
    return (
        classify(failures)
        .withColumns(
            {
                "pipeline_run_id": optional("pipeline_run_id", "string"),
                "failed_task": optional("failed_task", "string"),
                "detected_at": optional("detected_at", "timestamp_ntz"),
                "resolved_at": optional("resolved_at", "timestamp_ntz"),
                "retry_count": F.coalesce("retry_count", F.lit(0)),
            }
        )
        .withColumn("healing_strategy", strategy(F.col("failure_type")))
        .withColumns(
            {
                "retried": retry,
                "quarantined": ~retry,
                "possible": F.when(retry, F.col("pipeline_run_id").isNotNull()).otherwise(F.col("dataset_id").isNotNull()),
            }
        )
        .withColumn(
            "recovery_status",
            F.when(exhausted, F.lit(ESCALATED)).when(F.col("possible"), F.lit(RESOLVED)).otherwise(F.lit(FAILED)),
        )
        .withColumn(
            "final_status",
            F.when(done, F.lit("success"))
            .when(F.col("quarantined"), F.lit("quarantined"))
            .otherwise(F.lit("failed")),
        )
    )


def actions(decided: DataFrame) -> DataFrame:
    """Two or three action rows per event, numbered in order.

    An action succeeds if what it changes is known: the run, the data set or the topic.
    """
    known_run, known_dataset = F.col("pipeline_run_id").isNotNull(), F.col("dataset_id").isNotNull()

    def action(kind: str, done: Column, *detail: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("action_type"),
            F.concat(*detail).alias("action_detail"),
            done.alias("success"),
        )

    run = F.coalesce("pipeline_run_id", F.lit(""))
    reason = F.coalesce("failure_reason", F.lit(""))
    retried = F.array(
        action("UPDATE_PIPELINE_STATUS", known_run, F.lit("run "), run, F.lit(" marked as healing")),
        action("EMIT_RECOVERY_EVENT", F.lit(True), F.lit("asked for a retry after a failure of type "), F.col("failure_type")),
    )
    exhausted = F.array(
        action(
            "QUARANTINE_AFTER_MAX_RETRIES", known_dataset, F.lit("held back, tried again "), F.col("retry_count").cast("string"), F.lit(" times")
        )
    )
    quarantined = F.array(
        action(
            "QUARANTINE_DATASET",
            known_dataset,
            F.lit("data set "),
            F.coalesce("dataset_id", F.lit("")),
            F.lit(" held back: "),
            reason,
        )
    )
    last = F.array(action("UPDATE_PIPELINE_FINAL_STATUS", known_run, F.lit("run ends as "), F.col("final_status")))
    first = (
        F.when(F.col("retried"), retried)
        .when(F.col("recovery_status") == ESCALATED, exhausted)
        .otherwise(quarantined)
    )
    return decided.select("event_id", F.posexplode(F.concat(first, last)).alias("action_no", "action")).select(
        "event_id", (F.col("action_no") + 1).alias("action_no"), "action.*"
    )


def action_count() -> Column:
    return F.when(F.col("retried"), 3).otherwise(2)


def succeeded_count() -> Column:
    """How many of the actions of an event can be carried out."""
    run, dataset = F.col("pipeline_run_id").isNotNull().cast("int"), F.col("dataset_id").isNotNull().cast("int")
    return F.when(F.col("retried"), 1 + 2 * run).otherwise(run + dataset)


def heal_summary(decided: DataFrame, with_origin: bool = False) -> DataFrame:
    """One summary row per event; the repair time runs from detection to resolution.

    ``with_origin`` adds the failed task and the time of detection.
    """
    mttr = F.round(seconds_between(F.col("detected_at"), F.col("resolved_at")).cast("double"), 4)
    return decided.select(
        "event_id",
        "dataset_id",
        "pipeline_run_id",
        "failure_type",
        F.coalesce("failure_reason", F.lit("")).alias("failure_reason"),
        "healing_strategy",
        "recovery_status",
        "retry_count",
        mttr.alias("mttr_seconds"),
        action_count().alias("actions_taken"),
        succeeded_count().alias("actions_succeeded"),
        "quarantined",
        F.when(F.col("recovery_status") == ESCALATED, F.lit(HIGH)).otherwise(F.lit(LOW)).alias("severity"),
        *[c for c in ("failed_task", "detected_at") if with_origin],
    )


def dataset_status_events(decided: DataFrame) -> DataFrame:
    """Status event of each dataset that goes into quarantine."""
    return decided.filter(F.col("quarantined") & F.col("dataset_id").isNotNull()).select(
        "dataset_id", F.lit("quarantined").alias("status"), F.col("detected_at").alias("event_ts"), "event_id"
    )


def run_status_events(decided: DataFrame, run: str = "pipeline_run_id") -> DataFrame:
    """Status events of the runs: the retry mark and the final status, in that order."""
    steps = F.filter(
        F.array(F.when(F.col("retried"), F.lit("healing")), F.col("final_status")), lambda status: status.isNotNull()
    )
    return decided.filter(F.col(run).isNotNull()).select(
        F.col(run).alias("run_id"),
        F.posexplode(steps).alias("step", "status"),
        F.col("detected_at").alias("event_ts"),
        "event_id",
    )


def current_status(events: DataFrame, key: str, *order: str) -> DataFrame:
    """Latest status per key."""
    return events.groupBy(key).agg(F.max_by("status", F.struct(*order)).alias("status"))


def recovery_events(decided: DataFrame) -> DataFrame:
    """Events to send for retried failures, with their topic and payload."""
    topic = F.element_at(F.create_map(*[F.lit(x) for kv in RETRY_TOPICS.items() for x in kv]), F.col("failure_type"))
    payload = F.to_json(
        F.struct(
            F.lit("self_healing_retry").alias("trigger"),
            F.col("pipeline_run_id"),
            F.col("failure_type"),
        ),
        {"ignoreNullFields": "false"},
    )
    return decided.filter("retried").select(
        "event_id", "dataset_id", topic.alias("topic"), payload.alias("payload")
    )
