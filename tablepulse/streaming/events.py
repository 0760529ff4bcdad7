"""Envelope streams: source, decoding, context, routing and delivery.

All transformations take batch and streaming DataFrames alike.  A restart replays
at most the last micro-batch; sinks are keyed by event id, so a replay adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablepulse.functions.names import event_table_name
from tablepulse.sources.envelopes import payload_field, unwrap, with_payload
from tablepulse.sources.facts import FactStore

# Payload fields of the messages.
INGESTION_FIELDS = [
    "dataset_id", "pipeline_run_id", "dataset_name", "schema_version", "rows_ingested", "rows_rejected",
]
JOB_FIELDS = [
    "dataset_id", "pipeline_run_id", "silver_table", "reference_table", "warehouse_name", "schema_version",
    "lookback_days", "failure_reason", "failed_task", "retry_count", "trigger",
]
Handler = Callable[[DataFrame, int], None]


# --- source ------------------------------------------------------------------

def kafka_options(servers: str, topic: str, max_events: int = 500) -> dict[str, str]:
    """Options of a bounded, resumable read of one topic from its beginning."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": str(max_events),
        "failOnDataLoss": "true",
    }


def read_kafka(spark: SparkSession, servers: str, topic: str, max_events: int = 500) -> DataFrame:
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, max_events)).load()


def read_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Messages from a folder of text files, one per line."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


# --- decoding and context ----------------------------------------------------

def split_malformed(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded envelopes and raw malformed messages."""
    decoded = unwrap(messages)
    good = decoded.filter(~F.col("_malformed")).drop("_raw", "_malformed")
    return good, decoded.filter("_malformed").select(F.col("_raw").alias("value"))


def _present(column: Column) -> Column:
    """NULL for an empty text, which counts as missing."""
    return F.when(column != "", column)


def ingestion_context(envelopes: DataFrame) -> DataFrame:
    """Ingestion events with defaults filled in; events without a data set are dropped."""
    name = F.coalesce(payload_field("dataset_name"), F.lit("unknown"))
    return with_payload(envelopes, INGESTION_FIELDS).select(
        "event_id",
        F.coalesce(_present(F.col("dataset_id")), _present(payload_field("dataset_id"))).alias("dataset_id"),
        F.coalesce(_present(payload_field("pipeline_run_id")), F.md5("event_id")).alias("pipeline_run_id"),
        name.alias("dataset_name"),
        event_table_name(name, "raw").alias("bronze_table"),
        event_table_name(name, "silver").alias("silver_table"),
        event_table_name(name, "gold").alias("gold_table"),
        F.coalesce(payload_field("schema_version", "int"), F.lit(1)).alias("schema_version"),
        F.coalesce(payload_field("rows_ingested", "bigint"), F.lit(0)).alias("rows_ingested"),
        F.coalesce(payload_field("rows_rejected", "bigint"), F.lit(0)).alias("rows_rejected"),
    ).filter(F.col("dataset_id").isNotNull())


def job_context(envelopes: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Job parameters of each event: envelope field, else payload field, else registry.

    ``registry`` is the batch of current data sets.  Spark picks the join from its
    size; no hint forces a broadcast of a registry that may have grown.
    """
    def text(name: str) -> Column:
        return _present(payload_field(name))

    events = with_payload(envelopes, JOB_FIELDS).select(
        "event_id",
        "topic",
        "published_at",
        F.coalesce(_present(F.col("dataset_id")), text("dataset_id")).alias("dataset_id"),
        text("pipeline_run_id").alias("pipeline_run_id"),
        text("silver_table").alias("silver_table"),
        text("reference_table").alias("reference_table"),
        text("warehouse_name").alias("warehouse_name"),
        F.coalesce(payload_field("schema_version", "int"), F.lit(1)).alias("schema_version"),
        F.coalesce(payload_field("lookback_days", "int"), F.lit(7)).alias("lookback_days"),
        F.coalesce(payload_field("failure_reason"), F.lit("unknown failure")).alias("failure_reason"),
        text("failed_task").alias("failed_task"),
        F.coalesce(payload_field("retry_count", "int"), F.lit(0)).alias("retry_count"),
        F.coalesce(text("trigger"), F.col("topic")).alias("trigger"),
    )
    if registry is not None:
        known = registry.select("dataset_id", F.col("silver_table").alias("_registered"))
        events = (
            events.join(known, "dataset_id", "left")
            .withColumn("silver_table", F.coalesce("silver_table", _present(F.col("_registered"))))
            .drop("_registered")
        )
    return events.withColumn("reference_table", F.coalesce("reference_table", "silver_table"))


def dataset_totals(contexts: DataFrame) -> DataFrame:
    """Events and rows of a batch for every data set in it."""
    return contexts.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("rows_ingested").alias("rows_ingested"),
        F.sum("rows_rejected").alias("rows_rejected"),
    )


def topic_lag(offsets: DataFrame) -> DataFrame:
    """Messages still to read per topic, from low, high and committed offsets per partition."""
    start = F.greatest("low", F.coalesce("committed", F.col("low")))
    return offsets.groupBy("topic").agg(F.sum(F.greatest(F.lit(0), F.col("high") - start)).alias("lag"))


# --- delivery ----------------------------------------------------------------

def without_repeats(events: DataFrame, ts: str, delay: str = "1 hour") -> DataFrame:
    """Stream without events that repeat an id inside the watermark delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id"])


def append_once(store: FactStore, table: str, key: str = "id") -> Handler:
    """Batch handler that appends rows of unknown key only."""
    return lambda batch, batch_id: store.append_new(table, batch, key)


def enriched(handler: Handler, registry: Callable[[], DataFrame]) -> Handler:
    """Batch handler that passes on job parameters, by the registry as it stands when a batch begins.

    A stream joined with a fixed frame would keep the registry of its start.  A replayed batch may
    see a newer registry than the first attempt; sinks keyed by event id keep what was stored first.
    """
    return lambda batch, batch_id: handler(job_context(batch, registry()), batch_id)


def route(handlers: Mapping[str, Handler]) -> Handler:
    """Batch handler that passes the events of each topic to the handler of that topic."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for topic, handler in handlers.items():
                handler(batch.filter(F.col("topic") == topic), batch_id)
        finally:
            batch.unpersist()

    return handle


def drain(stream: DataFrame, handler: Handler, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available in bounded batches, then stop."""
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(handler)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_dead_letters(malformed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep malformed messages as text, for later inspection."""
    return (
        malformed.writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
