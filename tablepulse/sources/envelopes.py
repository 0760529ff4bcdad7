"""Event envelopes: writing and decoding ``{event_id, topic, dataset_id, published_at, payload}``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Topics of the platform.
TOPICS = ["raw.data.events", "schema.events", "quality.events", "drift.events", "cost.events", "heal.commands"]
ENVELOPE = "event_id string, topic string, dataset_id string, published_at string, payload string"


def wrap(events: DataFrame, topic: Column, payload: Column, published_at: Column, key: Column | None = None) -> DataFrame:
    """``(key, value)`` messages of events with ``event_id`` and ``dataset_id``.

    The payload is JSON text and goes in as it is.  The key is the first of the given
    key, the data set and the event that is neither NULL nor empty.
    """
    def present(column: Column) -> Column:
        return F.when(column != "", column)

    header = F.to_json(
        F.struct(
            "event_id", topic.alias("topic"), "dataset_id", published_at.alias("published_at")
        ),
        {"ignoreNullFields": "false"},
    )
    opened = F.left(header, F.length(header) - 1)
    value = F.concat(opened, F.lit(',"payload":'), F.coalesce(payload, F.lit("null")), F.lit("}"))
    candidates = [c for c in (key, F.col("dataset_id"), F.col("event_id")) if c is not None]
    return events.select(
        topic.alias("topic"), F.coalesce(*[present(c) for c in candidates]).alias("key"), value.alias("value")
    )


def publish_kafka(messages: DataFrame, servers: str) -> None:
    """Send wrapped messages, each to its topic; needs the Kafka connector on the class path."""
    messages.select("topic", "key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def publish_text(messages: DataFrame, path: str) -> None:
    """Append wrapped messages to a folder of text files, one message per line."""
    messages.select("value").write.mode("append").text(path)


def unwrap(messages: DataFrame, value: str = "value") -> DataFrame:
    """Envelope columns of messages; ``_malformed`` marks values that are no JSON object."""
    text = F.col(value).cast("string")
    parsed = F.from_json(
        text, f"{ENVELOPE}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    bad = F.col("_e").isNull() | F.col("_e._corrupt").isNotNull()
    return (
        messages.select(text.alias("_raw"), parsed.alias("_e"))
        .select("_raw", bad.alias("_malformed"), "_e.*")
        .drop("_corrupt")
    )


def with_payload(envelopes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Adds ``_p``, a struct of payload fields as text; an absent field is NULL.

    The payload is parsed once for all fields.
    """
    # The explicit option keeps Spark from splitting the parse by field.
    schema = ", ".join(f"{name} string" for name in fields)
    return envelopes.withColumn("_p", F.from_json("payload", schema, {"mode": "PERMISSIVE"}))


def payload_field(name: str, kind: str = "string") -> Column:
    """A field of the parsed payload, NULL when it is absent or does not convert."""
    return F.col(f"_p.{name}").try_cast(kind)
