"""Triage results as keyed JSON messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

# Delivery settings of the result topic.
TOPIC_OPTIONS = {"kafka.acks": "all", "kafka.retries": "5", "kafka.compression.type": "gzip"}


def keyed_messages(results: DataFrame, event_id: str = "event_id") -> DataFrame:
    """``key`` = event id, ``value`` = JSON of the id and all result columns."""
    rest = [c for c in results.columns if c != event_id]
    body = F.to_json(F.struct(F.col(event_id).alias("event_id"), *rest), {"ignoreNullFields": "false"})
    return results.select(F.col(event_id).cast("string").alias("key"), body.alias("value"))


def write_topic(messages: DataFrame, servers: str, topic: str) -> None:
    """Publish a batch; needs Spark's Kafka package on the cluster."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(
        **TOPIC_OPTIONS
    ).save()


def topic_stream(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """A writer that publishes a stream; delivery is at least once, so consumers deduplicate by key."""
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .options(**TOPIC_OPTIONS)
    )


def file_stream(messages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The same messages as JSON files, exactly once."""
    return (
        messages.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
