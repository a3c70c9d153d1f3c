"""Publishing orders as event records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderstream.functions.times import iso_text

# Producer settings of the order topic.
PRODUCER = {
    "kafka.acks": "all",
    "kafka.enable.idempotence": "true",
    "kafka.linger.ms": "5",
    "kafka.batch.size": "32768",
    "kafka.compression.type": "lz4",
}


def string_records(orders: DataFrame, version: str) -> DataFrame:
    """Flat records in which every field is text, plus the API version."""
    return orders.select(
        "message_id",
        "drink",
        "store",
        F.col("price").cast("string").alias("price"),
        iso_text(F.col("ts")).alias("timestamp"),
        F.lit(version).alias("version"),
    )


def keyed_records(orders: DataFrame, version: str) -> DataFrame:
    """`key, value`: JSON keyed by store, so the orders of a store stay in one topic partition."""
    fields = F.struct(
        "message_id",
        "drink",
        "store",
        F.col("price").cast("double").alias("price"),
        iso_text(F.col("ts")).alias("timestamp"),
        F.lit(version).alias("version"),
    )
    return orders.select(F.col("store").alias("key"), F.to_json(fields).alias("value"))


def publish_kafka(records: DataFrame, servers: str, topic: str, **options: str) -> None:
    """Writes keyed records to a topic. Needs the Kafka connector on the class path."""
    settings = {**PRODUCER, "kafka.bootstrap.servers": servers, "topic": topic, **options}
    records.write.format("kafka").options(**settings).save()


def publish_folder(records: DataFrame, path: str) -> None:
    """Appends records to a stream folder.

    Keyed records are laid out by key without being gathered by it: the broker orders a key, a
    folder does not need to, and one busy store must not become one task.
    """
    writer = records.write.mode("append")
    if "key" in records.columns:
        writer = writer.partitionBy("key")
    writer.parquet(path)
