"""Order event streams: a Kafka topic, or a folder of records in the same shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a Kafka record as Spark delivers it.
KAFKA_RECORD = "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP"


def kafka_options(servers: str, topic: str, resume: bool, max_offsets: int | None = None) -> dict[str, str]:
    """Source options.

    `resume` starts a first run at the earliest offset; without it a first run sees only new
    records. A restart always continues from the checkpoint.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest" if resume else "latest",
    }
    if max_offsets is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def kafka_stream(spark: SparkSession, servers: str, topic: str, resume: bool = True, max_offsets: int | None = None):
    """Streaming read of a topic. Needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, resume, max_offsets)).load()


def folder_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Streaming read of a folder (or a glob) of record files."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


# A position holds the offset and a place, the number of the topic's partition, in one long.
PLACES = 1 << 23


def position(offset: Column, place: Column) -> Column:
    """Ordered by offset, unique over all places; what does not fit fails the query rather than share a position."""
    fits = (place >= 0) & (place < PLACES) & (offset >= 0) & (offset < 1 << 40)
    failed = F.raise_error(F.lit("a record's topic, partition or offset has no position of its own")).cast("long")
    return F.when(fits, offset.cast("long") * PLACES + place).otherwise(failed)


def arrival_of(partition: Column, offset: Column, topic: Column, topics: tuple[str, ...]) -> Column:
    """Position of a record of one of the listed topics, told apart by their place in the list.

    The list must stay as it is for the life of the stream; `topics.Topics` keeps a growing one. A
    topic that is not listed fails the query, and so do PLACES partitions or more over all topics.
    """
    number = F.array_position(F.array(*map(F.lit, topics)), topic) - 1
    place = partition.cast("long") * len(topics) + number
    return position(offset, F.when((number >= 0) & (partition >= 0), place))


def kafka_text(records: DataFrame, topics: tuple[str, ...]) -> DataFrame:
    """`arrival, value, ingest_ts` from Kafka-shaped records of the listed topics, bytes decoded as UTF-8."""
    return records.select(
        arrival_of(F.col("partition"), F.col("offset"), F.col("topic"), topics).alias("arrival"),
        F.col("value").cast("string").alias("value"),
        F.col("timestamp").alias("ingest_ts"),
    )
