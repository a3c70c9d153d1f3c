"""Removing repeated messages from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(orders: DataFrame, delay: str = "1 hour", salts: int = 8) -> DataFrame:
    """The first row of each message id; later copies within the watermark delay are dropped.

    Rows without an id are all kept and pass by the state, which holds ids only, each for the delay.

    A streaming deduplication sends every copy of an id to one task. So copies are first reduced in
    `salts` places, dealt out by their arrival, and only the survivors meet: one id may make up a
    large part of the stream. A row's place does not depend on how its batch was read. The first
    stage holds an id up to `salts` times; with `salts=0` there is none.
    """
    marked = orders.withWatermark("ts", delay)
    with_id = marked.where(F.col("message_id").isNotNull())
    if salts:
        salted = with_id.withColumn("salt", F.pmod(F.xxhash64("arrival"), F.lit(salts)))
        with_id = salted.dropDuplicatesWithinWatermark(["message_id", "salt"]).drop("salt")
    return with_id.dropDuplicatesWithinWatermark(["message_id"]).unionByName(marked.where(F.col("message_id").isNull()))
