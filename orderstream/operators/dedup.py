"""Insert-if-absent by message id.

A null id never conflicts with anything, so rows without one are grouped by their arrival instead:
each stays a group of its own, and they spread over the tasks. Copies of one id collapse before the
shuffle, so an id that holds a large part of a batch costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = ["message_id", "lone"]


def _lone(df: DataFrame) -> DataFrame:
    return df.withColumn("lone", F.when(F.col("message_id").isNull(), F.col("arrival")).otherwise(F.lit(-1)))


def first_of_each(orders: DataFrame) -> DataFrame:
    """One row per message id: the one that arrived first."""
    columns = orders.columns
    row = F.min_by(F.struct(*columns), "arrival")
    return _lone(orders).groupBy(*_KEY).agg(row.alias("row")).select("row.*")


def known_ids(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The ids of the target table that also occur in the batch.

    Reads one column of the target. The ids of a batch are few, so Spark broadcasts them once it
    has measured them and the target is never shuffled; a backfill too big for that falls back to
    a shuffle join, with one row per id on the batch side.
    """
    wanted = batch.where(F.col("message_id").isNotNull()).select("message_id").distinct()
    return target.select("message_id").where(F.col("message_id").isNotNull()).join(wanted, "message_id", "left_semi")


def insertable(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Per distinct message id of the batch: the row that arrived first, `copies`, and `is_new`.

    Known ids and batch rows meet in one aggregation rather than a join: a single shuffle, with
    partial aggregation on both sides.
    """
    columns = batch.columns
    stored = known.select("message_id", F.lit(-1).cast("bigint").alias("lone"), F.lit(True).alias("stored"))
    arriving = _lone(batch).select(*_KEY, F.lit(False).alias("stored"), F.struct(*columns).alias("row"))
    groups = (
        arriving.unionByName(stored, allowMissingColumns=True)
        .groupBy(*_KEY)
        .agg(
            F.min_by(F.col("row"), F.when(~F.col("stored"), F.col("row.arrival"))).alias("row"),
            F.count_if(~F.col("stored")).alias("copies"),
            F.bool_or("stored").alias("known"),
        )
    )
    return groups.where(F.col("copies") > 0).select("row.*", "copies", (~F.col("known")).alias("is_new"))


def insert_if_absent(batch: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of the batch to insert: first arrivals whose id is not stored yet."""
    return insertable(batch, known).where("is_new").drop("copies", "is_new")


def outcome(groups: DataFrame) -> DataFrame:
    """Inserted rows, and rows skipped as duplicates of a stored row or of each other."""
    inserted = F.count_if(F.col("is_new"))
    return groups.agg(
        inserted.alias("inserted"), (F.coalesce(F.sum("copies"), F.lit(0)) - inserted).cast("bigint").alias("skipped")
    )
