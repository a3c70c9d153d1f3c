"""Writers for the snapshot documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderstream.operators.recent import last_arrived
from orderstream.schemas import RECENT_TTL
from orderstream.sinks.batches import write_batch


def overwrite_hourly(documents: DataFrame, root: str) -> None:
    """Replaces the documents of the hours present, and only those."""
    (
        documents.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("hour_start")
        .parquet(root)
    )


def overwrite_top(names: DataFrame, root: str, updated_at: Column) -> None:
    """Replaces the top list; it never expires."""
    stamped = names.withColumns({"updated_at": updated_at, "expires_at": F.lit(None).cast("timestamp")})
    stamped.write.mode("overwrite").parquet(root)


def overwrite_recent(orders: DataFrame, root: str, updated_at: Column) -> None:
    """Replaces the list of recent orders; it expires after two hours without an update."""
    stamped = orders.withColumns(
        {"updated_at": updated_at, "expires_at": updated_at + F.expr(f"interval {RECENT_TTL}")}
    )
    stamped.write.mode("overwrite").parquet(root)


def roll_recent(batch: DataFrame, previous: DataFrame, root: str, batch_id: int, n: int = 10) -> None:
    """The last n orders to arrive, over the list of the batch before and this batch.

    The update time is the newest order time of the list, so only orders renew the expiry.
    """
    columns = ["arrival", "id", "drink", "store", "price", "ts"]
    merged = last_arrived(previous.select(*columns).unionByName(batch.select(*columns)), n)
    updated_at = F.max("ts").over(Window.partitionBy())  # n rows
    stamped = merged.withColumn("updated_at", updated_at).withColumn(
        "expires_at", F.col("updated_at") + F.expr(f"interval {RECENT_TTL}")
    )
    write_batch(stamped, root, batch_id)


def rolled_recent(log: DataFrame) -> DataFrame:
    """The stored rolling list: the one of the newest batch that has any rows."""
    return log.where(F.col("batch_id") == log.agg(F.max("batch_id").alias("b")).scalar()).orderBy("arrival")
