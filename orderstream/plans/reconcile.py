"""Streaming results against a batch recomputation."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderstream.operators.diffing import compared
from orderstream.operators.metrics import hour_items, hourly_documents
from orderstream.sinks.snapshots import overwrite_hourly
from orderstream.streaming.ingest import Store, current_hour_items

_KEYS = ["hour_start", "drink"]
_VALUES = ["order_count", "revenue"]


def reconcile(streamed: DataFrame, orders: DataFrame) -> DataFrame:
    """Every hour and item with the streamed and the recomputed figures, and whether they agree."""
    return compared(streamed, hour_items(orders), _KEYS, _VALUES)


def drifted_hours(comparison: DataFrame) -> DataFrame:
    return comparison.where("status <> 'same'").select("hour_start").distinct()


def repair(comparison: DataFrame, orders: DataFrame, hourly_root: str) -> None:
    """Rewrites the documents of the drifted hours from the orders.

    An hour that no order is left in gets a document of zeros that has expired, so readers miss it.
    """
    hours = drifted_hours(comparison)
    first, last = hours.agg(F.min("hour_start"), F.max("hour_start")).first()
    if first is None:
        return
    # Literal bounds reach the files; the join then leaves the drifted hours.
    near = orders.where((F.col("ts") >= F.lit(first)) & (F.col("ts") < F.lit(last + timedelta(hours=1))))
    drifted = near.join(hours, F.date_trunc("hour", near["ts"]) == hours["hour_start"], "left_semi")
    documents = hourly_documents(hour_items(drifted))
    gone = hours.join(documents.select("hour_start"), "hour_start", "left_anti").select(
        "hour_start",
        F.array().cast("array<string>").alias("top_drinks"),
        F.lit(0).cast("decimal(20,2)").alias("revenue"),
        F.lit(0).cast("bigint").alias("order_count"),
        F.create_map().cast("map<string,bigint>").alias("drink_counts"),
        F.col("hour_start").alias("updated_at"),
        F.col("hour_start").alias("expires_at"),
    )
    overwrite_hourly(documents.unionByName(gone), hourly_root)


def drift(spark: SparkSession, store: Store, since: datetime | None = None, upto: int | None = None) -> DataFrame:
    """The hourly figures an ingest keeps against its order table, from an hour on; both read only that range.

    `upto` leaves the orders of later batches out.
    """
    orders, hours = store.table(spark, "orders"), current_hour_items(store, spark)
    if upto is not None:
        orders = orders.where(F.col("batch_id") <= upto)
    if since is not None:
        orders, hours = orders.where(F.col("ts") >= F.lit(since)), hours.where(F.col("hour_start") >= F.lit(since))
    return compared(hours, hour_items(orders), _KEYS, [*_VALUES, "last_ts"])


def correct(spark: SparkSession, store: Store, name: str, since: datetime | None = None) -> str:
    """Brings the hourly figures of an ingest into line with its order table, once for a name.

    The drifted hours are voided up to the newest batch and recomputed; hours without orders are
    gone. `since` must be the start of an hour. Returns the state of the correction
    (`Levels.state_of`): `absent` if nothing has drifted, `overtaken` if a batch came in between; it
    is then to be repeated under another name.
    """
    levels = store.hours()
    last, state = levels.manifest(spark), levels.state_of(spark, name)
    if last is None or state != "absent":
        return state
    found = drift(spark, store, since, last.batch_id)
    folder = f"{levels.root}/drift/{name}"
    found.write.mode("overwrite").parquet(folder)
    found = spark.read.schema(found.schema).parquet(folder)
    drifted = drifted_hours(found)
    if drifted.isEmpty():
        return "absent"
    right = found.where(F.col("order_count_after").isNotNull()).join(drifted, "hour_start", "left_semi")
    rows = right.select(*_KEYS, *[F.col(f"{v}_after").alias(v) for v in (*_VALUES, "last_ts")])
    return levels.correct(spark, name, drifted, rows, last)
