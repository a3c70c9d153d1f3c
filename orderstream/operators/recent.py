"""Newest-first scans and recent-order lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderstream.functions.times import AsOf, iso_text
from orderstream.operators.ranges import trailing


def newest_first(orders: DataFrame) -> DataFrame:
    return orders.orderBy(F.col("ts").desc(), F.col("id").desc())


def recent_orders(orders: DataFrame, as_of: AsOf, n: int = 50, span: str = "1 hour") -> DataFrame:
    """The newest n orders of the trailing span. Sort and limit run as one bounded top-n per task."""
    return newest_first(trailing(orders, as_of, span)).limit(n).select("id", "drink", "store", "price", "ts")


def last_arrived(orders: DataFrame, n: int = 10) -> DataFrame:
    """The n orders that arrived last, oldest of them first."""
    return orders.orderBy(F.col("arrival").desc()).limit(n).orderBy("arrival")


def serialized(orders: DataFrame) -> DataFrame:
    """Orders in their published form: a double price and ISO text for the time."""
    return orders.select(
        "id", "drink", "store", F.col("price").cast("double").alias("price"), iso_text(F.col("ts")).alias("timestamp")
    )
