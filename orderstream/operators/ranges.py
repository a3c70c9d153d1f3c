"""Time-range filters. Each compares the bare column, so Parquet can skip row groups.

A table that also carries `order_date` gets the matching date predicate, which prunes whole
partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderstream.functions.times import AsOf, back, hour_of_day, moment, plus, start_of_hour

Shift = Callable[[Column], Column]


def since(orders: DataFrame, as_of: AsOf, start: Shift, ts: str = "ts") -> DataFrame:
    """From a moment on, with no upper bound."""
    if "order_date" in orders.columns:
        orders = orders.where(F.col("order_date") >= moment(as_of, lambda c: start(c).cast("date")))
    return orders.where(F.col(ts) >= moment(as_of, start))


def between(orders: DataFrame, as_of: AsOf, start: Shift, end: Shift, ts: str = "ts") -> DataFrame:
    """Half-open range between two moments."""
    orders = since(orders, as_of, start, ts)
    if "order_date" in orders.columns:
        last = moment(as_of, lambda c: (end(c) - F.expr("interval 1 microsecond")).cast("date"))
        orders = orders.where(F.col("order_date") <= last)
    return orders.where(F.col(ts) < moment(as_of, end))


def in_hour(orders: DataFrame, as_of: AsOf, hour: int | None = None, ts: str = "ts") -> DataFrame:
    """Half-open hour on the UTC day of `as_of`; the current hour unless one is given."""
    start = start_of_hour if hour is None else hour_of_day(hour)
    return between(orders, as_of, start, plus(start, "1 hour"), ts)


def trailing(orders: DataFrame, as_of: AsOf, span: str, ts: str = "ts") -> DataFrame:
    """From `span` before `as_of`, with no upper bound: orders dated ahead are included."""
    return since(orders, as_of, back(span), ts)


def fresh(documents: DataFrame, as_of: AsOf) -> DataFrame:
    """Documents that have not expired; no expiry means they never do."""
    return documents.where(F.col("expires_at").isNull() | (F.col("expires_at") > moment(as_of)))
