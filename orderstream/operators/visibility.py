"""When does an order become visible on the dashboard?

An order is visible at the first refresh after it whose order count exceeds the count the
dashboard showed when the order was placed. Both depend only on which gap between two refreshes the
order falls into, so that is worked out on the refreshes, of which there is one per refresh period,
and each order then looks up its gap by an equality join on a time bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderstream.operators.nextgreater import next_greater
from orderstream.session import work_dir

MICROS = 1_000_000


def _div(micros: Column, unit: int) -> Column:
    """Whole units, in integer arithmetic."""
    return F.call_function("div", micros, F.lit(unit).cast("bigint"))


def refresh_gaps(refreshes: DataFrame, wait_seconds: int, folder: str) -> DataFrame:
    """Per gap `[from_us, to_us)` before a refresh: when an order placed in it becomes visible.

    That is the first later refresh with a greater count than the one the gap begins with, however
    many refreshes lie between. Before the first refresh the dashboard shows no orders.
    """
    wait = wait_seconds * MICROS
    own = refreshes.select(F.unix_micros("refresh_ts").alias("at"), F.col("order_count").cast("bigint").alias("value"))
    start = own.agg((F.min("at") - wait - 1).alias("at")).where("at is not null").withColumn("value", F.lit(0).cast("bigint"))
    # An order placed longer before the refresh than the wait has timed out anyway.
    return next_greater(own.unionByName(start), folder).where("following > at").select(
        F.greatest("at", F.col("following") - wait).alias("from_us"), F.col("following").alias("to_us"), F.col("greater").alias("visible_us")
    )


def visibility(
    orders: DataFrame, refreshes: DataFrame, wait_seconds: int, salts: int = 16, folder: str | None = None
) -> DataFrame:
    """Each order with its latency in milliseconds, or `timed_out`. The folder (by default a working one) keeps the gaps.

    Gaps are cut at the wait, so each covers at most three buckets. They are few next to the orders
    and are repeated once per salt, which spreads a bucket that holds a large part of all orders.
    """
    wait = wait_seconds * MICROS
    last = _div(F.col("to_us") - 1, wait)
    buckets = (
        refresh_gaps(refreshes, wait_seconds, folder or work_dir(orders.sparkSession, "gaps"))
        .withColumn("bucket", F.explode(F.sequence(_div(F.col("from_us"), wait), last)))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .withColumn("salt", F.col("salt").cast("bigint"))
    )
    placed = orders.withColumn("at_us", F.unix_micros("ts")).withColumns(
        {"bucket": _div(F.col("at_us"), wait), "salt": F.pmod(F.xxhash64("id"), F.lit(salts))}
    )
    inside = (F.col("o.at_us") >= F.col("g.from_us")) & (F.col("o.at_us") < F.col("g.to_us"))
    same = (F.col("o.bucket") == F.col("g.bucket")) & (F.col("o.salt") == F.col("g.salt"))
    joined = placed.alias("o").join(buckets.alias("g"), same & inside, "left_outer")
    waited = F.col("g.visible_us") - F.col("o.at_us")
    seen = F.coalesce(waited <= wait, F.lit(False))
    return joined.select(
        *[F.col(f"o.{c}") for c in orders.columns],
        F.when(seen, waited / F.lit(1000.0)).alias("latency_ms"),
        (~seen).alias("timed_out"),
    )


def as_requests(seen: DataFrame, version: str, wait_seconds: int) -> DataFrame:
    """Latencies in request-log form, so that they are summarised like any other request.

    Orders that were never seen form a series of their own, at the full wait.
    """
    name = f"e2e_latency_{version}"
    late = F.col("timed_out")
    return seen.select(
        "ts",
        F.lit("E2E").alias("method"),
        F.when(late, f"{name}_timeout").otherwise(name).alias("name"),
        F.lit(None).cast("int").alias("status_code"),
        F.when(late, F.lit(float(wait_seconds))).otherwise(F.col("latency_ms") / 1000.0).alias("duration_s"),
        F.lit(0).cast("bigint").alias("bytes"),
        F.when(late, f"order not visible after {wait_seconds} s").alias("error"),
    )
