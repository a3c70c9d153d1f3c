"""Rates over a sliding range, one point per step.

Rows are first counted per step, and only those counts are spread over the ranges they belong to.
The fact rows are never multiplied by the overlap of the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sliding_sums(
    df: DataFrame, keys: list[str], measures: dict[str, Column], range_minutes: int = 5, step_minutes: int = 1
) -> DataFrame:
    """Sums over `[sample_ts - range, sample_ts)` for every step whose range has rows."""
    per_step = df.groupBy(F.window("ts", f"{step_minutes} minutes").end.alias("step_end"), *keys).agg(
        *[m.alias(name) for name, m in measures.items()]
    )
    offsets = F.array(*[F.lit(i * step_minutes) for i in range(range_minutes // step_minutes)])
    spread = per_step.withColumn("later", F.explode(offsets)).withColumn(
        "sample_ts", F.col("step_end") + F.make_interval(mins=F.col("later"))
    )
    return spread.groupBy("sample_ts", *keys).agg(*[F.sum(name).alias(name) for name in measures])


def per_second(total: Column, range_minutes: int = 5) -> Column:
    return total.cast("double") / F.lit(range_minutes * 60.0)


def request_rate(requests: DataFrame, range_minutes: int = 5, step_minutes: int = 1) -> DataFrame:
    """Requests per second by endpoint and method."""
    sums = sliding_sums(requests, ["endpoint", "method"], {"n": F.count("*")}, range_minutes, step_minutes)
    return sums.select("sample_ts", "endpoint", "method", per_second(F.col("n"), range_minutes).alias("rate"))


def items_per_minute(orders: DataFrame, range_minutes: int = 5, step_minutes: int = 1) -> DataFrame:
    """Orders per minute by item."""
    sums = sliding_sums(orders, ["drink"], {"n": F.count("*")}, range_minutes, step_minutes)
    return sums.select("sample_ts", "drink", (per_second(F.col("n"), range_minutes) * 60).alias("per_minute"))


def revenue_per_minute(orders: DataFrame, range_minutes: int = 5, step_minutes: int = 1) -> DataFrame:
    """Revenue per minute by store."""
    sums = sliding_sums(orders, ["store"], {"total": F.sum("price")}, range_minutes, step_minutes)
    return sums.select("sample_ts", "store", (per_second(F.col("total"), range_minutes) * 60).alias("per_minute"))
