"""Comparison of two snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compared(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every key of either snapshot with both sets of values and a status.

    A null key meets a null key. Both sides are hash-partitioned by the same keys, so aggregates on
    these keys are joined where they already are.
    """
    a = before.select(*[F.col(k).alias(f"{k}_a") for k in keys], *[F.col(v).alias(f"{v}_before") for v in values], F.lit(True).alias("in_before"))
    b = after.select(*[F.col(k).alias(f"{k}_b") for k in keys], *[F.col(v).alias(f"{v}_after") for v in values], F.lit(True).alias("in_after"))
    same = reduce(lambda x, y: x & y, [F.col(f"{v}_before").eqNullSafe(F.col(f"{v}_after")) for v in values])
    status = (
        F.when(F.col("in_before").isNull(), "added")
        .when(F.col("in_after").isNull(), "removed")
        .when(same, "same")
        .otherwise("changed")
    )
    meet = reduce(lambda x, y: x & y, [F.col(f"{k}_a").eqNullSafe(F.col(f"{k}_b")) for k in keys])
    both = a.join(b, meet, "full_outer")
    shown = [F.coalesce(f"{k}_a", f"{k}_b").alias(k) for k in keys]
    return both.select(*shown, *[f"{v}_before" for v in values], *[f"{v}_after" for v in values], status.alias("status"))


def changed_only(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Only what has to be sent on: keys that were added, removed or have a different value."""
    return compared(before, after, keys, values).where(F.col("status") != "same")
