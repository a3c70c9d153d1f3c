"""Running totals and row numbers over a whole table, without pulling it into one task.

Row numbers work on ranges that Spark samples from the ordering value: however sparse the values
are, the ranges have about the same number of rows. Inside a range a row's place is known from the
sorted partition; across ranges only one row per range is summed.

Running totals over a dense value, such as ticks, cut it into chunks of a bounded stretch instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits of a row's place inside its partition, as Spark's increasing ids have them.
_PLACE_BITS = 33


def running_totals(df: DataFrame, order: str, measures: list[str], stretch: int) -> DataFrame:
    """Replaces each measure by its running total up to and including the row.

    `order` is a long, unique per row and dense, so `stretch` bounds the rows of a chunk and a table
    has few of them. Integer division: a double would merge neighbouring values beyond 2^53.
    """
    chunked = df.withColumn("chunk", F.expr(f"{order} div {stretch}"))
    across = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        chunked.groupBy("chunk")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select("chunk", *[F.coalesce(F.sum(m).over(across), F.lit(0)).alias(f"{m}_before") for m in measures])
    )
    within = Window.partitionBy("chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = chunked.withColumns({m: F.sum(m).over(within) for m in measures})
    totals = {m: F.col(m) + F.col(f"{m}_before") for m in measures}
    return inside.join(before, "chunk").withColumns(totals).select(*df.columns)


def ranged(df: DataFrame, order: str, folder: str) -> DataFrame:
    """The rows in sorted ranges, written below the folder, with `spot`: the range and the place in it.

    The input is evaluated once, and the ranges are fixed by what is written: another sample cannot
    shift them between counting and numbering.
    """
    sorted_ = df.repartitionByRange(order).sortWithinPartitions(order)
    spotted = sorted_.withColumn("spot", F.monotonically_increasing_id())
    spotted.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(spotted.schema).parquet(folder)


def range_starts(spotted: DataFrame) -> DataFrame:
    """(range, before): per range the number of rows in the ranges before it. One row per range is summed."""
    counts = spotted.groupBy(F.shiftright("spot", _PLACE_BITS).alias("range")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("range", F.coalesce(before, F.lit(0)).alias("before"))


def numbered(df: DataFrame, order: str, start: Column, folder: str, name: str = "id") -> DataFrame:
    """Consecutive numbers after `start`, in the order of a unique long such as the arrival position.

    The folder keeps the sorted rows for as long as the result is read.
    """
    rows = ranged(df, order, folder)
    # As many rows as a shuffle has partitions, whatever the table's size.
    starts = F.broadcast(range_starts(rows))
    place = F.col("spot").bitwiseAND((1 << _PLACE_BITS) - 1)
    number = (F.col("before") + place + 1 + start).cast("bigint")
    placed = rows.withColumn("range", F.shiftright("spot", _PLACE_BITS)).join(starts, "range")
    return placed.withColumn(name, number).drop("range", "spot", "before")
