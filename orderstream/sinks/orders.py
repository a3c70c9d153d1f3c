"""Writers for the order fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderstream.operators.dedup import insert_if_absent, known_ids
from orderstream.operators.numbering import numbered
from orderstream.sinks.batches import before_batch, write_batch
from orderstream.sinks.files import remove

# Columns of a validated order before it has an id.
ORDER_FIELDS = ("arrival", "message_id", "drink", "store", "price", "ts", "version")


def write_numbered(orders: DataFrame, start: Column, root: str, batch_id: int) -> None:
    """Writes a batch with consecutive ids after `start`, in arrival order, by date.

    The rows are sorted into ranges of their arrival first, in a folder of the batch's own that goes
    again, and numbered from there. So what gives the rows runs once, a task holds few dates and
    writes few files, and a busy day is spread over as many tasks as it has ranges.
    """
    staged = f"{root.rstrip('/')}-staged/batch_id={batch_id}"
    rows = numbered(orders, "arrival", start, staged).withColumn("order_date", F.to_date("ts"))
    write_batch(rows, root, batch_id, ("order_date",))
    remove(orders.sparkSession, staged)


def append_orders(orders: DataFrame, stored: DataFrame, root: str, batch_id: int) -> None:
    """Plain insert: every row is stored and numbered; rows need no message id."""
    last = before_batch(stored, batch_id).agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar()
    write_numbered(orders, last, root, batch_id)


def earlier_orders(stored: DataFrame, batch: DataFrame, batch_id: int, horizon_days: int | None = None) -> DataFrame:
    """The stored orders a batch is checked against: those of earlier batches.

    `horizon_days` limits them to orders at most that much older than the oldest of the batch; the
    default checks all of them.
    """
    earlier = before_batch(stored, batch_id)
    if horizon_days is None:
        return earlier
    oldest = batch.agg(F.date_sub(F.min("ts").cast("date"), horizon_days).alias("day")).scalar()
    return earlier.where(F.col("order_date") >= oldest)


def jdbc_options(url: str, table: str, batch_rows: int = 100) -> dict[str, str]:
    return {"url": url, "dbtable": table, "batchsize": str(batch_rows)}


def write_jdbc(orders: DataFrame, url: str, table: str, batch_rows: int = 100, **options: str) -> None:
    """Appends to a database table in batched statements, in parallel over the partitions.

    The rows must already be the new ones: Spark's JDBC writer has no on-conflict clause.
    """
    rows = orders.select("message_id", "drink", "store", "price", F.col("ts").alias("timestamp"))
    rows.write.format("jdbc").options(**jdbc_options(url, table, batch_rows), **options).mode("append").save()


def insert_jdbc(batch: DataFrame, url: str, table: str, batch_rows: int = 100, **options: str) -> None:
    """Insert-if-absent into a database table.

    Each partition of the write is one transaction. If some of them are lost, repeating the batch
    finds the rows of the others already there and inserts the rest.
    """
    reader = batch.sparkSession.read.format("jdbc").options(**options).option("url", url).option("dbtable", table)
    write_jdbc(insert_if_absent(batch, known_ids(reader.load(), batch)), url, table, batch_rows, **options)
