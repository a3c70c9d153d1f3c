"""The event-time job: one stream of order records feeding the order table, windows and hours.

`start_windows` and `start_hours` are single figures straight from a stream, in Spark's state and
within a watermark: absolute values, so a repeated batch stores what it stored before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderstream.operators.metrics import hour_items, window_items
from orderstream.operators.parsing import checked, drop_malformed, of_version, parse_events, valid
from orderstream.schemas import HOUR_ITEM, WINDOW_ITEM, Domains
from orderstream.sinks.batches import latest_per_key
from orderstream.sinks.orders import insert_jdbc
from orderstream.sources.tables import ensure_table
from orderstream.sources.topics import Topics
from orderstream.streaming.common import keep_changes, start
from orderstream.streaming.ingest import Store, ingest_batch

WINDOW_KEYS = ["window_start", "window_end", "store", "drink"]
HOUR_KEYS = ["hour_start", "drink"]


def order_stream(
    records: DataFrame, domains: Domains, version: str | None = None, lenient_time: str | None = None
) -> DataFrame:
    """Valid typed orders of one API version from `arrival, value` records."""
    events = drop_malformed(parse_events(records))
    if version is not None:
        events = of_version(events, version)
    return valid(checked(events, domains, lenient_time=lenient_time))


def start_windows(
    orders: DataFrame,
    root: str,
    checkpoint: str,
    size: str = "1 second",
    every: str | None = None,
    partitions: int | None = None,
) -> StreamingQuery:
    """Tumbling windows by store and item; every change of a window is stored."""
    return start(window_items(orders, size), keep_changes(root), checkpoint, every, "update", partitions)


def start_hours(
    orders: DataFrame, root: str, checkpoint: str, every: str | None = None, partitions: int | None = None
) -> StreamingQuery:
    """Hours by item, straight from the orders; every change of an hour is stored."""
    return start(hour_items(orders), keep_changes(root), checkpoint, every, "update", partitions)


def start_job(
    records: DataFrame,
    store: Store,
    domains: Domains,
    version: str | None = "v3",
    window: str = "1 second",
    every: str | None = None,
    by_arrival: bool = False,
    database: dict[str, str] | None = None,
    topics: Topics | None = None,
) -> StreamingQuery:
    """Order table with recent orders, window figures and hourly figures of one API version: one query.

    The stream is read, parsed and deduplicated once. All figures are increments of the rows a batch
    inserts, kept under its id (`current_window_items`, `current_hour_items`), so they always agree
    with the order table, and a late row counts like any other. `topics` as in `start_ingest`. `database` (url, table, driver
    options) also inserts these rows into a database table; that branch needs a JDBC driver and is
    not verified here.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, store, domains, version=version, by_arrival=by_arrival, window=window, topics=topics)
        if database is not None:
            insert_jdbc(store.batch(batch.sparkSession, "orders", batch_id), **database)

    return start(records, on_batch, store.path("checkpoint"), every)


def stored_windows(spark: SparkSession, root: str) -> DataFrame:
    return latest_per_key(ensure_table(spark, root, WINDOW_ITEM), WINDOW_KEYS)


def stored_hours(spark: SparkSession, root: str) -> DataFrame:
    return latest_per_key(ensure_table(spark, root, HOUR_ITEM), HOUR_KEYS)


def late_rows(query: StreamingQuery) -> int:
    """Rows a query dropped because they arrived after their watermark, over the updates it still remembers.

    `late.DroppedRows` keeps the count of all of them, `late.SplitHours` the rows.
    """
    return sum(
        int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"]
    )


def with_arrival_time(orders: DataFrame, ingest_ts: str = "ingest_ts") -> DataFrame:
    """Orders under their stored arrival time, for figures by arrival instead of by order time."""
    return orders.withColumn("ts", F.col(ingest_ts))
