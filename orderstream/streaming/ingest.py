"""Micro-batch ingest: parse, validate, insert if absent, and account for every row.

One query writes all tables of a batch. Each step reads what the step before has written, under the
batch id, rather than cached rows: a lost executor costs one task, and a batch that is repeated
rewrites the same folders with the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderstream.functions.times import AsOf, back, moment
from orderstream.operators.dedup import insert_if_absent, known_ids
from orderstream.operators.metrics import (
    daily_from_hours,
    hour_items,
    merge_hour_items,
    merge_window_items,
    name_list,
    top_items_rolled,
    window_items,
)
from orderstream.operators.parsing import checked, parse_events
from orderstream.operators.recent import recent_orders
from orderstream.plans.refresh import Documents, current_hour_document
from orderstream.schemas import CHECKED_EVENT, HOUR_RUN, ORDER, OUTCOME, RECENT_SNAPSHOT, WINDOW_RUN, Domains
from orderstream.sinks.batches import before_batch, write_batch
from orderstream.sinks.idindex import IdIndex
from orderstream.sinks.levels import Levels
from orderstream.sinks.orders import ORDER_FIELDS, earlier_orders, write_numbered
from orderstream.sinks.snapshots import roll_recent
from orderstream.sources.tables import ensure_table, read_batch
from orderstream.sources.topics import Topics
from orderstream.streaming.common import start, together


@dataclass(frozen=True)
class Store:
    """The tables of one ingest, below a root folder.

    `orders` moves the order table elsewhere, such as to the result of `merge_batches`. `id_buckets`
    is the number of buckets of the id index, the same for its life.
    """

    root: str
    orders: str | None = None
    id_buckets: int = 16

    _SCHEMAS = {
        "events": CHECKED_EVENT,
        "orders": ORDER,
        "outcomes": OUTCOME,
        "recent": RECENT_SNAPSHOT,
    }

    def path(self, name: str) -> str:
        return self.orders if name == "orders" and self.orders else f"{self.root}/{name}"

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return ensure_table(spark, self.path(name), self._SCHEMAS[name])

    def batch(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame:
        return read_batch(spark, self.path(name), self._SCHEMAS[name], batch_id)

    def previous(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame:
        """The newest batch of a table before the given one.

        Usually the one numbered just before, whose folder is read directly: the cost of a batch
        must not grow with the number of batches before it.
        """
        try:
            return self.batch(spark, name, batch_id - 1)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        earlier = before_batch(self.table(spark, name), batch_id)
        return earlier.where(F.col("batch_id") == earlier.agg(F.max("batch_id").alias("b")).scalar())

    def hours(self) -> Levels:
        """The increments of the hourly figures, which corrections may void."""
        return Levels(self.path("hours"), HOUR_RUN, merge_hour_items, "hour_start", void_key="hour_start")

    def windows(self) -> Levels:
        return Levels(self.path("windows"), WINDOW_RUN, merge_window_items, "window_start")

    def ids(self) -> IdIndex:
        """The message ids of the order table."""
        return IdIndex.at(self.path("ids"), self.id_buckets)

    def known_ids(self, valid: DataFrame, batch_id: int, horizon_days: int | None = None) -> DataFrame:
        """The ids of a batch that earlier ones stored: by the index, or by a scan of the orders of the horizon."""
        spark = valid.sparkSession
        if horizon_days is not None:
            return known_ids(earlier_orders(self.table(spark, "orders"), valid, batch_id, horizon_days), valid)
        ids = self.ids()
        if batch_id > 0 and ids.manifest(spark, before=batch_id) is None:
            ids.build(self.table(spark, "orders"), batch_id)
        return ids.known(valid, batch_id)

    def quarantine(self, spark: SparkSession) -> DataFrame:
        """Rejected events with their text and the reason."""
        return self.table(spark, "events").where(~F.col("accepted")).select("arrival", "value", "reason", "batch_id")


def ingest_batch(
    records: DataFrame,
    batch_id: int,
    store: Store,
    domains: Domains,
    horizon_days: int | None = None,
    lenient_time: str | None = None,
    version: str | None = None,
    by_arrival: bool = False,
    window: str | None = None,
    topics: Topics | None = None,
) -> None:
    """Works off one batch of `arrival, value[, ingest_ts]` records, or with `topics` of Kafka-shaped ones.

    The input is read and parsed once. Accepted events are only needed until their batch is done
    and may be dropped later; the rejected ones are the quarantine. Hours, windows of size `window`
    (none without it) and the rolling list come from the rows the batch has inserted, so they follow
    the order table's dedup and no row is too late for them. With `by_arrival` orders are stored and
    counted under `ingest_ts` instead of their own time.
    """
    spark = records.sparkSession
    parsed = parse_events(records if topics is None else topics.text(records))
    if version is not None:
        parsed = parsed.where(F.col("malformed") | (F.col("version") == version))
    accepted = F.col("reason").isNull()
    events = checked(parsed, domains, lenient_time=lenient_time)
    if by_arrival:
        events = events.withColumn("ts", F.col("ingest_ts"))
    events = events.select(
        *ORDER_FIELDS, "reason", F.when(~accepted, F.col("value")).alias("value"), accepted.alias("accepted")
    )
    write_batch(events, store.path("events"), batch_id, ("accepted",))
    stored_events = store.batch(spark, "events", batch_id)
    valid = stored_events.where("accepted").select(*ORDER_FIELDS)

    last_id = store.previous(spark, "outcomes", batch_id).agg(F.coalesce(F.max("max_id"), F.lit(0)).alias("id")).scalar()
    fresh = insert_if_absent(valid, store.known_ids(valid, batch_id, horizon_days))
    write_numbered(fresh, last_id, store.path("orders"), batch_id)

    inserted = store.batch(spark, "orders", batch_id)
    n = F.coalesce(inserted.agg(F.count("*").alias("n")).scalar(), F.lit(0))
    counts = stored_events.agg(
        n.alias("inserted"),
        (F.count_if("accepted") - n).alias("skipped"),
        F.count_if(~F.col("accepted")).alias("quarantined"),
        (last_id + n).alias("max_id"),
    )
    recent = store.previous(spark, "recent", batch_id)
    writes = [
        lambda: write_batch(counts, store.path("outcomes"), batch_id),
        lambda: store.hours().add(hour_items(inserted), batch_id),
        lambda: store.ids().add_ids(inserted, batch_id),
        lambda: roll_recent(inserted, recent, store.path("recent"), batch_id),
    ]
    if window is not None:
        writes.append(lambda: store.windows().add(window_items(inserted, window), batch_id))
    together(spark, *writes)


def start_ingest(
    records: DataFrame,
    store: Store,
    domains: Domains,
    every: str | None = None,
    horizon_days: int | None = None,
    lenient_time: str | None = None,
    version: str | None = None,
    by_arrival: bool = False,
    topics: Topics | None = None,
) -> StreamingQuery:
    """Starts the ingest of a stream of `arrival, value[, ingest_ts]` records.

    With `topics` the records are as Kafka delivers them, of one or several topics, and the registry
    gives them their positions. Use `every="2 seconds"` and a source limit of records per trigger for bounded batches.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, store, domains, horizon_days, lenient_time, version, by_arrival, topics=topics)

    return start(records, on_batch, store.path("checkpoint"), every)


def current_hour_items(store: Store, spark: SparkSession) -> DataFrame:
    """The hourly figures: what all batches added, as corrected."""
    return store.hours().current(spark)


def current_window_items(store: Store, spark: SparkSession) -> DataFrame:
    """The window figures: what all batches added."""
    return store.windows().current(spark)


def ingested_documents(store: Store, spark: SparkSession, as_of: AsOf, n: int = 50) -> Documents:
    """The three dashboard documents from what the ingest keeps.

    The ranking takes whole days from the hourly figures, so a refresh reads the orders of one
    partial day and of the last hour, and of the hours those of the range, however long the table is.
    """
    hours = current_hour_items(store, spark)
    orders = store.table(spark, "orders")
    never = F.lit(None).cast("timestamp").alias("expires_at")
    first_day = moment(as_of, lambda c: F.date_add(back("30 days")(c).cast("date"), 1).cast("timestamp"))
    top = top_items_rolled(daily_from_hours(hours.where(F.col("hour_start") >= first_day)), orders, as_of, "30 days")
    return Documents(
        hourly=current_hour_document(hours, as_of),
        top=name_list(top).select("names", never),
        recent=recent_orders(orders, as_of, n).select("*", never),
    )
