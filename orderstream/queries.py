"""The registered queries over the benchmark tables.

Each takes (spark, folder of tables) and returns flat columns: decimals as doubles after exact
summing, timestamps without zone, lists joined or one row per entry.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import partial

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderstream.functions.ids import legacy_id, stable_message_id
from orderstream.functions.times import back, clock_text, elapsed_ms, hour_text, moment, newest, updated_text
from orderstream.functions.values import hour_key, last_of, money_text, names_text, top_keys
from orderstream.operators import dedup, diffing, loadstats, metrics, parsing, rates, recent, requests, visibility
from orderstream.operators.numbering import numbered
from orderstream.operators.ranges import fresh
from orderstream.plans.dashboard import dashboard, flattened, from_json
from orderstream.plans.loadreport import export_load_report, load_report
from orderstream.plans.reconcile import correct, drift, reconcile
from orderstream.plans.refresh import SnapshotPaths, computed_documents, refresh, stored_documents
from orderstream.schemas import ARRIVED_ORDER, DASHBOARD, ORDER
from orderstream.session import use_utc, work_dir
from orderstream.sinks.batches import write_batch
from orderstream.sinks.orders import append_orders as append
from orderstream.sinks.publish import keyed_records, publish_folder, string_records
from orderstream.sinks.snapshots import rolled_recent
from orderstream.sources import bindings as b
from orderstream.sources.logs import parse_log_lines
from orderstream.sources.reports import read_failures, read_stats
from orderstream.sources.snapshots import hourly_at
from orderstream.sources.streams import folder_stream, kafka_text, position
from orderstream.sources.tables import ensure_table, read_table
from orderstream.sources.topics import Topics
from orderstream.streaming import job
from orderstream.streaming.common import keep_changes, start
from orderstream.streaming.changes import changes, send_changes
from orderstream.streaming.dashboard import start_dashboard, stored_dashboard
from orderstream.streaming.dedup import deduplicated
from orderstream.streaming.late import SplitHours, start_split_hours
from orderstream.streaming.ingest import Store, current_hour_items, current_window_items, ingest_batch, ingested_documents, start_ingest

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}

CORE_NAMES = ("GET /api/click", "GET /api/error", "GET /api/view", "POST /api/purchase")
JOBS = "aggregator"
# State partitions of the registered streams; a job names its own for the life of its checkpoint.
STATE_PARTITIONS = 8


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def flat(df: DataFrame) -> DataFrame:
    """Presentation types: decimals as double, timestamps without zone, counts as bigint."""

    def shown(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return c.cast("timestamp_ntz").alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            return c.cast("bigint").alias(field.name)
        return c

    return df.select(*[shown(f) for f in df.schema.fields])


def as_of(spark: SparkSession, sf_dir: str) -> datetime:
    """The time of the newest event stands for now."""
    return newest(b.events(spark, sf_dir))


# --- batch metrics -------------------------------------------------------------------------------


@query
def orders_scan(spark, sf_dir):
    return flat(recent.newest_first(b.orders(spark, sf_dir).select("id", "drink", "store", "price", "ts")))


@query
def hourly_metrics(spark, sf_dir):
    row = metrics.hourly_metrics(b.orders(spark, sf_dir), as_of(spark, sf_dir))
    return flat(row.withColumn("top_drinks", F.array_join("top_drinks", ",")))


@query
def hourly_metrics_empty(spark, sf_dir):
    """An hour of the day after the newest order: one row of zeros."""
    tomorrow = as_of(spark, sf_dir) + timedelta(days=1)
    row = metrics.hourly_metrics(b.orders(spark, sf_dir), tomorrow, hour=23)
    return flat(row.withColumn("top_drinks", F.array_join("top_drinks", ",")))


@query
def hourly_of_day(spark, sf_dir):
    """A given hour of the current day instead of the current hour."""
    row = metrics.hourly_metrics(b.orders(spark, sf_dir), as_of(spark, sf_dir), hour=9)
    return flat(row.withColumn("top_drinks", F.array_join("top_drinks", ",")))


@query
def hourly_series(spark, sf_dir):
    docs = metrics.hourly_documents(metrics.hour_items(b.orders(spark, sf_dir)))
    return flat(docs.withColumn("top_drinks", F.array_join("top_drinks", ",")).drop("drink_counts"))


@query
def hourly_item_counts(spark, sf_dir):
    docs = metrics.hourly_documents(metrics.hour_items(b.orders(spark, sf_dir)))
    return flat(docs.select("hour_start", F.explode("drink_counts").alias("drink", "order_count")))


@query
def top_items_30d(spark, sf_dir):
    return flat(metrics.top_items_over(b.orders(spark, sf_dir), as_of(spark, sf_dir)))


@query
def top_items_7d_rolled(spark, sf_dir):
    """The trailing-range ranking from daily counts plus the orders of the first, partial day."""
    orders = b.orders(spark, sf_dir)
    return flat(metrics.top_items_rolled(metrics.daily_items(orders), orders, as_of(spark, sf_dir), "7 days"))


@query
def top_brands(spark, sf_dir):
    ranking = metrics.top_items_keyed(b.line_orders(spark, sf_dir), b.brands(spark, sf_dir), "part")
    return flat(ranking.withColumnRenamed("drink", "brand"))


@query
def recent_orders(spark, sf_dir):
    return flat(recent.recent_orders(b.orders(spark, sf_dir), as_of(spark, sf_dir)))


@query
def recent_orders_day(spark, sf_dir):
    """Another span and limit: the newest 200 of the last day."""
    return flat(recent.recent_orders(b.orders(spark, sf_dir), as_of(spark, sf_dir), 200, "1 day"))


@query
def rolling_last_10(spark, sf_dir):
    return flat(recent.last_arrived(b.orders(spark, sf_dir)).select("id", "drink", "store", "price", "ts"))


@query
def dashboard_document(spark, sf_dir):
    now = as_of(spark, sf_dir)
    return flattened(dashboard(computed_documents(b.orders(spark, sf_dir), now), now))


@query
def refresh_job(spark, sf_dir):
    """The batch job end to end: order table written, documents stored, dashboard read back."""
    root = work_dir(spark, "refresh")
    orders = b.orders(spark, sf_dir).withColumn("order_date", F.to_date("ts"))
    # Rebalanced by date: few files per day, and a busy day is still split over tasks.
    write_batch(orders.hint("rebalance", "order_date"), f"{root}/orders", 0, ("order_date",))
    now = as_of(spark, sf_dir)
    paths = SnapshotPaths.below(root)
    refresh(spark, f"{root}/orders", paths, now)
    return flattened(dashboard(stored_documents(spark, paths), now))


@query
def totals(spark, sf_dir):
    return flat(metrics.totals(b.orders(spark, sf_dir)))


@query
def by_item(spark, sf_dir):
    return flat(metrics.totals(b.orders(spark, sf_dir), "drink"))


@query
def by_store(spark, sf_dir):
    return flat(metrics.totals(b.orders(spark, sf_dir), "store"))


@query
def volume_by_store(spark, sf_dir):
    lines = b.line_orders(spark, sf_dir)
    return flat(metrics.totals(lines.withColumn("price", F.col("price").cast("decimal(12,2)")), "store"))


@query
def null_amounts(spark, sf_dir):
    """Orders without a price, item or store: counted in the totals, absent from the maps they lack a key for."""
    orders = b.orders(spark, sf_dir).withColumns(
        {
            "price": F.when(F.col("version") != "v1", F.col("price")),
            "drink": F.when(F.col("drink") != "error", F.col("drink")),
        }
    )
    stats = metrics.window_stats(metrics.window_items(orders.withColumn("store", F.when(F.col("store") != "central", F.col("store"))), "1 day"))
    return flat(
        stats.select(
            "window_start",
            "store",
            "total_orders",
            "total_revenue",
            F.aggregate(F.map_values("drink_counts"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("named_orders"),
            F.size("drink_counts").cast("bigint").alias("items"),
            F.size("store_counts").cast("bigint").alias("stores"),
        )
    )


@query
def window_maps(spark, sf_dir):
    """Window figures by item, read out of the maps of the window result."""
    stats = metrics.window_stats(metrics.window_items(b.orders(spark, sf_dir), "10 minutes"))
    return flat(
        stats.select(
            "window_start",
            "window_end",
            "store",
            "total_orders",
            "total_revenue",
            F.element_at("store_counts", F.col("store")).alias("store_orders"),
            F.element_at("store_revenue", F.col("store")).alias("store_revenue"),
            F.explode("drink_counts").alias("drink", "drink_orders"),
            "drink_revenue",
        ).withColumn("drink_revenue", F.col("drink_revenue")[F.col("drink")])
    )


@query
def orders_counter(spark, sf_dir):
    return flat(metrics.item_counter(b.orders(spark, sf_dir)))


@query
def order_value_counter(spark, sf_dir):
    return flat(metrics.totals(b.orders(spark, sf_dir), "store").select("store", "revenue"))


@query
def state_merge(spark, sf_dir):
    """Stored hourly documents merged with newly counted ones; the cut falls inside an hour."""
    orders, now = b.orders(spark, sf_dir), as_of(spark, sf_dir)
    cut = moment(now, back("10 days"))
    old = metrics.hourly_documents(metrics.hour_items(orders.where(F.col("ts") < cut)))
    new = metrics.hourly_documents(metrics.hour_items(orders.where(F.col("ts") >= cut)))
    merged = metrics.merged_document(old, new)
    return flat(merged.select("hour_start", "revenue", "order_count", F.array_join("top_drinks", ",").alias("top_drinks")))


@query
def partial_merge(spark, sf_dir):
    """Additive parts counted per API version, merged; equal to counting everything at once."""
    orders = b.orders(spark, sf_dir)
    parts = [metrics.hour_items(orders.where(F.col("version") == v)) for v in ("v1", "v2", "v3")]
    return flat(metrics.merge_hour_items(*parts))


@query
def map_top_keys(spark, sf_dir):
    """Per day the three items with the largest counts, from a count map."""
    daily = metrics.daily_items(b.orders(spark, sf_dir))
    maps = daily.groupBy(F.col("order_date").cast("timestamp").alias("day")).agg(
        F.map_from_entries(F.collect_list(F.struct("drink", "order_count"))).alias("counts")
    )
    return flat(maps.select("day", F.array_join(top_keys(F.col("counts"), 3), ",").alias("top_drinks")))


# --- events: parsing and validation --------------------------------------------------------------


def checked_events(spark, sf_dir, **kw):
    lines = b.as_event_text(b.events(spark, sf_dir))
    return parsing.checked(parsing.parse_events(lines), b.EVENT_DOMAINS, **kw)


@query
def parse_valid(spark, sf_dir):
    return flat(parsing.valid(checked_events(spark, sf_dir)))


@query
def parse_quarantine(spark, sf_dir):
    return flat(parsing.quarantined(checked_events(spark, sf_dir)).select("arrival", "reason"))


@query
def version_filter(spark, sf_dir):
    parsed = parsing.drop_malformed(parsing.parse_events(b.as_event_text(b.events(spark, sf_dir))))
    return flat(parsing.of_version(parsed, "v3").select("arrival", "message_id", "drink", "store", "price", "version"))


@query
def lenient_timestamp(spark, sf_dir):
    return flat(parsing.valid(checked_events(spark, sf_dir, lenient_time="ingest_ts")))


@query
def missing_price_allowed(spark, sf_dir):
    """Without a required message id; a missing price passes, a text that is no number does not."""
    checked = checked_events(spark, sf_dir, require_message_id=False, allow_missing_price=True)
    return flat(checked.groupBy(F.coalesce("reason", F.lit("valid")).alias("result")).agg(F.count("*").alias("events")))


# --- insert if absent ----------------------------------------------------------------------------


def redelivered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A batch that sends every order and every purchase twice, and a table that has the first ten days.

    Sign-ups come without a message id, so all of them are kept, also the copies.
    """
    orders = b.orders(spark, sf_dir)
    target = orders.where(F.col("ts") < F.lit("2024-01-11").cast("timestamp")).select("message_id")
    again = orders.where(F.col("drink").isin("purchase", "signup")).withColumn("arrival", F.col("arrival") + 1_000_000_000_000)
    batch = orders.unionByName(again).withColumn("message_id", F.when(F.col("drink") != "signup", F.col("message_id")))
    return batch.drop("id"), target


@query
def insert_if_absent(spark, sf_dir):
    batch, target = redelivered(spark, sf_dir)
    return flat(dedup.insert_if_absent(batch, dedup.known_ids(target, batch)))


@query
def batch_outcome(spark, sf_dir):
    batch, target = redelivered(spark, sf_dir)
    return flat(dedup.outcome(dedup.insertable(batch, dedup.known_ids(target, batch))))


@query
def first_of_each(spark, sf_dir):
    batch, _ = redelivered(spark, sf_dir)
    return flat(dedup.first_of_each(batch).select("arrival", "message_id", "drink"))


@query
def numbered_orders(spark, sf_dir):
    """The inserted rows with consecutive ids in arrival order, continuing after an existing highest id."""
    batch, target = redelivered(spark, sf_dir)
    fresh = dedup.insert_if_absent(batch, dedup.known_ids(target, batch))
    return flat(numbered(fresh.select("arrival", "message_id"), "arrival", F.lit(1000), work_dir(spark, "numbered")))


@query
def numbered_kafka_positions(spark, sf_dir):
    """Consecutive ids over positions that lie far apart, as those of a Kafka source do."""
    orders = b.orders(spark, sf_dir).select("arrival", "message_id")
    sparse = orders.withColumn("arrival", position(F.expr("arrival div 5"), F.col("arrival") % 5))
    return flat(numbered(sparse, "arrival", F.lit(0), work_dir(spark, "numbered")))


# --- scalar expressions --------------------------------------------------------------------------


@query
def legacy_ids(spark, sf_dir):
    orders = b.orders(spark, sf_dir)
    text = F.concat_ws("-", F.lit("order"), "drink", "message_id")
    return orders.select("id", text.alias("message_id"), legacy_id(text).alias("legacy_id"))


@query
def stable_ids(spark, sf_dir):
    orders = b.orders(spark, sf_dir)
    return orders.select("id", stable_message_id(F.col("message_id"), F.col("drink"), F.col("store")).alias("stable_id"))


@query
def serialize_orders(spark, sf_dir):
    return recent.serialized(b.orders(spark, sf_dir))


@query
def display_texts(spark, sf_dir):
    docs = metrics.hourly_documents(metrics.hour_items(b.orders(spark, sf_dir)))
    hour = F.hour("hour_start")
    return docs.select(
        F.col("hour_start").cast("timestamp_ntz").alias("hour_start"),
        hour_key(hour).alias("hour_key"),
        hour_text(hour).alias("hour_text"),
        money_text(F.col("revenue")).alias("revenue_text"),
        names_text(F.col("top_drinks")).alias("names_text"),
        names_text(F.filter("top_drinks", lambda d: d == "latte")).alias("no_names_text"),
        names_text(last_of(F.col("top_drinks"), 2)).alias("last_two"),
        clock_text(F.col("updated_at")).alias("clock_text"),
        updated_text(F.col("updated_at")).alias("updated_text"),
        elapsed_ms(F.col("hour_start"), F.col("updated_at")).alias("elapsed_ms"),
    )


@query
def publish_strings(spark, sf_dir):
    """Orders appended to a stream folder as all-text records, read back."""
    path = f"{work_dir(spark, 'publish')}/strings"
    publish_folder(string_records(b.orders(spark, sf_dir), "v2"), path)
    schema = "message_id STRING, drink STRING, store STRING, price STRING, timestamp STRING, version STRING"
    return use_utc(spark).read.schema(schema).parquet(path)


@query
def publish_keyed(spark, sf_dir):
    """Orders published as keyed JSON, read back and parsed."""
    path = f"{work_dir(spark, 'publish')}/keyed"
    publish_folder(keyed_records(b.orders(spark, sf_dir), "v3"), path)
    back_in = parsing.parse_events(use_utc(spark).read.schema("value STRING, key STRING").parquet(path))
    return back_in.select("key", "message_id", "drink", "store", F.col("price").cast("double").alias("price"), "timestamp", "version")


# --- snapshots -----------------------------------------------------------------------------------


def hourly_docs(spark, sf_dir):
    return metrics.hourly_documents(metrics.hour_items(b.orders(spark, sf_dir)))


@query
def fresh_snapshots(spark, sf_dir):
    docs = fresh(hourly_docs(spark, sf_dir), as_of(spark, sf_dir))
    return flat(docs.select("hour_start", "order_count", "revenue", "expires_at"))


@query
def snapshot_point_read(spark, sf_dir):
    docs = hourly_at(hourly_docs(spark, sf_dir), as_of(spark, sf_dir))
    return flat(docs.select("hour_start", "order_count", "revenue"))


@query
def changed_only(spark, sf_dir):
    """What changed in the hourly figures since two hours ago."""
    orders, now = b.orders(spark, sf_dir), as_of(spark, sf_dir)
    before = metrics.hour_items(orders.where(F.col("ts") < moment(now, back("2 hours"))))
    changes = diffing.changed_only(before, metrics.hour_items(orders), ["hour_start", "drink"], ["order_count", "revenue"])
    # A key on one side only has no count on the other, so the counts are shown as doubles.
    return flat(changes.withColumns({c: F.col(c).cast("double") for c in ("order_count_before", "order_count_after")}))


# --- streams -------------------------------------------------------------------------------------


@query
def stream_dedup(spark, sf_dir):
    """The stream delivered twice; every message comes through once."""
    root = work_dir(spark, "dedup")
    twice = b.as_orders(b.events_stream(spark, sf_dir)).unionByName(b.as_orders(b.events_stream(spark, sf_dir)))
    once = deduplicated(twice)
    start(once, keep_changes(f"{root}/out"), f"{root}/checkpoint", partitions=STATE_PARTITIONS).awaitTermination()
    return flat(read_table(spark, f"{root}/out", ARRIVED_ORDER).select("message_id", "drink", "store", "price", "ts"))


@query
def stream_tumbling_store(spark, sf_dir):
    root = work_dir(spark, "windows")
    orders = b.as_orders(b.events_stream(spark, sf_dir)).withWatermark("ts", "1 hour")
    job.start_windows(orders, f"{root}/out", f"{root}/checkpoint", partitions=STATE_PARTITIONS).awaitTermination()
    stats = metrics.window_stats(job.stored_windows(spark, f"{root}/out"))
    return flat(stats.select("window_start", "window_end", "store", "total_orders", "total_revenue"))


def _streamed_hours(spark, sf_dir):
    root = work_dir(spark, "hours")
    orders = deduplicated(b.as_orders(b.events_stream(spark, sf_dir)))
    job.start_hours(orders, f"{root}/out", f"{root}/checkpoint", partitions=STATE_PARTITIONS).awaitTermination()
    return job.stored_hours(spark, f"{root}/out")


@query
def stream_hourly(spark, sf_dir):
    return flat(_streamed_hours(spark, sf_dir))


@query
def reconcile_stream(spark, sf_dir):
    """Streamed hourly figures against a batch recomputation: every hour and item, with its status."""
    return flat(reconcile(_streamed_hours(spark, sf_dir), b.orders(spark, sf_dir)))


@query
def stream_ingest(spark, sf_dir):
    """Micro-batch ingest of the faulty event stream: contents of the order table."""
    store = _ingested(spark, sf_dir)
    return flat(store.table(spark, "orders").select("id", "message_id", "drink", "store", "price", "ts", "order_date").withColumn("order_date", F.col("order_date").cast("string")))


@query
def stream_ingest_hours(spark, sf_dir):
    """The hourly figures of the same ingest, from the increments of its batches."""
    return flat(current_hour_items(_ingested(spark, sf_dir), spark))


@query
def stream_ingest_outcomes(spark, sf_dir):
    store = _ingested(spark, sf_dir)
    sums = [F.sum(c).alias(c) for c in ("inserted", "skipped", "quarantined")]
    return store.table(spark, "outcomes").agg(*sums, F.max("max_id").alias("max_id"))


def _ingested(spark, sf_dir) -> Store:
    store = Store(work_dir(spark, "ingest"))
    records = b.as_event_text(b.events_stream(spark, sf_dir))
    start_ingest(records, store, b.EVENT_DOMAINS).awaitTermination()
    return store


@query
def stream_quarantine(spark, sf_dir):
    return _ingested(spark, sf_dir).quarantine(spark).select("arrival", "reason")


@query
def stream_recent(spark, sf_dir):
    """The rolling list of the last ten orders the ingest stored."""
    stored = rolled_recent(_ingested(spark, sf_dir).table(spark, "recent"))
    return flat(stored.select("id", "drink", "store", "price", "ts"))


@query
def stream_dashboard(spark, sf_dir):
    """The dashboard document stored by the periodic refresh next to the ingest, as rows."""
    store, now = _ingested(spark, sf_dir), as_of(spark, sf_dir)
    root = work_dir(spark, "dashboard")

    ticks = b.events_stream(spark, sf_dir)
    documents = partial(ingested_documents, store, spark)
    start_dashboard(ticks, documents, lambda: now, f"{root}/out", f"{root}/checkpoint", every=None).awaitTermination()
    return flattened(from_json(stored_dashboard(spark, f"{root}/out"), DASHBOARD))


@query
def dashboard_changes(spark, sf_dir):
    """What three refreshes send: everything, nothing, and what has changed an hour later."""
    orders, root, now = b.orders(spark, sf_dir), work_dir(spark, "changes"), as_of(spark, sf_dir)
    before = now - timedelta(hours=1)
    for n, at in enumerate((before, before, now)):
        send_changes(computed_documents(orders, at), root, n)
    payload = F.col("payload")
    ids = F.from_json(payload, "orders array<struct<id: bigint>>")["orders"]["id"].cast("array<string>")
    shown = (
        F.when(F.col("part") == "hourly", F.get_json_object(payload, "$.order_count"))
        .when(F.col("part") == "top", F.array_join(F.from_json(payload, "names array<string>")["names"], ","))
        .otherwise(F.array_join(ids, ","))
    )
    return changes(spark, root).select("batch_id", "part", shown.alias("shown"))


@query
def hourly_by_arrival(spark, sf_dir):
    """Hourly figures by arrival time instead of order time."""
    orders = job.with_arrival_time(checked_events(spark, sf_dir).where(F.col("reason").isNull()))
    return flat(metrics.hour_items(orders))


@query
def kafka_records(spark, sf_dir):
    """Records in the shape of a Kafka source: bytes decoded, one arrival position from partition and offset."""
    shaped = b.as_event_text(b.events(spark, sf_dir)).select(
        F.lit(None).cast("binary").alias("key"),
        F.encode("value", "UTF-8").alias("value"),
        F.lit("orders").alias("topic"),
        (F.col("arrival") % 6).cast("int").alias("partition"),
        F.expr("arrival div 6").alias("offset"),
        F.col("ingest_ts").alias("timestamp"),
    )
    parsed = parsing.checked(parsing.parse_events(kafka_text(shaped, ("orders",))), b.EVENT_DOMAINS)
    return flat(parsing.valid(parsed).select("arrival", "message_id", "ts"))


@query
def kafka_positions(spark, sf_dir):
    """Orders of two topics, three partitions each with the same offsets, without message ids: all rows are kept.

    The registry sees one topic first, then both.
    """
    n = F.col("arrival")
    shaped = b.as_event_text(b.events(spark, sf_dir)).select(
        F.lit(None).cast("binary").alias("key"),
        F.encode("value", "UTF-8").alias("value"),
        F.concat(F.lit("orders-"), (n % 2).cast("string")).alias("topic"),
        (F.expr("arrival div 2") % 3).cast("int").alias("partition"),
        F.expr("arrival div 6").alias("offset"),
        F.col("ingest_ts").alias("timestamp"),
    )
    topics = Topics(work_dir(spark, "topics"), ("orders-0", "orders-1"))
    topics.extend(shaped.where("topic = 'orders-1'"))
    parsed = parsing.checked(parsing.parse_events(topics.text(shaped)), b.EVENT_DOMAINS, require_message_id=False)
    batch = parsing.valid(parsed).withColumn("message_id", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "message_id STRING")
    return flat(dedup.insert_if_absent(batch, none).select("arrival", "message_id", "ts"))


@query
def known_message_ids(spark, sf_dir):
    """Which ids of a batch the index of an ingest in several batches has, with as many unknown ones among them."""
    store = _ingested_in_batches(spark, sf_dir)
    ids = b.events(spark, sf_dir).select(F.col("event_id").cast("string").alias("message_id"))
    asked = ids.unionByName(ids.select(F.concat(F.lit("x"), "message_id").alias("message_id")))
    return store.ids().known(asked, before=1_000_000).distinct()


@query
def levelled_hours(spark, sf_dir):
    """Hourly figures from the increments of many batches, merged in levels."""
    levels = Store(work_dir(spark, "levels")).hours()
    orders, slices = b.orders(spark, sf_dir), 9
    for n in range(slices):
        levels.add(metrics.hour_items(orders.where(F.col("id") % slices == n)), n)
    return flat(levels.current(spark))


@query
def reconcile_drift(spark, sf_dir):
    """Figures of an ingest that drifted, corrected: every hour and item agrees, and hours that no order is in are gone.

    The drift: a tenth of the orders counted twice, and hours of a year before.
    """
    store = _ingested_in_batches(spark, sf_dir)
    orders = store.table(spark, "orders")
    twice = orders.where(F.col("arrival") % 10 == 0)
    ghosts = orders.where(F.col("arrival") % 7 == 0).withColumn("ts", F.col("ts") - F.expr("interval 365 days"))
    store.hours().add(metrics.hour_items(twice.unionByName(ghosts)), 1_000_000)
    correct(spark, store, "drift")
    return flat(drift(spark, store).drop("last_ts_before", "last_ts_after"))


@query
def stream_resumed(spark, sf_dir):
    """An ingest that ended between writing its second batch and committing it, and was started again."""
    store, stream = Store(work_dir(spark, "resumed")), _redelivered(spark, sf_dir)

    def ends_early(batch, batch_id):
        ingest_batch(batch, batch_id, store, b.EVENT_DOMAINS)
        if batch_id == 1:
            raise InterruptedError("ended before the commit")

    stopped = start(stream, ends_early, store.path("checkpoint"))
    try:
        stopped.awaitTermination()
    except StreamingQueryException as error:
        if "ended before the commit" not in str(error):
            raise
    start_ingest(stream, store, b.EVENT_DOMAINS).awaitTermination()
    orders = store.table(spark, "orders").select("message_id", "drink", "store", "price", "ts", "id")
    # Ids follow the order of the batches' files; that they are consecutive does not.
    last = orders.agg(F.max("id").alias("id")).scalar()
    return flat(orders.withColumn("last_id", last).drop("id"))


@query
def stream_job(spark, sf_dir):
    """The job on the faulty stream in several batches, with repeats and late rows: v3 windows per store and day."""
    store = _job(spark, sf_dir)
    windows = metrics.window_stats(current_window_items(store, spark))
    table = store.table(spark, "orders").groupBy("store", F.window("ts", "1 day").start.alias("window_start"))
    stored = table.agg(F.count("*").alias("stored_orders"))
    both = windows.select("window_start", "store", "total_orders", "total_revenue").join(stored, ["store", "window_start"], "full_outer")
    return flat(both)


def _job(spark, sf_dir) -> Store:
    store = Store(work_dir(spark, "job"))
    job.start_job(_redelivered(spark, sf_dir), store, b.EVENT_DOMAINS, window="1 day").awaitTermination()
    return store


@query
def stream_late_rows(spark, sf_dir):
    """Hours of the same job: most rows arrive after newer ones, none is missing."""
    return flat(current_hour_items(_job(spark, sf_dir), spark))


def _redelivered(spark, sf_dir) -> DataFrame:
    glob, files = b.redelivered_files(spark, sf_dir, f"{work_dir(spark, 'feed')}/events")
    return folder_stream(spark, glob, "arrival BIGINT, value STRING, ingest_ts TIMESTAMP", files_per_batch=files)


def _ingested_in_batches(spark, sf_dir, by_arrival: bool = False) -> Store:
    store = Store(work_dir(spark, "batches"))
    start_ingest(_redelivered(spark, sf_dir), store, b.EVENT_DOMAINS, by_arrival=by_arrival).awaitTermination()
    return store


def _split_hours(spark, sf_dir) -> SplitHours:
    """The orders in three files, one after the other, each over the whole time range."""
    root = work_dir(spark, "late")
    orders = b.orders(spark, sf_dir).drop("id")
    for n in range(3):
        orders.where(F.col("arrival") % 3 == n).coalesce(1).write.mode("append").parquet(f"{root}/in")
    into = SplitHours(f"{root}/out")
    stream = folder_stream(spark, f"{root}/in", ARRIVED_ORDER, files_per_batch=1)
    start_split_hours(stream, into, f"{root}/checkpoint", "3 days").awaitTermination()
    return into


@query
def late_ledger(spark, sf_dir):
    """What a split stream left in its ledger: rows seen and late, and the watermark of each batch."""
    return flat(_split_hours(spark, sf_dir).ledger(spark))


@query
def late_rows_split(spark, sf_dir):
    """Per hour and item the rows in time and the late ones of the same stream."""
    into = _split_hours(spark, sf_dir)
    keys = ["hour_start", "drink"]
    in_time = into.hours().current(spark).select(*keys, F.col("order_count").alias("in_time"), F.lit(0).cast("bigint").alias("late"))
    late = metrics.hour_items(into.late(spark)).select(*keys, F.lit(0).cast("bigint").alias("in_time"), F.col("order_count").alias("late"))
    both = in_time.unionByName(late).groupBy(*keys).agg(F.sum("in_time").alias("in_time"), F.sum("late").alias("late"))
    return flat(both)


@query
def stream_redelivered(spark, sf_dir):
    """Outcomes of an ingest in several batches, with repeats inside and across batches."""
    sums = [F.sum(c).alias(c) for c in ("inserted", "skipped", "quarantined")]
    outcomes = _ingested_in_batches(spark, sf_dir).table(spark, "outcomes")
    return outcomes.agg(*sums, F.max("max_id").alias("max_id"), F.countDistinct("batch_id").alias("batches"))


@query
def stream_hourly_batches(spark, sf_dir):
    return flat(current_hour_items(_ingested_in_batches(spark, sf_dir), spark))


@query
def stream_recent_batches(spark, sf_dir):
    """The rolling list over several batches; ids depend on the order of the files and are left out."""
    stored = rolled_recent(_ingested_in_batches(spark, sf_dir).table(spark, "recent"))
    return flat(stored.select("arrival", "drink", "store", "price", "ts"))


@query
def stream_arrival_hours(spark, sf_dir):
    """Hours by arrival, ingested in several batches."""
    return flat(current_hour_items(_ingested_in_batches(spark, sf_dir, by_arrival=True), spark))


@query
def append_orders(spark, sf_dir):
    """Plain inserts in two batches; ids run on in arrival order."""
    root = f"{work_dir(spark, 'append')}/orders"
    rows = b.orders(spark, sf_dir).drop("id")
    for batch_id, rest in enumerate((0, 1)):
        append(rows.where(F.col("arrival") % 2 == rest), ensure_table(spark, root, ORDER), root, batch_id)
    return flat(read_table(spark, root, ORDER).select("id", "arrival", "message_id", "drink", "store", "price", "ts"))


@query
def id_rules(spark, sf_dir):
    """Orders that must not bring an id, and stored ones that must have one; every third row has one."""
    parsed = parsing.parse_events(b.as_event_text(b.events(spark, sf_dir)))
    given = parsed.withColumn("id", F.when(F.col("arrival") % 3 == 0, F.col("arrival")))
    reasons = [
        parsing.checked(given, b.EVENT_DOMAINS, id_column="id", id_required=r).select("arrival", "reason", F.lit(r).alias("id_required"))
        for r in (False, True)
    ]
    return reasons[0].unionByName(reasons[1])


# --- observability -------------------------------------------------------------------------------


@query
def request_counter(spark, sf_dir):
    return flat(requests.request_counter(b.requests(spark, sf_dir)))


@query
def latency_histogram(spark, sf_dir):
    return flat(requests.latency_histogram(b.requests(spark, sf_dir)))


@query
def latency_p95(spark, sf_dir):
    return flat(requests.latency_quantile(b.requests(spark, sf_dir), ["endpoint"]))


@query
def latency_p95_over_time(spark, sf_dir):
    return flat(requests.latency_quantile_over_time(b.requests(spark, sf_dir), ["endpoint"]))


@query
def request_rate(spark, sf_dir):
    return flat(rates.request_rate(b.requests(spark, sf_dir)))


@query
def items_per_minute(spark, sf_dir):
    return flat(rates.items_per_minute(b.orders(spark, sf_dir)))


@query
def revenue_per_minute(spark, sf_dir):
    return flat(rates.revenue_per_minute(b.orders(spark, sf_dir)))


@query
def run_ledger(spark, sf_dir):
    return flat(requests.run_ledger(b.runs(spark, sf_dir), JOBS))


@query
def freshness_lag(spark, sf_dir):
    return requests.freshness_lag(b.runs(spark, sf_dir), as_of(spark, sf_dir), JOBS)


@query
def log_select(spark, sf_dir):
    logs = parse_log_lines(b.app_logs(spark, sf_dir))
    chosen = requests.select_logs(logs, "shop", "error")
    return flat(chosen.select("line_no", "timestamp", "level", "logger", "message", "module", "function", "line", "exception"))


# --- load test -----------------------------------------------------------------------------------


@query
def request_stats(spark, sf_dir):
    return flat(loadstats.request_stats(b.requests(spark, sf_dir)))


@query
def failures(spark, sf_dir):
    return flat(loadstats.failures_by_error(b.requests(spark, sf_dir)))


@query
def exceptions(spark, sf_dir):
    return flat(loadstats.exceptions_by_message(b.requests(spark, sf_dir)))


STEPS = {"step_seconds": 6 * 3600, "tick_seconds": 600}


@query
def breaking_point(spark, sf_dir):
    return flat(loadstats.breaking_point(b.requests(spark, sf_dir), CORE_NAMES, **STEPS))


@query
def breaking_point_unbroken(spark, sf_dir):
    """A threshold the error share does not stay above: the test runs on to the maximum load."""
    return flat(loadstats.breaking_point(b.requests(spark, sf_dir), CORE_NAMES, threshold=0.9, **STEPS))


def refresh_snapshots(orders: DataFrame, minutes: int = 10) -> DataFrame:
    """Dashboard refreshes every ten minutes in which orders came: orders so far in the current hour."""
    per_step = orders.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"))
    steps = per_step.select(
        F.col("w.start").alias("step_start"), F.date_trunc("hour", "w.start").alias("hour_start"), "n"
    )
    so_far = Window.partitionBy("hour_start").orderBy("step_start").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(
        (F.col("step_start") + F.make_interval(mins=F.lit(minutes))).alias("refresh_ts"),
        F.sum("n").over(so_far).alias("order_count"),
    )


WAIT_SECONDS = 1800
WEEK_SECONDS = 7 * 86_400


@query
def visibility_latency(spark, sf_dir):
    orders = b.orders(spark, sf_dir)
    seen = visibility.visibility(orders.select("id", "ts"), refresh_snapshots(orders), WAIT_SECONDS)
    return flat(seen)


@query
def visibility_week(spark, sf_dir):
    """Waits of up to a week: the first greater count may be days away."""
    orders = b.orders(spark, sf_dir)
    return flat(visibility.visibility(orders.select("id", "ts"), refresh_snapshots(orders), WEEK_SECONDS))


@query
def visibility_summary(spark, sf_dir):
    orders = b.orders(spark, sf_dir)
    seen = visibility.visibility(orders.select("id", "ts"), refresh_snapshots(orders), WAIT_SECONDS)
    return flat(loadstats.request_stats(visibility.as_requests(seen, "v1", WAIT_SECONDS)))


@query
def load_report_files(spark, sf_dir):
    """The load report written as CSV files and read back."""
    report = load_report(b.requests(spark, sf_dir), CORE_NAMES, **STEPS)
    paths = export_load_report(report, work_dir(spark, "report"), "v1", "standard")
    stats = read_stats(spark, paths["stats"])
    failed = read_failures(spark, paths["failures"]).groupBy("Name").agg(F.sum("Occurrences").alias("n"))
    return (
        stats.join(failed, "Name", "left")
        .select(
            F.coalesce("Type", F.lit("")).alias("type"),
            F.col("Name").alias("name"),
            F.col("Request Count").alias("request_count"),
            F.col("Failure Count").alias("failure_count"),
            F.col("Average Response Time").alias("mean_ms"),
            F.col("95%").alias("p95"),
            F.coalesce("n", F.lit(0)).alias("listed_failures"),
        )
    )


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the dashboard document as rows."""
    return dashboard_document(spark, sf_dir)

