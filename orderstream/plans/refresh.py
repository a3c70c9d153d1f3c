"""The batch refresh job: current hour, top items of 30 days, recent orders."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderstream.functions.times import AsOf, moment, start_of_hour
from orderstream.functions.values import or_empty, or_zero
from orderstream.operators.metrics import (
    hour_items,
    hourly_documents,
    hourly_metrics,
    name_list,
    top_items_over,
)
from orderstream.operators.ranges import in_hour
from orderstream.operators.recent import recent_orders
from orderstream.schemas import HOURLY, HOURLY_TTL, RECENT_ORDER
from orderstream.sinks.snapshots import overwrite_hourly, overwrite_recent, overwrite_top
from orderstream.sinks.versions import read_version, write_version
from orderstream.sources.tables import orders_scan

HOURLY_FIELDS = ("hour_start", "top_drinks", "revenue", "order_count", "drink_counts", "updated_at", "expires_at")
RECENT_FIELDS = ("id", "drink", "store", "price", "ts", "updated_at", "expires_at")
VERSION = (
    "hourly STRUCT<hour_start: TIMESTAMP, top_drinks: ARRAY<STRING>, revenue: DECIMAL(20,2), order_count: BIGINT,"
    " drink_counts: MAP<STRING,BIGINT>, updated_at: TIMESTAMP, expires_at: TIMESTAMP>,"
    " top STRUCT<names: ARRAY<STRING>, updated_at: TIMESTAMP, expires_at: TIMESTAMP>,"
    " recent ARRAY<STRUCT<id: BIGINT, drink: STRING, store: STRING, price: DECIMAL(10,2), ts: TIMESTAMP,"
    " updated_at: TIMESTAMP, expires_at: TIMESTAMP>>"
)


@dataclass(frozen=True)
class SnapshotPaths:
    """Where the three documents are stored."""

    hourly: str
    top: str
    recent: str
    versions: str

    @classmethod
    def below(cls, root: str) -> SnapshotPaths:
        return cls(f"{root}/hourly", f"{root}/top", f"{root}/recent", f"{root}/versions")


def current_hour_document(hours: DataFrame, as_of: AsOf) -> DataFrame:
    """The document of the current hour from hourly figures by item.

    It is present, with zeros, also for an hour without orders.
    """
    now = hours.where(F.col("hour_start") == moment(as_of, start_of_hour))
    document = hourly_documents(now).select(
        F.struct("top_drinks", "revenue", "order_count", "drink_counts").alias("d")
    )
    return hours.sparkSession.range(1).select(document.scalar().alias("d")).select(
        moment(as_of, start_of_hour).alias("hour_start"),
        or_empty(F.col("d.top_drinks")).alias("top_drinks"),
        F.coalesce("d.revenue", F.lit(0)).cast("decimal(20,2)").alias("revenue"),
        or_zero(F.col("d.order_count")).cast("bigint").alias("order_count"),
        F.coalesce("d.drink_counts", F.create_map().cast("map<string,bigint>")).alias("drink_counts"),
        moment(as_of).alias("updated_at"),
        moment(as_of, lambda c: c + F.expr(f"interval {HOURLY_TTL}")).alias("expires_at"),
    )


def refresh(spark: SparkSession, orders_root: str, paths: SnapshotPaths, as_of: datetime) -> DataFrame:
    """Recomputes and stores the three documents; returns a one-row summary of the committed version.

    Each has a store of its own; `committed_documents` gives readers all three of one refresh.

    The three inputs are nested time ranges, but each needs other columns of other partitions: the
    30-day part reads two columns, the other two read one hour. Three pruned scans move less than
    one cached copy of 30 days would.
    """
    orders = orders_scan(spark, orders_root)
    at = moment(as_of)
    overwrite_hourly(current_hour_document(hour_items(in_hour(orders, as_of)), as_of), paths.hourly)
    overwrite_top(name_list(top_items_over(orders, as_of)), paths.top, at)
    overwrite_recent(recent_orders(orders, as_of), paths.recent, at)
    stored = stored_documents(spark, paths)
    hour = stored.hourly.where(F.col("hour_start") == moment(as_of, start_of_hour))
    commit(Documents(hour, stored.top, stored.recent), paths.versions, as_of)
    done = committed_documents(spark, paths.versions)
    recent_count = done.recent.agg(F.count("*").alias("n")).scalar()
    names = done.top.select("names").scalar()
    return done.hourly.select(
        "hour_start", "order_count", "revenue", names.alias("top5_drinks"), recent_count.alias("recent_orders_count")
    )


@dataclass(frozen=True)
class Documents:
    hourly: DataFrame
    top: DataFrame
    recent: DataFrame


def stored_documents(spark: SparkSession, paths: SnapshotPaths) -> Documents:
    """The stored documents, under declared schemas."""
    stamps = "updated_at TIMESTAMP, expires_at TIMESTAMP"
    return Documents(
        hourly=spark.read.schema(HOURLY).parquet(paths.hourly),
        top=spark.read.schema(f"names ARRAY<STRING>, {stamps}").parquet(paths.top),
        recent=spark.read.schema(f"{RECENT_ORDER}, {stamps}").parquet(paths.recent),
    )


def commit(documents: Documents, root: str, as_of: datetime, keep: int = 3) -> None:
    """Stores the three documents of one refresh as one row of a new version; the last `keep` versions stay.

    A reader sees all of a version or nothing of it. The documents are bounded: an hour, five names,
    fifty orders.
    """
    spark = documents.hourly.sparkSession
    row = spark.range(1).select(
        documents.hourly.select(F.struct(*HOURLY_FIELDS).alias("d")).scalar().alias("hourly"),
        documents.top.select(F.struct("names", "updated_at", "expires_at").alias("d")).scalar().alias("top"),
        documents.recent.agg(F.array_agg(F.struct(*RECENT_FIELDS)).alias("d")).scalar().alias("recent"),
    )
    version = (as_of if as_of.tzinfo else as_of.replace(tzinfo=UTC)) - datetime(1970, 1, 1, tzinfo=UTC)
    write_version(row, root, version // timedelta(microseconds=1), keep)


def committed_documents(spark: SparkSession, root: str, version: int | None = None) -> Documents:
    """The documents of one version: the newest whole one, or a pinned one."""
    newest = read_version(spark, root, VERSION, version)
    return Documents(
        hourly=newest.where("hourly is not null").select("hourly.*"),
        top=newest.where("top is not null").select("top.*"),
        recent=newest.select(F.inline("recent")),
    )


def computed_documents(orders: DataFrame, as_of: AsOf, n: int = 50) -> Documents:
    """The same three documents as lazy plans, without storing them.

    Each reads only its own time range and columns; the 30-day part reads two of them.
    """
    never = F.lit(None).cast("timestamp").alias("expires_at")
    hourly = hourly_metrics(orders, as_of).select(
        moment(as_of, start_of_hour).alias("hour_start"), "top_drinks", "revenue", "order_count", never
    )
    return Documents(
        hourly=hourly,
        top=name_list(top_items_over(orders, as_of)).select("names", never),
        recent=recent_orders(orders, as_of, n).select("*", never),
    )
