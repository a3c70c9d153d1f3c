"""Order metrics. Money is summed exactly, as decimals; rounding is for presentation only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderstream.functions.times import AsOf, back, moment
from orderstream.functions.values import add_maps, amount, or_empty, or_zero, top_keys
from orderstream.operators.ranges import between, in_hour, trailing
from orderstream.schemas import HOURLY_TTL


def _revenue(price: str = "price") -> Column:
    return F.sum(amount(F.col(price))).cast("decimal(20,2)")


def totals(orders: DataFrame, *keys: str) -> DataFrame:
    """Order count and revenue, overall or per key. Rows with a null key are left out."""
    for key in keys:
        orders = orders.where(F.col(key).isNotNull())
    return orders.groupBy(*keys).agg(
        F.count("*").alias("order_count"),
        F.coalesce(_revenue(), F.lit(0).cast("decimal(20,2)")).alias("revenue"),
    )


def popularity(orders: DataFrame, item: str = "drink") -> DataFrame:
    """Per item: order count and time of the newest order, which decides ties."""
    return (
        orders.where(F.col(item).isNotNull())
        .groupBy(item)
        .agg(F.count("*").alias("order_count"), F.max("ts").alias("last_ts"))
    )


def ranked(popular: DataFrame, n: int, item: str = "drink") -> DataFrame:
    """The n most popular items with their rank, 1 first. Ties: newest order, then name."""
    order = [F.col("order_count").desc(), F.col("last_ts").desc(), F.col(item)]
    best = popular.orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def top_items(orders: DataFrame, n: int = 5, item: str = "drink") -> DataFrame:
    return ranked(popularity(orders, item), n, item)


def top_items_over(orders: DataFrame, as_of: AsOf, span: str = "30 days", n: int = 5) -> DataFrame:
    return top_items(trailing(orders, as_of, span), n)


def top_items_keyed(orders: DataFrame, lookup: DataFrame, key: str, n: int = 5, item: str = "drink") -> DataFrame:
    """Top items where the item has to be looked up by a key.

    Orders are counted per key before the join, so the join moves one row per key instead of one
    per order, and a key that holds a large part of all orders is already one row.
    """
    per_key = popularity(orders, key)
    per_item = (
        per_key.join(lookup, key)
        .groupBy(item)
        .agg(F.sum("order_count").alias("order_count"), F.max("last_ts").alias("last_ts"))
    )
    return ranked(per_item, n, item)


def name_list(ranked_items: DataFrame, item: str = "drink") -> DataFrame:
    """One cell: the names of an already limited ranking, in rank order; empty when there are none."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", item)))
    return ranked_items.agg(F.transform(pairs, lambda p: p[item]).alias("names"))


def hourly_metrics(orders: DataFrame, as_of: AsOf, hour: int | None = None, n: int = 5) -> DataFrame:
    """One row for one hour, also when it has no orders: top items, revenue, order count."""
    in_range = in_hour(orders, as_of, hour)
    names = name_list(top_items(in_range, n)).scalar()
    return totals(in_range).select(or_empty(names).alias("top_drinks"), "revenue", "order_count")


def hour_items(orders: DataFrame) -> DataFrame:
    """Per hour and item: count, revenue, newest order. The additive form of the hourly metrics.

    On a stream the hour is a window, so that its state ends with the watermark. In batch it is a
    plain column, so that a later join on it finds the rows already partitioned.
    """
    figures = [F.count("*").alias("order_count"), _revenue().alias("revenue"), F.max("ts").alias("last_ts")]
    if not orders.isStreaming:
        return orders.groupBy(F.date_trunc("hour", "ts").alias("hour_start"), "drink").agg(*figures)
    windows = orders.groupBy(F.window("ts", "1 hour").alias("w"), "drink").agg(*figures)
    return windows.select(F.col("w.start").alias("hour_start"), "drink", "order_count", "revenue", "last_ts")


def merge_hour_items(*parts: DataFrame) -> DataFrame:
    """Adds additive hourly parts; the same as aggregating their orders together."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("hour_start", "drink").agg(
        F.sum("order_count").alias("order_count"),
        F.sum("revenue").cast("decimal(20,2)").alias("revenue"),
        F.max("last_ts").alias("last_ts"),
    )


def hourly_documents(items: DataFrame, n: int = 5) -> DataFrame:
    """Per hour the stored document, from the additive form.

    An order without an item counts in the totals and is in no map. The document's map holds one
    entry per item by definition; the ranking is read off the same entries.
    """
    entry = F.when(
        F.col("drink").isNotNull(),
        F.struct((-F.col("order_count")).alias("o"), (-F.unix_micros("last_ts")).alias("l"), "drink", "order_count"),
    )
    docs = items.groupBy("hour_start").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"),
        F.sum("revenue").cast("decimal(20,2)").alias("revenue"),
        F.sum("order_count").alias("order_count"),
        F.max("last_ts").alias("updated_at"),
    )
    return docs.select(
        "hour_start",
        F.transform(F.slice("entries", 1, n), lambda e: e["drink"]).alias("top_drinks"),
        "revenue",
        "order_count",
        F.map_from_entries(F.transform("entries", lambda e: F.struct(e["drink"], e["order_count"]))).alias(
            "drink_counts"
        ),
        "updated_at",
        (F.col("updated_at") + F.expr(f"interval {HOURLY_TTL}")).alias("expires_at"),
    )


def window_items(orders: DataFrame, size: str = "1 second", ts: str = "ts") -> DataFrame:
    """Per tumbling window, store and item: count and revenue. Batch or streaming."""
    return (
        orders.groupBy(F.window(ts, size).alias("w"), "store", "drink")
        .agg(F.count("*").alias("order_count"), _revenue().alias("revenue"))
        .select("w.start", "w.end", "store", "drink", "order_count", "revenue")
        .withColumnsRenamed({"start": "window_start", "end": "window_end"})
    )


def merge_window_items(items: DataFrame) -> DataFrame:
    """Adds additive window figures of several batches."""
    return items.groupBy("window_start", "window_end", "store", "drink").agg(
        F.sum("order_count").alias("order_count"), F.sum("revenue").cast("decimal(20,2)").alias("revenue")
    )


def window_stats(items: DataFrame) -> DataFrame:
    """Per tumbling window and store the totals with count and revenue maps by item and store."""
    keyed = items.groupBy("window_start", "window_end", "store").agg(
        F.sum("order_count").alias("total_orders"),
        F.sum("revenue").cast("decimal(20,2)").alias("total_revenue"),
        F.collect_list(
            F.when(F.col("drink").isNotNull(), F.struct("drink", "order_count", "revenue"))
        ).alias("entries"),
    )
    no_counts = F.create_map().cast("map<string,bigint>")
    no_money = F.create_map().cast("map<string,decimal(20,2)>")
    return keyed.select(
        "window_start",
        "window_end",
        "store",
        "total_orders",
        "total_revenue",
        F.map_from_entries(F.transform("entries", lambda e: F.struct(e["drink"], e["order_count"]))).alias("drink_counts"),
        F.map_from_entries(F.transform("entries", lambda e: F.struct(e["drink"], e["revenue"]))).alias("drink_revenue"),
        F.when(F.col("store").isNull(), no_counts)
        .otherwise(F.create_map("store", "total_orders"))
        .alias("store_counts"),
        F.when(F.col("store").isNull(), no_money)
        .otherwise(F.create_map("store", "total_revenue"))
        .alias("store_revenue"),
    )


def merged_document(stored: DataFrame, added: DataFrame, n: int = 5) -> DataFrame:
    """Stored hourly documents plus newly counted ones, key-wise.

    Documents of an hour only one side has are taken as they are.
    """
    a, b = stored.alias("a"), added.alias("b")
    both = a.join(b, F.col("a.hour_start") == F.col("b.hour_start"), "full_outer")
    counts = add_maps(F.col("a.drink_counts"), F.col("b.drink_counts"))
    zero = F.lit(0).cast("decimal(20,2)")
    return both.select(
        F.coalesce("a.hour_start", "b.hour_start").alias("hour_start"),
        top_keys(counts, n).alias("top_drinks"),
        (F.coalesce("a.revenue", zero) + F.coalesce("b.revenue", zero)).cast("decimal(20,2)").alias("revenue"),
        (or_zero(F.col("a.order_count")) + or_zero(F.col("b.order_count"))).alias("order_count"),
        counts.alias("drink_counts"),
    )


def daily_items(orders: DataFrame) -> DataFrame:
    """Per day and item: count and newest order; enough to answer any whole-day part of a range."""
    return (
        orders.where(F.col("drink").isNotNull())
        .groupBy(F.to_date("ts").alias("order_date"), "drink")
        .agg(F.count("*").alias("order_count"), F.max("ts").alias("last_ts"))
    )


def daily_from_hours(hours: DataFrame) -> DataFrame:
    """The same daily counts from hourly ones, such as those an ingest keeps."""
    return (
        hours.where(F.col("drink").isNotNull())
        .groupBy(F.to_date("hour_start").alias("order_date"), "drink")
        .agg(F.sum("order_count").alias("order_count"), F.max("last_ts").alias("last_ts"))
    )


def top_items_rolled(daily: DataFrame, orders: DataFrame, as_of: AsOf, span: str, n: int = 5) -> DataFrame:
    """`top_items_over` from daily counts.

    Days that lie wholly inside the range come from the daily table; only the first, partial day
    is read from the orders, so the cut-off stays exact without scanning the whole range.
    """

    def first_day(c: Column) -> Column:
        return back(span)(c).cast("date")

    def next_midnight(c: Column) -> Column:
        return F.date_add(first_day(c), 1).cast("timestamp")

    whole = daily.where(F.col("order_date") > moment(as_of, first_day)).select("drink", "order_count", "last_ts")
    partial = popularity(between(orders, as_of, back(span), next_midnight))
    total = (
        whole.unionByName(partial)
        .groupBy("drink")
        .agg(F.sum("order_count").alias("order_count"), F.max("last_ts").alias("last_ts"))
    )
    return ranked(total, n)


def item_counter(orders: DataFrame) -> DataFrame:
    """Orders by item, store and API version."""
    return orders.groupBy("drink", "store", "version").agg(F.count("*").alias("order_count"))
