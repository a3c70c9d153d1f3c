"""The dashboard document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderstream.functions.times import AsOf, iso_text, moment
from orderstream.functions.values import money, or_empty, or_zero
from orderstream.operators.ranges import fresh
from orderstream.plans.refresh import Documents
from orderstream.sources.snapshots import hourly_at


def dashboard(documents: Documents, as_of: AsOf) -> DataFrame:
    """One row. The hourly part is null when missing or expired; the lists are then empty.

    Each part is at most one document, so it enters as a scalar subquery and nothing is joined.
    """
    hour = hourly_at(documents.hourly, as_of).select(
        F.struct(
            F.hour("hour_start").alias("hour"),
            or_empty(F.col("top_drinks")).alias("top_drinks"),
            F.coalesce(money(F.col("revenue")), F.lit(0.0)).alias("revenue"),
            or_zero(F.col("order_count")).alias("order_count"),
        ).alias("current_hour")
    )
    names = fresh(documents.top, as_of).select("names")
    # The list is limited before it is gathered; newest first, as it was stored.
    recent = (
        fresh(documents.recent, as_of)
        .select(F.struct((-F.unix_micros("ts")).alias("o"), (-F.col("id")).alias("i"), *_serialized_fields()).alias("e"))
        .agg(F.array_sort(F.collect_list("e")).alias("list"))
        .select(F.transform("list", lambda e: F.struct(*[e[c].alias(c) for c in _FIELDS])).alias("list"))
    )
    base = documents.hourly.sparkSession.range(1)
    no_orders = F.array().cast("array<struct<id:bigint,drink:string,store:string,price:double,timestamp:string>>")
    return base.select(
        hour.scalar().alias("current_hour"),
        or_empty(names.scalar()).alias("top5_drinks"),
        F.coalesce(recent.scalar(), no_orders).alias("recent_orders"),
        moment(as_of).alias("server_timestamp"),
    )


_FIELDS = ("id", "drink", "store", "price", "timestamp")


def _serialized_fields():
    return [
        F.col("id"),
        F.col("drink"),
        F.col("store"),
        F.col("price").cast("double").alias("price"),
        iso_text(F.col("ts")).alias("timestamp"),
    ]


def as_json(document: DataFrame) -> DataFrame:
    """The document as JSON text."""
    return document.select(F.to_json(F.struct(*document.columns)).alias("json"))


def from_json(text: DataFrame, schema: str) -> DataFrame:
    """A stored JSON document back as columns."""
    return text.select(F.from_json("json", schema).alias("d")).select("d.*")


def flattened(document: DataFrame) -> DataFrame:
    """The document as rows: one for the hour, one per listed item, one per recent order."""
    text = F.lit(None).cast("string")
    number = F.lit(None).cast("double")
    hour = document.where(F.col("current_hour").isNotNull()).select(
        F.lit("current_hour").alias("section"),
        F.lit(1).cast("bigint").alias("rank"),
        F.array_join("current_hour.top_drinks", ",").alias("name"),
        F.col("current_hour.hour").cast("string").alias("detail"),
        F.col("current_hour.revenue").alias("amount"),
        F.col("current_hour.order_count").cast("double").alias("number"),
    )
    top = document.select(F.posexplode("top5_drinks").alias("pos", "drink")).select(
        F.lit("top5").alias("section"),
        (F.col("pos") + 1).cast("bigint").alias("rank"),
        F.col("drink").alias("name"),
        text.alias("detail"),
        number.alias("amount"),
        number.alias("number"),
    )
    recent = document.select(F.posexplode("recent_orders").alias("pos", "o")).select(
        F.lit("recent").alias("section"),
        (F.col("pos") + 1).cast("bigint").alias("rank"),
        F.col("o.drink").alias("name"),
        F.concat_ws("|", "o.store", "o.timestamp").alias("detail"),
        F.col("o.price").alias("amount"),
        F.col("o.id").cast("double").alias("number"),
    )
    return hour.unionByName(top).unionByName(recent)
