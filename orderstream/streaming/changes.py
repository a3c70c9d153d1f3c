"""What has changed on the dashboard since it was last sent, part by part.

The sink keeps the digests of the parts it sent last. A refresh compares its parts with those of the
refresh before and stores only what differs, so a repeated refresh sends the same again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderstream.plans.refresh import Documents
from orderstream.sinks.batches import write_batch
from orderstream.sources.tables import ensure_table, read_batch

PART = "part STRING, payload STRING, digest STRING"
CHANGE = "part STRING, payload STRING, batch_id BIGINT"
DIGEST = "part STRING, digest STRING, batch_id BIGINT"
PARTS = ("hourly", "top", "recent")

# What counts as a change. When a document was made does not; the recent list is compared by whole orders.
_HOURLY = ("hour_start", "top_drinks", "revenue", "order_count")
_RECENT = ("id", "drink", "store", "price", "ts")


def _payload(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def parts_of(documents: Documents) -> DataFrame:
    """One row per part of the dashboard: its content and a digest of it. A missing part has no content."""
    spark = documents.hourly.sparkSession
    orders = F.array_agg(F.struct(F.col("ts").alias("_ts"), F.col("id").alias("_id"), F.struct(*_RECENT).alias("order")))
    newest_first = F.reverse(F.array_sort(orders))  # fifty orders at most
    payloads = {
        "hourly": documents.hourly.select(_payload(F.struct(*_HOURLY)).alias("p")),
        "top": documents.top.select(_payload(F.struct("names")).alias("p")),
        "recent": documents.recent.agg(_payload(F.struct(F.transform(newest_first, lambda x: x["order"]).alias("orders"))).alias("p")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("part"), payloads[k].scalar().alias("payload")) for k in PARTS])
    parts = spark.range(1).select(F.inline(rows))
    return parts.withColumn("digest", F.sha2(F.coalesce("payload", F.lit("")), 256))


def _sent_before(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """The digests of the refresh before, whose folder is read directly where there is no gap."""
    try:
        return read_batch(spark, f"{root}/digests", DIGEST, batch_id - 1)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    earlier = ensure_table(spark, f"{root}/digests", DIGEST).where(F.col("batch_id") < batch_id)
    return earlier.where(F.col("batch_id") == earlier.agg(F.max("batch_id").alias("b")).scalar())


def send_changes(documents: Documents, root: str, batch_id: int) -> None:
    """Stores the parts of a refresh that differ from the refresh before it, and what it has sent in all.

    The parts are evaluated once. Digests come last: a refresh that ended before them is compared
    with the same predecessor again.
    """
    spark = documents.hourly.sparkSession
    write_batch(parts_of(documents).coalesce(1), f"{root}/parts", batch_id)
    parts = read_batch(spark, f"{root}/parts", PART + ", batch_id BIGINT", batch_id).drop("batch_id")
    before = _sent_before(spark, root, batch_id).select("part", F.col("digest").alias("sent"))
    changed = parts.join(before, "part", "left").where(~F.col("digest").eqNullSafe(F.col("sent")))
    write_batch(changed.select("part", "payload"), f"{root}/changes", batch_id)
    write_batch(parts.select("part", "digest"), f"{root}/digests", batch_id)


def changes(spark: SparkSession, root: str) -> DataFrame:
    """All changes so far, with the refresh that sent them."""
    return ensure_table(spark, f"{root}/changes", CHANGE)


def sent_state(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """What a client that got every change has: the newest content of each part."""
    log = changes(spark, root)
    if upto is not None:
        log = log.where(F.col("batch_id") <= upto)
    return log.groupBy("part").agg(F.max_by("payload", "batch_id").alias("payload"))
