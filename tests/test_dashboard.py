from datetime import timedelta
from decimal import Decimal

import pytest
from conftest import rows_of, utc
from pyspark.sql import functions as F

from orderstream.functions import times
from orderstream.operators import metrics
from orderstream.operators.recent import serialized
from orderstream.plans.dashboard import as_json, dashboard, flattened, from_json
from orderstream.plans.reconcile import drifted_hours, reconcile, repair
from orderstream.plans.refresh import (
    Documents,
    SnapshotPaths,
    computed_documents,
    current_hour_document,
    refresh,
    stored_documents,
)
from orderstream.schemas import DASHBOARD, HOURLY
from orderstream.session import use_utc, work_dir
from orderstream.sinks.snapshots import overwrite_hourly
from orderstream.sources.snapshots import hourly_at

NOW = utc("2025-12-09 10:45:00")


@pytest.fixture
def store(spark, five_orders, tmp_path):
    root = str(tmp_path / "orders")
    five_orders.withColumn("order_date", F.to_date("ts")).write.partitionBy("order_date").parquet(f"{root}/batch_id=0")
    return root, SnapshotPaths.below(str(tmp_path))


def test_refresh_stores_what_the_dashboard_shows(spark, store, five_orders):
    root, paths = store
    summary = refresh(spark, root, paths, NOW).first()
    assert (summary.order_count, summary.revenue, summary.recent_orders_count) == (5, Decimal("24.75"), 5)
    assert summary.top5_drinks == ["cappuccino", "americano", "latte"]
    shown = dashboard(stored_documents(spark, paths), NOW).first()
    assert (shown.current_hour.hour, shown.current_hour.order_count, shown.current_hour.revenue) == (10, 5, 24.75)
    assert shown.top5_drinks == summary.top5_drinks
    assert [o.id for o in shown.recent_orders] == [5, 4, 3, 2, 1]
    assert shown.recent_orders[0].timestamp == "2025-12-09T10:30:00"
    assert rows_of(flattened(dashboard(computed_documents(five_orders, NOW), NOW))) == rows_of(flattened(dashboard(stored_documents(spark, paths), NOW)))


def test_stored_hour_keeps_counts_and_repeats_safely(spark, store):
    root, paths = store
    for _ in range(2):
        refresh(spark, root, paths, NOW)
    doc = stored_documents(spark, paths).hourly.first()
    assert doc.drink_counts == {"cappuccino": 3, "latte": 1, "americano": 1}
    refresh(spark, root, paths, NOW + timedelta(hours=1))
    hours = stored_documents(spark, paths).hourly
    assert rows_of(hours.select(F.hour("hour_start").alias("h"), "order_count")) == [(10, 5), (11, 0)]


def test_documents_expire_after_their_lifetimes(spark, store):
    root, paths = store
    refresh(spark, root, paths, NOW)
    docs = stored_documents(spark, paths)
    later = dashboard(docs, NOW + timedelta(hours=1, minutes=59)).first()
    assert later.current_hour is None and len(later.recent_orders) == 5  # another hour; list still fresh
    later = dashboard(docs, NOW + timedelta(hours=2)).first()
    assert later.recent_orders == [] and later.top5_drinks == ["cappuccino", "americano", "latte"]
    assert hourly_at(docs.hourly, NOW).count() == 1
    assert hourly_at(docs.hourly, NOW + timedelta(days=1)).count() == 0  # same hour of day, next day


def test_nothing_stored_yet(spark, five_orders):
    docs = computed_documents(five_orders, NOW)
    none = Documents(docs.hourly.limit(0), docs.top.limit(0), docs.recent.limit(0))
    row = dashboard(none, NOW).first()
    assert row.current_hour is None and row.top5_drinks == [] and row.recent_orders == []
    part = dashboard(Documents(docs.hourly.limit(0), docs.top, docs.recent.limit(0)), NOW).first()
    assert part.current_hour is None and part.top5_drinks == ["cappuccino", "americano", "latte"] and part.recent_orders == []
    assert flattened(dashboard(none, NOW)).count() == 0


def test_document_survives_json(spark, five_orders):
    document = dashboard(computed_documents(five_orders, NOW), NOW)
    back = from_json(as_json(document), DASHBOARD).first()
    assert back.recent_orders == document.first().recent_orders
    assert back.current_hour == document.first().current_hour


def test_an_order_without_a_price_is_listed(orders_of):
    orders = orders_of([("latte", "uptown", None, "2025-12-09 10:30:00")])
    assert dashboard(computed_documents(orders, NOW), NOW).first().recent_orders[0].price is None
    assert serialized(orders).first().price is None


def test_current_hour_document_without_orders(five_orders):
    doc = current_hour_document(metrics.hour_items(five_orders), utc("2025-12-09 15:00:00")).first()
    assert (doc.order_count, doc.revenue, doc.top_drinks, doc.drink_counts) == (0, Decimal("0.00"), [], {})


def test_reconcile_finds_and_repairs_drift(spark, orders_of, tmp_path):
    orders = orders_of([("latte", "uptown", 1, f"2025-12-09 {h:02d}:10:00") for h in range(5)])
    items = metrics.hour_items(orders)
    assert drifted_hours(reconcile(items, orders)).count() == 0
    broken = items.withColumn("order_count", F.when(F.hour("hour_start") == 3, 9).otherwise(F.col("order_count")))
    found = reconcile(broken, orders)
    assert [r.hour_start.hour for r in drifted_hours(found).collect()] == [3]
    root = str(tmp_path / "hourly")
    overwrite_hourly(metrics.hourly_documents(broken), root)
    repair(found, orders, root)
    stored = spark.read.schema(HOURLY).parquet(root)
    assert rows_of(stored, "hour_start", "order_count") == rows_of(metrics.hourly_documents(items), "hour_start", "order_count")



def test_newest_is_exact(spark, orders_of):
    orders = orders_of([("latte", "uptown", 1, "2025-12-09 10:30:00.123457")])
    assert times.newest(orders) == utc("2025-12-09 10:30:00.123457")
    assert orders.where(F.col("ts") == times.moment(times.newest(orders))).count() == 1


def test_work_dir_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = work_dir(spark, "x")
    assert folder != work_dir(spark, "x")
    if named:
        assert folder.startswith(named.rstrip("/") + "/orderstream/x-")


def test_sessions_are_switched_to_utc(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    assert use_utc(other).conf.get("spark.sql.session.timeZone") == "UTC"
