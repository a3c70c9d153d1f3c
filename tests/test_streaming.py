import json
from datetime import timedelta

import pytest
from conftest import ORDER_ROW, rows_of, utc
from pyspark.sql import functions as F

from orderstream.operators import metrics
from orderstream.operators.parsing import checked, parse_events, valid
from orderstream.plans.dashboard import dashboard, flattened
from orderstream.plans.reconcile import reconcile
from orderstream.plans.refresh import Documents, computed_documents
from orderstream.schemas import HOUR_ITEM, Domains
from orderstream.sinks.batches import compact, merge_batches, write_batch
from orderstream.sinks.snapshots import rolled_recent
from orderstream.sources.streams import folder_stream
from orderstream.streaming import job
from orderstream.streaming.common import keep_changes, start
from orderstream.streaming.dashboard import start_dashboard
from orderstream.streaming.dedup import deduplicated
from orderstream.streaming.ingest import Store, current_hour_items, current_window_items, ingest_batch, ingested_documents, start_ingest

RECORD = "arrival BIGINT, value STRING, ingest_ts TIMESTAMP"
DOMAINS = Domains()


def event(i, drink="latte", store="uptown", price="4.50", minute=None, message_id=..., version="v3"):
    ts = utc("2025-12-09 08:00:00") + timedelta(minutes=i if minute is None else minute)
    return json.dumps(
        {
            "message_id": f"m{i}" if message_id is ... else message_id,
            "drink": drink,
            "store": store,
            "price": price,
            "timestamp": ts.isoformat(),
            "version": version,
        }
    )


def records(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, utc("2025-12-09 20:00:00")) for i, t in enumerate(texts)], RECORD)


DRINKS = ("latte", "americano", "cappuccino")


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Four files in order: orders over three hours, with repeats, faults and other versions among them."""
    folder = tmp_path_factory.mktemp("stream") / "feed"
    texts = []
    for i in range(120):
        texts.append(event(i, DRINKS[i % 3], ("uptown", "downtown")[i % 2], version=f"v{2 + i % 2}"))
        if i % 10 == 0:
            texts.append(texts[-1])
        if i % 17 == 0:
            texts += ["{broken", event(1000 + i, drink="tea")]
    for n in range(4):
        part = texts[n * len(texts) // 4 : (n + 1) * len(texts) // 4]
        records(spark, part, n * 1000).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder), texts


def run(*queries):
    for q in queries:
        q.awaitTermination()


def batch_truth(spark, texts):
    orders = valid(checked(parse_events(records(spark, texts)), DOMAINS)).dropDuplicates(["message_id"])
    return orders


HOURS = ("hour_start", "drink", "order_count", "revenue")


@pytest.fixture(scope="module")
def ingested(spark, feed, tmp_path_factory):
    """The feed, ingested in four batches."""
    store = Store(str(tmp_path_factory.mktemp("ingest") / "store"))
    run(start_ingest(folder_stream(spark, feed[0], RECORD, files_per_batch=1), store, DOMAINS))
    return store


def test_ingest_in_batches_equals_one_batch(spark, feed, ingested):
    store, texts = ingested, feed[1]
    truth = batch_truth(spark, texts)
    orders = store.table(spark, "orders")
    assert rows_of(orders, "message_id", "drink", "store", "price", "ts") == rows_of(truth, "message_id", "drink", "store", "price", "ts")
    assert sorted(r.id for r in orders.select("id").collect()) == list(range(1, 121))
    assert [r.id for r in orders.orderBy("arrival").collect()] == list(range(1, 121))
    assert rows_of(current_hour_items(store, spark), *HOURS) == rows_of(metrics.hour_items(truth), *HOURS)
    sums = store.table(spark, "outcomes").agg(F.sum("inserted"), F.sum("skipped"), F.sum("quarantined"), F.max("max_id"), F.count("*")).first()
    assert tuple(sums) == (120, 12, 16, 120, 4)
    assert {r.reason for r in store.quarantine(spark).collect()} == {"malformed", "drink not in domain"}
    assert [r.id for r in rolled_recent(store.table(spark, "recent")).collect()] == list(range(111, 121))


def test_a_repeated_batch_changes_nothing(spark, feed, tmp_path):
    _, texts = feed
    store = Store(str(tmp_path / "store"))
    half = len(texts) // 2
    parts = [records(spark, texts[:half]), records(spark, texts[half:], half)]

    def contents():
        tables = [store.table(spark, t) for t in ("orders", "outcomes", "recent", "events")]
        return [rows_of(t) for t in (*tables, current_hour_items(store, spark))]

    for n, part in enumerate(parts):
        ingest_batch(part, n, store, DOMAINS)
    once = contents()
    ingest_batch(parts[1], 1, store, DOMAINS)
    assert contents() == once


def test_redelivery_under_a_new_batch_inserts_nothing(spark, feed, tmp_path):
    _, texts = feed
    store = Store(str(tmp_path / "store"))
    for n, horizon in enumerate((None, None, 1)):
        ingest_batch(records(spark, texts, n * 1000), n, store, DOMAINS, horizon_days=horizon)
    rows = rows_of(store.table(spark, "outcomes"), "batch_id", "inserted", "skipped", "max_id")
    assert rows == [(0, 120, 12, 120), (1, 0, 132, 120), (2, 0, 132, 120)]


def test_a_gap_in_the_batch_numbers(spark, tmp_path):
    """Ids and the rolling list continue from whatever batch was stored last."""
    store = Store(str(tmp_path / "store"))
    ingest_batch(records(spark, [event(1), event(2)]), 3, store, DOMAINS)
    ingest_batch(records(spark, [event(2), event(3)], 10), 9, store, DOMAINS)
    assert rows_of(store.table(spark, "outcomes"), "batch_id", "inserted", "skipped", "max_id") == [(3, 2, 0, 2), (9, 1, 1, 3)]
    assert [r.id for r in rolled_recent(store.table(spark, "recent")).collect()] == [1, 2, 3]


def test_a_batch_of_only_faults(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    ingest_batch(records(spark, ["{broken", ""]), 0, store, DOMAINS)
    ingest_batch(records(spark, [event(1)], 10), 1, store, DOMAINS)
    ingest_batch(records(spark, ["", "{"], 20), 2, store, DOMAINS)
    assert rows_of(store.table(spark, "outcomes"), "batch_id", "inserted", "quarantined", "max_id") == [(0, 0, 2, 0), (1, 1, 0, 1), (2, 0, 2, 1)]
    assert [r.id for r in rolled_recent(store.table(spark, "recent")).collect()] == [1]


def test_restart_continues_from_the_checkpoint(spark, tmp_path):
    folder, store = str(tmp_path / "feed"), Store(str(tmp_path / "store"))
    for n in range(2):
        records(spark, [event(n * 10 + i) for i in range(10)], n * 10).coalesce(1).write.mode("append").parquet(folder)
        run(start_ingest(folder_stream(spark, folder, RECORD), store, DOMAINS))
    assert rows_of(store.table(spark, "outcomes"), "batch_id", "inserted", "skipped") == [(0, 10, 0), (1, 10, 0)]


def test_a_failing_batch_stops_the_query_and_is_retried(spark, tmp_path):
    folder, out = str(tmp_path / "feed"), str(tmp_path / "out")
    records(spark, [event(1)]).write.parquet(folder)

    def fail(_, __):
        raise RuntimeError("sink down")

    stream = folder_stream(spark, folder, RECORD)
    with pytest.raises(Exception, match="sink down"):
        start(stream, fail, str(tmp_path / "checkpoint")).awaitTermination()
    run(start(stream, keep_changes(out), str(tmp_path / "checkpoint")))
    assert spark.read.parquet(out).count() == 1


def test_job_equals_batch_over_many_batches(spark, feed, tmp_path):
    folder, texts = feed
    store = Store(str(tmp_path / "job"))
    stream = folder_stream(spark, folder, RECORD, files_per_batch=1)
    run(job.start_job(stream, store, DOMAINS, window="1 minute"))
    truth = batch_truth(spark, texts).where("version = 'v3'")
    hours = current_hour_items(store, spark)
    assert rows_of(hours, *HOURS) == rows_of(metrics.hour_items(truth), *HOURS)
    windows = metrics.window_stats(current_window_items(store, spark))
    columns = ("window_start", "store", "total_orders", "total_revenue", "drink_counts", "store_counts")
    assert rows_of(windows, *columns) == rows_of(metrics.window_stats(metrics.window_items(truth, "1 minute")), *columns)
    assert rows_of(store.table(spark, "orders"), "message_id") == rows_of(truth, "message_id")
    assert reconcile(hours, truth).where("status <> 'same'").count() == 0


def order_files(spark, folder, *files):
    for n, rows in enumerate(files):
        data = [(n * 100 + i, n * 100 + i, m, "latte", "uptown", None, utc(t), "v3") for i, (m, t) in enumerate(rows)]
        spark.createDataFrame(data, ORDER_ROW).coalesce(1).write.mode("append").parquet(folder)
    return folder_stream(spark, folder, ORDER_ROW, files_per_batch=1)


@pytest.mark.parametrize("salts", [0, 3])
def test_hot_and_missing_ids_in_a_stream(spark, tmp_path, salts):
    at = "2025-12-09 10:00:00"
    one = [("hot", at)] * 50 + [(None, at)] * 5 + [("a", at)]
    stream = order_files(spark, str(tmp_path / "in"), one, [("hot", at)] * 50 + [(None, at)] * 5 + [("b", at)])
    run(start(deduplicated(stream, "1 hour", salts), keep_changes(str(tmp_path / "out")), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("message_id").count()
    assert rows_of(got) == sorted([("hot", 1), ("a", 1), ("b", 1), (None, 10)], key=str)


def test_late_rows_are_dropped_counted_and_repaired(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = order_files(
        spark, folder, [("a", "2025-12-09 10:00:00")], [("b", "2025-12-09 14:00:00")], [("c", "2025-12-09 14:30:00")], [("late", "2025-12-09 10:05:00")]
    )
    q = job.start_hours(deduplicated(stream, "1 hour"), out, str(tmp_path / "cp"))
    run(q)
    assert job.late_rows(q) == 1
    orders = spark.read.schema(ORDER_ROW).parquet(folder)
    found = reconcile(job.stored_hours(spark, out), orders).where("status <> 'same'")
    assert rows_of(found, "order_count_before", "order_count_after") == [(1, 2)]


def test_the_job_counts_late_rows(spark, tmp_path):
    """An order days older than the newest is counted, and its copy in a later batch is not."""
    store, folder = Store(str(tmp_path / "job")), str(tmp_path / "in")
    for n, minute in enumerate((0, 6000, 5, 5)):
        records(spark, [event(n, minute=minute, message_id=f"m{minute}")], n).coalesce(1).write.mode("append").parquet(folder)
    run(job.start_job(folder_stream(spark, folder, RECORD, files_per_batch=1), store, DOMAINS, window="1 day"))
    assert rows_of(current_hour_items(store, spark), "order_count") == [(1,), (2,)]
    assert rows_of(current_window_items(store, spark), "order_count") == [(1,), (2,)]


def test_figures_by_arrival_time(spark, tmp_path):
    texts = [event(0), event(60)]
    orders = checked(parse_events(records(spark, texts)), DOMAINS)
    by_arrival = metrics.hour_items(job.with_arrival_time(orders))
    assert rows_of(by_arrival.select(F.hour("hour_start").alias("h"), "order_count")) == [(20, 2)]


def test_dashboard_from_ingest_equals_a_full_scan(spark, ingested):
    orders = ingested.table(spark, "orders")
    for now in (utc("2025-12-09 09:40:00"), utc("2026-01-08 08:30:00"), utc("2026-01-08 09:15:30")):
        quick = flattened(dashboard(ingested_documents(ingested, spark, now), now))
        assert rows_of(quick) == rows_of(flattened(dashboard(computed_documents(orders, now), now)))


def test_compaction_keeps_the_figures(spark, ingested, tmp_path):
    store = ingested
    new_root = str(tmp_path / "compacted")
    log = str(tmp_path / "log")
    for n in range(4):
        inserted = store.table(spark, "orders").where(F.col("batch_id") == n)
        write_batch(metrics.hour_items(inserted), log, n)
    log = spark.read.schema(HOUR_ITEM).parquet(log)
    sums = {
        "order_count": F.sum("order_count"),
        "revenue": F.sum("revenue").cast("decimal(20,2)"),
        "last_ts": F.max("last_ts"),
    }
    compact(log, ["hour_start", "drink"], new_root, 2, sums)
    write_batch(log.where("batch_id = 3").drop("batch_id"), new_root, 3)
    compacted = spark.read.schema(HOUR_ITEM).parquet(new_root).drop("batch_id")
    assert rows_of(metrics.merge_hour_items(compacted), *HOURS) == rows_of(current_hour_items(store, spark), *HOURS)
    merge_batches(store.table(spark, "orders"), str(tmp_path / "merged"), 3, ("order_date",))
    moved = Store(store.root, orders=str(tmp_path / "merged"))
    columns = ("id", "message_id", "ts", "order_date")
    assert rows_of(moved.table(spark, "orders"), *columns) == rows_of(store.table(spark, "orders"), *columns)
    assert {r.batch_id for r in moved.table(spark, "orders").select("batch_id").collect()} == {3}
    values = str(tmp_path / "values")
    for n, (a, b) in enumerate([(1, 1), (2, None), (None, 5)]):
        rows = [(k, v) for k, v in (("a", a), ("b", b)) if v is not None]
        write_batch(spark.createDataFrame(rows, "k STRING, v INT"), values, n)
    compact(spark.read.parquet(values), ["k"], str(tmp_path / "latest"), 2)
    assert rows_of(spark.read.parquet(str(tmp_path / "latest")), "k", "v") == [("a", 2), ("b", 5)]


def test_dashboard_is_refreshed_with_the_stream(spark, five_orders, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    records(spark, ["x"]).write.parquet(folder)

    def documents(now) -> Documents:
        return computed_documents(five_orders, now)

    stream = folder_stream(spark, folder, RECORD)
    run(start_dashboard(stream, documents, lambda: utc("2025-12-09 10:45:00"), root, str(tmp_path / "cp"), every=None))
    stored = json.loads(spark.read.parquet(root).first().json)
    assert stored["current_hour"]["order_count"] == 5 and len(stored["recent_orders"]) == 5
