"""Versions of the dashboard, what a refresh sends, and state of the deduplication."""

import json

import pytest
from conftest import rows_of, utc
from pyspark.sql import functions as F
from test_streaming import RECORD, order_files, records, run

from orderstream.plans.refresh import computed_documents
from orderstream.sinks.batches import write_batch
from orderstream.sinks.versions import newest_version, read_version, write_version
from orderstream.sources.streams import folder_stream
from orderstream.streaming import changes as changes_module
from orderstream.streaming.changes import changes, send_changes, sent_state
from orderstream.streaming.common import keep_changes, start
from orderstream.streaming.dashboard import start_dashboard, stored_dashboard
from orderstream.streaming.dedup import deduplicated

NOW = utc("2025-12-09 10:45:00")


def sent(spark, root):
    return sorted((r.batch_id, r.part) for r in changes(spark, root).collect())


def test_only_what_has_changed_is_sent(spark, five_orders, orders_of, tmp_path):
    root = str(tmp_path / "changes")
    more = five_orders.unionByName(orders_of([("cappuccino", "uptown", "4.75", "2025-12-09 10:40:00")], start=6))
    for n, orders in enumerate((five_orders, five_orders, more, more)):
        send_changes(computed_documents(orders, NOW), root, n)
    assert sent(spark, root) == [(0, "hourly"), (0, "recent"), (0, "top"), (2, "hourly"), (2, "recent")]
    send_changes(computed_documents(more, utc("2026-03-09 10:45:00")), root, 4)
    assert [p for n, p in sent(spark, root) if n == 4] == ["hourly", "recent", "top"]
    state = {r.part: json.loads(r.payload) for r in sent_state(spark, root, upto=3).collect()}
    assert state["hourly"]["order_count"] == 6 and state["top"]["names"] == ["cappuccino", "americano", "latte"]
    assert [o["id"] for o in state["recent"]["orders"]] == [6, 5, 4, 3, 2, 1]
    assert {r.part: json.loads(r.payload) for r in sent_state(spark, root).collect()}["recent"]["orders"] == []


def test_an_order_that_keeps_its_id_but_not_its_content_is_a_change(spark, five_orders, tmp_path):
    root = str(tmp_path / "changes")
    other = five_orders.withColumn("store", F.when(F.col("id") == 5, "central").otherwise(F.col("store")))
    for n, orders in enumerate((five_orders, other)):
        send_changes(computed_documents(orders, NOW), root, n)
    assert [p for n, p in sent(spark, root) if n == 1] == ["recent"]


def test_a_repeated_refresh_sends_the_same_again(spark, five_orders, tmp_path, monkeypatch):
    root, less = str(tmp_path / "changes"), five_orders.where("id < 4")
    send_changes(computed_documents(less, NOW), root, 0)

    def no_digests(df, folder, batch_id, *more):
        if folder.endswith("digests"):
            raise RuntimeError("ended before the digests")
        write_batch(df, folder, batch_id, *more)

    with monkeypatch.context() as m:
        m.setattr(changes_module, "write_batch", no_digests)
        with pytest.raises(RuntimeError):
            send_changes(computed_documents(five_orders, NOW), root, 1)
    before = rows_of(changes(spark, root))
    for _ in range(2):
        send_changes(computed_documents(five_orders, NOW), root, 1)
        assert rows_of(changes(spark, root)) == before
    send_changes(computed_documents(five_orders, NOW), root, 7)  # after a gap: nothing new
    assert rows_of(changes(spark, root)) == before


def test_readers_pin_a_version(spark, tmp_path):
    root, value = str(tmp_path / "versions"), lambda n: spark.range(n, n + 1)
    assert newest_version(spark, root) is None and read_version(spark, root, "id BIGINT").collect() == []
    for v in (10, 20):
        write_version(value(v), root, v, keep=2)
    pinned = read_version(spark, root, "id BIGINT", newest_version(spark, root))
    half = tmp_path / "versions" / "version=25" / "_temporary"
    half.mkdir(parents=True)  # a version that is being written
    assert rows_of(read_version(spark, root, "id BIGINT")) == [(20,)]
    write_version(value(30), root, 30, keep=2)
    assert rows_of(pinned) == [(20,)] and rows_of(read_version(spark, root, "id BIGINT")) == [(30,)]
    write_version(value(15), root, 15, keep=2)  # late: written, not pointed to, and beyond the kept ones
    assert newest_version(spark, root) == 30
    write_version(value(31), root, 30, keep=2)  # again
    assert rows_of(read_version(spark, root, "id BIGINT")) == [(31,)]
    kept = {p.name for p in (tmp_path / "versions").iterdir() if p.name.startswith("version=")}
    assert kept == {"version=20", "version=25", "version=30"}


def test_the_dashboard_stream_keeps_the_last_versions_and_sends_changes(spark, five_orders, tmp_path):
    folder, root, feed = (str(tmp_path / n) for n in ("in", "out", "changes"))
    for n in range(4):
        records(spark, [f"tick {n}"], n).coalesce(1).write.mode("append").parquet(folder)
    stream, moments = folder_stream(spark, folder, RECORD, files_per_batch=1), iter([NOW, NOW, NOW, utc("2025-12-09 11:10:00")])
    run(
        start_dashboard(
            stream, lambda now: computed_documents(five_orders, now), lambda: next(moments), root, str(tmp_path / "cp"), every=None, keep=2, changes_root=feed
        )
    )
    assert newest_version(spark, root) == 3
    assert [json.loads(stored_dashboard(spark, root, v).first().json)["current_hour"]["order_count"] for v in (2, 3)] == [5, 0]
    assert not (tmp_path / "out" / "version=1").exists()
    assert sent(spark, feed) == [(0, "hourly"), (0, "recent"), (0, "top"), (3, "hourly")]


def test_rows_without_an_id_pass_by_the_state(spark, tmp_path):
    at = "2025-12-09 10:00:00"
    rows = [("hot", at)] * 40 + [(None, at)] * 30 + [("a", at), ("b", at)]
    stream = order_files(spark, str(tmp_path / "in"), rows, rows)
    query = start(deduplicated(stream, "1 hour", 4), keep_changes(str(tmp_path / "out")), str(tmp_path / "cp"))
    run(query)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("message_id").count()
    assert rows_of(got) == sorted([("hot", 1), ("a", 1), ("b", 1), (None, 60)], key=str)
    # The last stage holds three ids; the first the hot one in each of its places, and the others. None is null.
    held = sorted(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])
    assert held[0] == 3 and 4 < held[1] <= 4 + 2 * 2 and len(held) == 2
