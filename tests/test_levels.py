"""Levelled runs: increments, the id index, corrections; the registry of topics."""

import json
import random

import pytest
from conftest import rows_of, utc
from pyspark.sql import functions as F
from test_streaming import DOMAINS, DRINKS, HOURS, event, records, run

from orderstream.operators import metrics
from orderstream.plans.reconcile import correct, drift, repair
from orderstream.sinks import levels as levels_module
from orderstream.sinks.idindex import IdIndex
from orderstream.sinks.levels import Levels
from orderstream.sources.streams import KAFKA_RECORD, PLACES, folder_stream
from orderstream.sources.topics import Topics
from orderstream.streaming.ingest import Store, current_hour_items, current_window_items, ingest_batch, start_ingest

ITEMS = "k STRING, n BIGINT"
RUN = "k STRING, n BIGINT, seq BIGINT, tombstone BOOLEAN"


def summed(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def table(tmp_path, **kw) -> Levels:
    return Levels(str(tmp_path / "levels"), RUN, summed, "k", void_key="k", **kw)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), ITEMS)


def test_runs_merge_and_reads_grow_with_the_logarithm(spark, tmp_path):
    t, files = table(tmp_path, fanout=3), []
    for n in range(27):
        t.add(rows(spark, ("a", 1), (f"b{n}", n)), n)
        runs = t.manifest(spark).runs
        files.append(len(runs))
        assert rows_of(t.current(spark).where("k = 'a'")) == [("a", n + 1)]
    assert max(files) <= 2 * 3 and files[26] == 1 and t.manifest(spark).runs[0].level == 3
    assert t.batches(spark) == list(range(19, 27))
    live = {r.name for b in range(19, 27) for r in t._read_manifest(spark, b).runs}
    assert {p.name for p in (tmp_path / "levels" / "runs").iterdir()} == live
    assert t.current(spark).agg(F.sum("n")).first()[0] == 27 + sum(range(27))


def test_a_repeated_batch_is_not_added_again(spark, tmp_path):
    t = table(tmp_path, fanout=2)
    for n in (0, 1, 1, 2, 2, 2):
        t.add(rows(spark, ("a", 1)), n)
    assert rows_of(t.current(spark)) == [("a", 3)]
    with pytest.raises(ValueError, match="older"):
        t.manifest(spark, before=0)


def test_an_end_between_merge_and_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(tmp_path, fanout=2)
    t.add(rows(spark, ("a", 1)), 0)

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(levels_module, "put_text", die)
        with pytest.raises(RuntimeError):
            t.add(rows(spark, ("a", 5)), 1)
    assert (tmp_path / "levels" / "runs" / "1-1").exists()  # merged, but named nowhere
    assert rows_of(t.current(spark)) == [("a", 1)]
    t.add(rows(spark, ("a", 5)), 1)
    assert rows_of(t.current(spark)) == [("a", 6)]


def test_corrections_void_and_replace(spark, tmp_path):
    t = table(tmp_path, fanout=2)
    for n in range(3):
        t.add(rows(spark, ("a", 1), ("gone", 1), ("b", 1)), n)
    keys = spark.createDataFrame([("a",), ("gone",)], "k STRING")
    assert t.correct(spark, "first", keys, rows(spark, ("a", 100)), t.manifest(spark)) == "pending"
    assert rows_of(t.current(spark)) == [("a", 100), ("b", 3)]
    assert t.correct(spark, "first", keys, rows(spark, ("a", 7)), t.manifest(spark)) == "pending"  # once for a name
    assert t.correct(spark, "second", keys, rows(spark, ("a", 200)), t.manifest(spark)) == "pending"  # the later one counts
    assert rows_of(t.current(spark)) == [("a", 200), ("b", 3)]
    for n in range(3, 12):
        t.add(rows(spark, ("a", 1), ("b", 1)), n)
        assert rows_of(t.current(spark)) == [("a", 200 + n - 2), ("b", n + 1)]
    assert t.state_of(spark, "first") == t.state_of(spark, "second") == "applied" and t.state_of(spark, "none") == "absent"
    assert not any(r.voids for r in t.manifest(spark).runs if r is t.manifest(spark).runs[0])


def test_an_overtaken_correction_has_no_effect(spark, tmp_path):
    t = table(tmp_path)
    t.add(rows(spark, ("a", 1)), 0)
    seen = t.manifest(spark)
    t.add(rows(spark, ("a", 1)), 1)
    state = t.correct(spark, "late", spark.createDataFrame([("a",)], "k STRING"), rows(spark, ("a", 50)), seen)
    assert state == t.state_of(spark, "late") == "overtaken"
    t.add(rows(spark, ("a", 1)), 2)
    assert rows_of(t.current(spark)) == [("a", 3)]


def test_random_histories_equal_a_plain_sum(spark, tmp_path):
    rng = random.Random(3)
    t, truth = table(tmp_path, fanout=2), {}
    for n in range(14):
        added = [(f"k{rng.randrange(4)}", rng.randint(1, 9)) for _ in range(3)]
        t.add(rows(spark, *added), n)
        for k, v in added:
            truth[k] = truth.get(k, 0) + v
        if rng.random() < 0.4:
            k, v = f"k{rng.randrange(4)}", rng.choice([None, 1000])
            t.correct(spark, f"c{n}", spark.createDataFrame([(k,)], "k STRING"), rows(spark, *([(k, v)] if v else [])), t.manifest(spark))
            truth.pop(k, None)
            if v:
                truth[k] = v
        assert dict(rows_of(t.current(spark))) == truth


# Id index


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "message_id STRING")


def test_the_index_is_exact(spark, tmp_path):
    index, rng = IdIndex.at(str(tmp_path / "ids"), buckets=4, fanout=3), random.Random(9)
    stored: dict[str, int] = {}
    for n in range(12):
        batch = [f"id-{rng.randrange(900)}" for _ in range(120)]
        assert {r[0] for r in index.known(ids(spark, *batch, None), n).collect()} == {b for b in batch if b in stored}
        new = sorted(set(batch) - stored.keys())
        stored |= dict.fromkeys(new, n)
        index.add_ids(ids(spark, *new, None), n)
    # A repeated batch does not see its own ids, nor those of later ones.
    assert {r[0] for r in index.known(ids(spark, *stored), 10).collect()} == {i for i, n in stored.items() if n < 10}


def test_a_batch_opens_only_buckets_it_may_hit(spark, tmp_path):
    index, opened = IdIndex.at(str(tmp_path / "ids"), buckets=2), {}
    for n in range(51):
        fresh = ids(spark, *(f"{n}-{i}" for i in range(5)))
        if n in (5, 50):
            opened[n] = len(index.buckets_to_open(fresh, n))
            again = index.buckets_to_open(ids(spark, "2-0", "x"), n)
            assert len(again) == 1 and index.known(ids(spark, "2-0", "x"), n).count() == 1
        index.add_ids(fresh, n)
    assert opened[50] <= opened[5]
    assert len(index.manifest(spark).runs) <= 3 * 3


def test_segments_grow_with_a_run(spark, tmp_path):
    index = IdIndex.at(str(tmp_path / "ids"), buckets=2)
    index.add_ids(spark.range(20_000).select(F.concat(F.lit("m"), "id").alias("message_id")), 0)
    assert index.manifest(spark).runs[0].info == {"rows": 20_000, "segments": 8}
    probe = spark.range(19_000, 25_000).select(F.concat(F.lit("m"), "id").alias("message_id"))
    assert index.known(probe, 1).count() == 1000
    filters = spark.read.parquet(f"{index.root}/runs/0-0/filters")
    assert filters.count() == 16 and filters.where("octet_length(bits) <> 4096").count() == 0


def test_ids_of_any_kind(spark, tmp_path):
    index, odd = IdIndex.at(str(tmp_path / "ids")), ["", " ", "é", "\U0001f600" * 50, "x" * 5000]
    index.add_ids(ids(spark, *odd, None), 0)
    assert sorted(r[0] for r in index.known(ids(spark, *odd, None, "new"), 1).collect()) == sorted(odd)
    index.add_ids(ids(spark).limit(0), 1)
    assert index.known(ids(spark, "", "new"), 2).count() == 1


# The ingest on both


def history(n: int) -> list[list[str]]:
    """Batches of which each repeats some ids of all earlier ones."""
    rng, out = random.Random(n), []
    for k in range(n):
        old = [rng.randrange(k * 6) for _ in range(4)] if k else []
        out.append([event(i, DRINKS[i % 3], minute=i * 7 % 300) for i in [*range(k * 6, k * 6 + 6), *old]])
    return out


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    store = Store(str(tmp_path_factory.mktemp("levels") / "store"), id_buckets=4)
    for n, texts in enumerate(history(9)):
        ingest_batch(records(spark, texts, n * 100), n, store, DOMAINS, window="1 minute")
    return store


def test_ingest_over_many_batches(spark, ingested):
    orders = ingested.table(spark, "orders")
    assert sorted(r.message_id for r in orders.collect()) == sorted(f"m{i}" for i in range(54))
    assert [r.id for r in orders.orderBy("arrival").collect()] == list(range(1, 55))
    assert rows_of(current_hour_items(ingested, spark), *HOURS) == rows_of(metrics.hour_items(orders), *HOURS)
    windows = metrics.window_items(orders, "1 minute")
    assert rows_of(current_window_items(ingested, spark), *windows.columns) == rows_of(windows)
    assert len(ingested.hours().manifest(spark).runs) <= 4
    assert ingested.table(spark, "outcomes").agg(F.sum("inserted"), F.sum("skipped")).first() == (54, 32)


def test_the_hour_reaches_the_files(spark, ingested):
    one = current_hour_items(ingested, spark).where(F.col("hour_start") == F.lit(utc("2025-12-09 09:00:00")))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(hour_start" in plan


def test_an_order_table_without_an_index_gets_one(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    ingest_batch(records(spark, [event(1), event(2)]), 0, store, DOMAINS)
    moved = Store(str(tmp_path / "other"), orders=store.path("orders"))
    ingest_batch(records(spark, [event(2), event(3)], 10), 1, moved, DOMAINS)
    assert rows_of(moved.table(spark, "outcomes"), "inserted", "skipped") == [(1, 1)]
    ingest_batch(records(spark, [event(1), event(3), event(4)], 20), 2, moved, DOMAINS)
    assert rows_of(moved.table(spark, "orders"), "message_id") == [("m1",), ("m2",), ("m3",), ("m4",)]


def test_drift_is_corrected_once_and_vanished_hours_go(spark, tmp_path):
    """Figures that lost a batch's rows, count others twice and hold an hour no order is in."""
    store = Store(str(tmp_path / "store"))
    for n, texts in enumerate(history(3)):
        ingest_batch(records(spark, texts, n * 100), n, store, DOMAINS)
    ghost = spark.createDataFrame([("1", utc("2025-12-09 09:10:00")), ("2", utc("2025-11-01 10:00:00"))], "m STRING, ts TIMESTAMP")
    wrong = metrics.hour_items(ghost.select(F.lit("latte").alias("drink"), F.lit("5.00").cast("decimal(10,2)").alias("price"), "ts"))
    store.hours().add(wrong, 3)
    assert drift(spark, store).where("status <> 'same'").count() == 2
    assert correct(spark, store, "nightly") == "pending"
    assert drift(spark, store).where("status <> 'same'").count() == 0
    assert current_hour_items(store, spark).where("hour_start < '2025-12-01'").count() == 0
    assert correct(spark, store, "nightly") == "pending" and correct(spark, store, "again") == "absent"
    for n, texts in enumerate(history(8)[3:], 4):
        ingest_batch(records(spark, texts, n * 100), n, store, DOMAINS)
        assert drift(spark, store).where("status <> 'same'").count() == 0
    assert store.hours().state_of(spark, "nightly") == "applied"
    assert drift(spark, store, utc("2025-12-09 11:00:00")).where("hour_start < '2025-12-09 11:00:00'").count() == 0


def test_repair_of_documents_removes_vanished_hours(spark, orders_of, tmp_path):
    root = str(tmp_path / "hourly")
    stale = orders_of([("latte", "uptown", 1, "2025-12-09 10:00:00"), ("latte", "uptown", 1, "2025-12-09 07:00:00")])
    right = orders_of([("latte", "uptown", 1, "2025-12-09 10:00:00"), ("mocha", "uptown", 1, "2025-12-09 10:30:00")])
    from orderstream.plans.reconcile import reconcile
    from orderstream.sinks.snapshots import overwrite_hourly

    overwrite_hourly(metrics.hourly_documents(metrics.hour_items(stale)), root)
    repair(reconcile(metrics.hour_items(stale), right), right, root)
    stored = spark.read.parquet(root).select("order_count", F.col("expires_at") > F.col("updated_at"))
    assert rows_of(stored) == [(0, False), (2, True)]
    repair(reconcile(metrics.hour_items(right), right), right, root)  # nothing has drifted


# Topics


def shaped(spark, *kafka):
    data = [(None, v.encode(), t, p, o, utc("2025-12-09 20:00:00")) for t, p, o, v in kafka]
    return spark.createDataFrame(data, KAFKA_RECORD)


def test_places_are_kept_and_only_appended(spark, tmp_path):
    topics = Topics(str(tmp_path / "topics"), ("a", "b"))
    first = topics.text(shaped(spark, ("b", 1, 5, "x"), ("a", 0, 5, "y")))
    assert rows_of(first, "value", "arrival") == [("x", 5 * PLACES + 1), ("y", 5 * PLACES)]
    more = topics.text(shaped(spark, ("a", 3, 5, "z"), ("b", 1, 5, "x"), ("b", 0, 5, "w")))
    assert rows_of(more, "value", "arrival") == [("w", 5 * PLACES + 3), ("x", 5 * PLACES + 1), ("z", 5 * PLACES + 2)]
    assert topics.places(spark) == {("a", 0): 0, ("b", 1): 1, ("a", 3): 2, ("b", 0): 3}
    for strange in (("c", 0, 1, "x"), (None, 0, 1, "x"), ("a", None, 1, "x")):
        with pytest.raises(ValueError, match="not registered"):
            topics.text(shaped(spark, strange))


def test_two_topics_in_one_stream_keep_all_rows(spark, tmp_path):
    """The same partition and offset of two topics, without message ids; a partition that appears later; a restart."""
    folder, store = str(tmp_path / "in"), Store(str(tmp_path / "store"))
    topics = Topics(store.path("topics"), ("a", "b"))
    text = lambda i: json.dumps(json.loads(event(i)) | {"message_id": None})
    for n in range(3):
        batch = [(t, p, n * 10 + i, text(n * 10 + i)) for t in ("a", "b") for p in range(n + 1) for i in range(4)]
        shaped(spark, *batch).coalesce(1).write.mode("append").parquet(folder)
        run(start_ingest(folder_stream(spark, folder, KAFKA_RECORD), store, DOMAINS, topics=topics, lenient_time="ingest_ts"))
    orders = store.table(spark, "orders")
    quarantined = store.quarantine(spark)
    assert orders.count() + quarantined.count() == 8 * (1 + 2 + 3)
    both = orders.select("arrival").unionByName(quarantined.select("arrival"))
    assert both.distinct().count() == 48
