import random
import re

import pytest
from conftest import ORDER_ROW, rows_of, utc
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderstream.functions.ids import legacy_id, random_message_id, stable_message_id
from orderstream.operators import dedup
from orderstream.operators.numbering import numbered, range_starts, ranged, running_totals
from orderstream.sinks.orders import append_orders, jdbc_options
from orderstream.sources.streams import PLACES
from orderstream.sources.tables import ensure_table, orders_scan
from orderstream.schemas import ORDER


def batch_of(spark, ids):
    rows = [(i, i, m, f"d{i}", "uptown", None, utc("2025-12-09 10:00:00"), "v3") for i, m in enumerate(ids)]
    return spark.createDataFrame(rows, ORDER_ROW)


def expected(ids, stored):
    seen, kept = set(stored), []
    for i, m in enumerate(ids):
        if m is None or m not in seen:
            kept.append(i)
            seen.add(m)
    return kept


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.sampled_from("abcdef")), max_size=25), st.sets(st.sampled_from("abcxyz")))
def test_insert_if_absent_matches_one_by_one_inserts(spark, ids, stored):
    batch = batch_of(spark, ids)
    target = spark.createDataFrame([(s,) for s in stored] + [(None,)], "message_id STRING")
    kept = expected(ids, stored)
    known = dedup.known_ids(target, batch)
    assert rows_of(dedup.insert_if_absent(batch, known), "arrival", "drink") == sorted([(i, f"d{i}") for i in kept], key=str)
    counts = dedup.outcome(dedup.insertable(batch, known)).first()
    assert (counts.inserted, counts.skipped) == (len(kept), len(ids) - len(kept))


def test_hot_id_and_many_rows_without_id(spark):
    ids = ["hot"] * 400 + [None] * 400 + [f"m{i}" for i in range(400)]
    random.Random(5).shuffle(ids)
    batch = batch_of(spark, ids).repartition(8)
    assert rows_of(dedup.first_of_each(batch), "arrival") == sorted([(i,) for i in expected(ids, ())], key=str)
    # Copies collapse before the shuffle: at most one row of an id leaves each of the 8 tasks.
    plan = dedup.first_of_each(batch)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def test_running_totals_and_numbers_cross_chunks(spark, tmp_path):
    values = random.Random(1).sample(range(100_000), 300)
    df = spark.createDataFrame([(v, v % 7) for v in values], "at BIGINT, n BIGINT").repartition(5)
    total, wanted = 0, []
    for i, v in enumerate(sorted(values), 1):
        total += v % 7
        wanted.append((v, total, 50 + i))
    got = numbered(running_totals(df, "at", ["n"], 999), "at", F.lit(50), str(tmp_path / "ranges")).orderBy("at")
    assert [tuple(r) for r in got.select("at", "n", "id").collect()] == wanted


def test_numbers_of_large_positions(spark, tmp_path):
    """Positions beyond 2^53 must not share or swap places."""
    base = 2**60
    df = spark.createDataFrame([(base + i,) for i in range(40)], "at BIGINT").repartition(7)
    assert [r.id for r in numbered(df, "at", F.lit(0), str(tmp_path / "ranges")).orderBy("at").collect()] == list(range(1, 41))


@pytest.mark.parametrize("partitions", [1, 8])
def test_sparse_positions_are_numbered_by_few_ranges(spark, tmp_path, partitions):
    """Kafka positions lie 2^23 apart: the unpartitioned window still sees one row per range, not per offset."""
    rows = spark.range(5000).select((F.expr(f"id div {partitions}") * PLACES + F.col("id") % partitions).alias("at"))
    spotted = ranged(rows, "at", str(tmp_path / "ranges"))
    assert range_starts(spotted).count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = numbered(rows, "at", F.lit(7), str(tmp_path / "numbers")).orderBy("at").collect()
    assert [r.id for r in got] == list(range(8, 8 + len(got))) and [r["at"] for r in got] == sorted(r["at"] for r in got)
    windows = re.findall(r"Window \[.*", numbered(rows, "at", F.lit(7), str(tmp_path / "plan"))._jdf.queryExecution().executedPlan().toString())
    assert len(windows) == 1 and "sum(n" in windows[0]


def test_numbering_an_empty_table(spark, tmp_path):
    assert numbered(spark.createDataFrame([], "at BIGINT"), "at", F.lit(0), str(tmp_path / "ranges")).collect() == []


def test_numbering_runs_its_input_once(spark, tmp_path):
    """Rows that differ from run to run still get every number once."""
    rows = spark.range(1000).select((F.rand() * 1e15).cast("bigint").alias("at"))
    got = numbered(rows, "at", F.lit(0), str(tmp_path / "ranges")).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 1001)) and [r["at"] for r in got] == sorted(r["at"] for r in got)


def test_append_numbers_continue_and_repeat(spark, orders_of, tmp_path):
    root = str(tmp_path / "orders")
    first = orders_of([("latte", "uptown", 1, f"2025-12-0{d} 10:00:00") for d in (1, 2, 3)]).drop("id")
    more = orders_of([("mocha", "uptown", 1, "2025-12-04 10:00:00")] * 2, start=4).drop("id").withColumn("message_id", F.lit(None).cast("string"))
    append_orders(first, ensure_table(spark, root, ORDER), root, 0)
    for _ in range(2):  # the second time is a repeated batch
        append_orders(more, ensure_table(spark, root, ORDER), root, 1)
    assert sorted(r.id for r in orders_scan(spark, root).collect()) == [1, 2, 3, 4, 5]


def java_hash(text):
    h = 0
    data = text.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = (h * 31 + data[i] * 256 + data[i + 1]) % 2**32
    h = h - 2**32 if h >= 2**31 else h
    return h if h == -(2**31) else abs(h)


def test_legacy_id_is_the_string_hash(spark):
    texts = ["", "a", "order-123", "polygenelubricants", "é😀x", "x" * 200, "3f2b8c1e-7d44-4a5f-9f6b-0c1d2e3f4a5b"]
    df = spark.createDataFrame([(t,) for t in texts], "message_id STRING")
    assert [r[0] for r in df.select(legacy_id(F.col("message_id"))).collect()] == [java_hash(t) for t in texts]
    assert java_hash("polygenelubricants") == -(2**31)
    # An output column that shadows the input does not change the result.
    shadowed = df.select(F.lit("zzz").alias("message_id"), legacy_id(F.col("message_id")).alias("h")).collect()
    assert [r.h for r in shadowed] == [java_hash(t) for t in texts]


def test_ids(spark):
    df = spark.range(50).select(random_message_id().alias("u"), stable_message_id(F.col("id"), F.lit("x")).alias("s"))
    rows = df.collect()
    assert len({r.u for r in rows}) == 50 and len({r.s for r in rows}) == 50
    assert {r.s for r in df.collect()} == {r.s for r in rows}


def test_jdbc_options():
    assert jdbc_options("jdbc:x", "orders") == {"url": "jdbc:x", "dbtable": "orders", "batchsize": "100"}
