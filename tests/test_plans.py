"""Plan shapes that matter at scale."""

from datetime import timedelta

import pytest

from orderstream.functions.times import newest
from orderstream.operators import dedup, metrics, rates, recent, requests, visibility
from orderstream.queries import refresh_snapshots
from orderstream.sources import bindings as b

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def orders(spark):
    return b.orders(spark, FOLDER)


@pytest.fixture(scope="module")
def now(spark):
    return newest(b.events(spark, FOLDER))


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def scans(text):
    return [line for line in text.splitlines() if line.startswith("ReadSchema")]


def test_time_filters_reach_the_scan(orders, now):
    text = plan(recent.recent_orders(orders, now))
    assert "GreaterThanOrEqual(ts," in text and "TakeOrderedAndProject" in text
    assert "GreaterThanOrEqual(ts," in plan(metrics.hourly_metrics(orders, now))
    assert "LessThan(ts," in plan(metrics.hourly_metrics(orders, now))


def test_rankings_read_two_columns(orders, now):
    assert scans(plan(metrics.top_items_over(orders, now))) == ["ReadSchema: struct<ts:timestamp,event_type:string>"]


def test_stored_orders_are_pruned_by_date(spark, orders, now, tmp_path):
    from pyspark.sql import functions as F

    from orderstream.sources.tables import orders_scan

    root = str(tmp_path / "orders")
    orders.withColumn("order_date", F.to_date("ts")).write.partitionBy("order_date").parquet(f"{root}/batch_id=0")
    text = plan(recent.recent_orders(orders_scan(spark, root), now))
    assert "PartitionFilters: [isnotnull(order_date" in text
    assert metrics.top_items_over(orders_scan(spark, root), now, "3 days").count() == 5
    days = len({r.order_date for r in orders_scan(spark, root).where(F.col("ts") >= F.lit(now - timedelta(days=3))).select("order_date").collect()})
    assert days <= 4


def test_no_operator_pairs_rows_or_leaves_the_jvm(spark, orders, now):
    log = b.requests(spark, FOLDER)
    lines = b.line_orders(spark, FOLDER)
    frames = {
        "hours": metrics.hourly_documents(metrics.hour_items(orders)),
        "lookup": metrics.top_items_keyed(lines, b.brands(spark, FOLDER), "part"),
        "rolled": metrics.top_items_rolled(metrics.daily_items(orders), orders, now, "7 days"),
        "insert": dedup.insert_if_absent(orders, dedup.known_ids(orders, orders)),
        "rates": rates.request_rate(log),
        "p95": requests.latency_quantile_over_time(log, ["endpoint"]),
        "visible": visibility.visibility(orders.select("id", "ts"), refresh_snapshots(orders), 1800),
    }
    for name, df in frames.items():
        text = plan(df)
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
            assert bad not in text, (name, bad)


def test_rows_are_counted_before_they_are_spread(spark):
    """The fact rows of a sliding rate are aggregated once; only the counts are multiplied."""
    text = plan(rates.request_rate(b.requests(spark, FOLDER)))
    assert text.index("partial_count(1)") > 0 and text.count("Scan parquet") <= 2
    tree = text[: text.index("\n\n\n")] if "\n\n\n" in text else text
    assert tree.index("Generate") < tree.index("Scan parquet")
    between = tree[tree.index("Generate") : tree.index("Scan parquet")]
    assert between.count("HashAggregate") >= 2


def test_keyed_ranking_counts_before_the_join(spark):
    text = plan(metrics.top_items_keyed(b.line_orders(spark, FOLDER), b.brands(spark, FOLDER), "part"))
    tree = text.split("\n\n")[0]
    join = min(tree.index(j) for j in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin") if j in tree)
    assert tree[join:].index("HashAggregate") < tree[join:].index("Scan parquet")
