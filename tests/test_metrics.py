from datetime import timedelta
from decimal import Decimal

from conftest import rows_of, utc
from pyspark.sql import functions as F

from orderstream.functions.values import add_maps, last_of, names_text, share, top_keys
from orderstream.operators import diffing, metrics, recent
from orderstream.operators.ranges import fresh, in_hour, trailing

NOW = utc("2025-12-09 10:45:00")
D = Decimal


def test_hour_of_five_orders(five_orders):
    row = metrics.hourly_metrics(five_orders, NOW).first()
    assert (row.order_count, row.revenue) == (5, D("24.75"))
    assert row.top_drinks == ["cappuccino", "americano", "latte"]  # ties at one time: by name


def test_hour_without_orders_is_one_row_of_zeros(five_orders):
    for row in (metrics.hourly_metrics(five_orders, NOW, hour=3).first(), metrics.hourly_metrics(five_orders.limit(0), NOW).first()):
        assert (row.top_drinks, row.order_count, row.revenue) == ([], 0, D("0.00"))
    assert metrics.top_items(five_orders.limit(0)).count() == 0


def test_money_is_exact(orders_of):
    orders = orders_of([("latte", "uptown", "0.10", "2025-12-09 10:00:00")] * 30)
    assert metrics.totals(orders).first().revenue == D("3.00")


def test_hour_bounds_are_half_open(orders_of):
    orders = orders_of([("latte", "uptown", 1, t) for t in ("2025-12-09 09:59:59.999999", "2025-12-09 10:00:00", "2025-12-09 10:59:59.999999", "2025-12-09 11:00:00")])
    assert rows_of(in_hour(orders, NOW), "id") == [(2,), (3,)]


def test_trailing_includes_the_cutoff_and_the_future(orders_of):
    orders = orders_of([("latte", "uptown", 1, t) for t in ("2025-12-09 09:44:59", "2025-12-09 09:45:00", "2025-12-10 10:00:00")])
    assert rows_of(trailing(orders, NOW, "1 hour"), "id") == [(2,), (3,)]


def test_newest_order_decides_ties(orders_of):
    orders = orders_of(
        [
            ("latte", "uptown", 1, "2025-12-09 10:00:00"),
            ("mocha", "uptown", 1, "2025-12-09 10:05:00"),
            ("latte", "uptown", 1, "2025-12-09 10:01:00"),
            ("mocha", "uptown", 1, "2025-12-09 09:00:00"),
            ("flat", "uptown", 1, "2025-12-09 10:30:00"),
        ]
    )
    assert [(r.drink, r["rank"]) for r in metrics.top_items(orders).orderBy("rank").collect()] == [("mocha", 1), ("latte", 2), ("flat", 3)]
    assert [r.drink for r in metrics.top_items(orders, 2).orderBy("rank").collect()] == ["mocha", "latte"]


def test_missing_values_count_where_they_can(orders_of):
    at = "2025-12-09 10:30:00"

    def only(drink, store, price):
        return metrics.window_stats(metrics.window_items(orders_of([(drink, store, price, at)]))).first()

    no_price = only("latte", "downtown", None)
    assert (no_price.total_orders, no_price.total_revenue) == (1, D("0.00"))
    assert (no_price.drink_counts, no_price.drink_revenue) == ({"latte": 1}, {"latte": D("0.00")})
    no_drink = only(None, "downtown", "4.50")
    assert (no_drink.total_orders, no_drink.total_revenue, no_drink.drink_counts, no_drink.store_counts) == (1, D("4.50"), {}, {"downtown": 1})
    no_store = only("latte", None, "4.50")
    assert (no_store.total_orders, no_store.store_counts, no_store.store_revenue, no_store.drink_counts) == (1, {}, {}, {"latte": 1})


def test_merge_equals_counting_together(orders_of):
    at = "2025-12-09 10:30:00"
    a = metrics.hour_items(orders_of([("latte", "downtown", "4.50", at)]))
    b = metrics.hour_items(orders_of([("latte", "uptown", "5.00", at), ("espresso", "downtown", "3.00", at)]))
    doc = metrics.hourly_documents(metrics.merge_hour_items(a, b)).first()
    assert (doc.order_count, doc.revenue, doc.drink_counts) == (3, D("12.50"), {"latte": 2, "espresso": 1})
    merged = metrics.merged_document(metrics.hourly_documents(a), metrics.hourly_documents(b)).first()
    assert (merged.order_count, merged.revenue, merged.drink_counts, merged.top_drinks) == (3, D("12.50"), doc.drink_counts, ["latte", "espresso"])


def test_maps_and_lists(spark):
    row = spark.range(1).select(
        add_maps(F.expr("map('a', 10L, 'b', 5L)"), F.expr("map('a', 3L, 'c', 7L)")).alias("m"),
        add_maps(F.lit(None).cast("map<string,bigint>"), F.expr("map('a', 1L)")).alias("n"),
        top_keys(F.expr("map('latte',100L,'espresso',50L,'cappuccino',80L,'mocha',30L,'americano',60L,'flat',20L)"), 5).alias("t"),
        last_of(F.array(*[F.lit(i) for i in range(12)]), 10).alias("l"),
        last_of(F.array(F.lit(1)), 10).alias("s"),
        names_text(F.array().cast("array<string>")).alias("none"),
        share(F.lit(1), F.lit(0)).alias("share"),
    ).first()
    assert row.m == {"a": 13, "b": 5, "c": 7} and row.n == {"a": 1}
    assert row.t == ["latte", "cappuccino", "americano", "espresso", "mocha"]
    assert row.l == list(range(2, 12)) and row.s == [1]
    assert (row.none, row.share) == ("N/A", 0.0)


def test_recent_orders_are_limited_and_newest_first(orders_of):
    orders = orders_of([("latte", "uptown", 1, f"2025-12-09 10:{m:02d}:00") for m in range(60)])
    got = [r.id for r in recent.recent_orders(orders, NOW, n=50).collect()]
    assert got == list(range(60, 10, -1))
    assert [r.id for r in recent.last_arrived(orders).collect()] == list(range(51, 61))


def test_rolled_ranking_equals_a_full_scan(orders_of):
    orders = orders_of([(f"d{(i * i) % 7}", "uptown", 1, str(utc("2025-12-01 00:00:00") + timedelta(hours=5 * i))[:19]) for i in range(60)])
    now = utc("2025-12-09 13:20:00")
    for span in ("3 days", "100 hours", "20 hours"):
        full = rows_of(metrics.top_items_over(orders, now, span))
        assert rows_of(metrics.top_items_rolled(metrics.daily_items(orders), orders, now, span)) == full


def test_documents_expire(orders_of):
    docs = metrics.hourly_documents(metrics.hour_items(orders_of([("latte", "uptown", 1, t) for t in ("2025-12-08 09:45:00", "2025-12-08 09:46:00", "2025-12-09 08:00:00")])))
    assert fresh(docs, NOW).count() == 2  # both hours: the first was updated 24 h 59 min ago
    assert fresh(docs, NOW + timedelta(minutes=1)).count() == 1
    assert fresh(docs.withColumn("expires_at", F.lit(None).cast("timestamp")), NOW).count() == 2


def test_changed_only(spark):
    before = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 3, "z")], "k STRING, n INT, v STRING")
    after = spark.createDataFrame([("a", 1, "x"), ("b", 2, "new"), ("d", 4, "w")], "k STRING, n INT, v STRING")
    changes = diffing.changed_only(before, after, ["k"], ["n", "v"])
    assert rows_of(changes, "k", "status") == [("b", "changed"), ("c", "removed"), ("d", "added")]


def test_results_do_not_depend_on_order_or_partitioning(five_orders, orders_of):
    orders = orders_of([(f"d{i % 4}", f"s{i % 3}", i % 7, f"2025-12-09 10:{i % 60:02d}:00") for i in range(200)])
    wanted = rows_of(metrics.hourly_documents(metrics.hour_items(orders)), "hour_start", "top_drinks", "revenue", "order_count")
    for shuffled in (orders.repartition(7), orders.orderBy(F.rand(3)), orders.coalesce(1)):
        assert rows_of(metrics.hourly_documents(metrics.hour_items(shuffled)), "hour_start", "top_drinks", "revenue", "order_count") == wanted


def test_top_items_by_lookup(spark, orders_of):
    orders = orders_of([("latte", "uptown", 1, f"2025-12-09 10:00:{i % 60:02d}") for i in range(90)]).withColumn("part", F.when(F.col("id") <= 60, F.lit(0)).otherwise(F.col("id") % 5))
    parts = spark.createDataFrame([(i, f"brand{i % 3}") for i in range(5)], "part BIGINT, drink STRING")
    plain = rows_of(metrics.top_items(orders.drop("drink").join(parts, "part"), 2))
    assert rows_of(metrics.top_items_keyed(orders.drop("drink"), parts, "part", 2)) == plain
