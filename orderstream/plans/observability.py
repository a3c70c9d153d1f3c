"""The panels of the operations dashboard over a request log, orders and a run log."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orderstream.functions.times import AsOf
from orderstream.operators import metrics, rates, requests


def panels(request_log: DataFrame, orders: DataFrame, runs: DataFrame, as_of: AsOf, jobs: str = "aggregator"):
    """Panel name to DataFrame. Each is an independent lazy plan."""
    return {
        "request_counter": requests.request_counter(request_log),
        "latency_histogram": requests.latency_histogram(request_log),
        "request_rate": rates.request_rate(request_log),
        "latency_p95": requests.latency_quantile_over_time(request_log, ["endpoint"]),
        "orders_counter": metrics.item_counter(orders),
        "order_value_counter": metrics.totals(orders, "store"),
        "items_per_minute": rates.items_per_minute(orders),
        "revenue_per_minute": rates.revenue_per_minute(orders),
        "run_ledger": requests.run_ledger(runs, jobs),
        "freshness_lag": requests.freshness_lag(runs, as_of, jobs),
    }
