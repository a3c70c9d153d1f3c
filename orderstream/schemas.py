"""Declared schemas. Nothing in this package infers one."""

from __future__ import annotations

from dataclasses import dataclass

# The item and store names an order may carry, the latency bucket bounds in
# seconds, the request names that count towards the breaking point, and the percentiles of
# a load report.
DRINKS = ("cappuccino", "americano", "latte")
STORES = ("uptown", "downtown", "central", "southend")
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
CORE_REQUESTS = ("GET /api/dashboard", "POST /api/v1/order", "POST /api/v2/order", "POST /api/v3/order")
REPORT_PERCENTILES = (0.5, 0.66, 0.75, 0.8, 0.9, 0.95, 0.98, 0.99, 0.999, 0.9999, 1.0)

# Lifetimes of the stored documents.
HOURLY_TTL = "25 hours"
RECENT_TTL = "2 hours"


@dataclass(frozen=True)
class Domains:
    """Closed value sets an order is validated against."""

    drinks: tuple[str, ...] = DRINKS
    stores: tuple[str, ...] = STORES


# An event as it arrives: every field is text until it has been validated.
RAW_EVENT = "message_id STRING, drink STRING, store STRING, price STRING, timestamp STRING, version STRING"

# A validated order on its way into the fact table. `arrival` is its position in the input.
ARRIVED_ORDER = (
    "arrival BIGINT, message_id STRING, drink STRING, store STRING, price DECIMAL(10,2), ts TIMESTAMP, version STRING"
)

# The fact table. Written below `batch_id=<n>/order_date=<d>`.
ORDER = "id BIGINT, " + ARRIVED_ORDER + ", batch_id BIGINT, order_date DATE"


# Every event of a batch after validation. Written below `batch_id=<n>/accepted=<bool>`.
CHECKED_EVENT = ARRIVED_ORDER + ", reason STRING, value STRING, accepted BOOLEAN, batch_id BIGINT"
OUTCOME = "inserted BIGINT, skipped BIGINT, quarantined BIGINT, max_id BIGINT, batch_id BIGINT"

HOUR_ITEM = "hour_start TIMESTAMP, drink STRING, order_count BIGINT, revenue DECIMAL(20,2), last_ts TIMESTAMP, batch_id BIGINT"
WINDOW_ITEM = (
    "window_start TIMESTAMP, window_end TIMESTAMP, store STRING, drink STRING,"
    " order_count BIGINT, revenue DECIMAL(20,2), batch_id BIGINT"
)
# The same figures in runs: increments of batches, and the tombstones of corrected hours.
HOUR_RUN = HOUR_ITEM.removesuffix(", batch_id BIGINT") + ", seq BIGINT, tombstone BOOLEAN"
WINDOW_RUN = WINDOW_ITEM.removesuffix(", batch_id BIGINT")
RECENT_ORDER = "id BIGINT, drink STRING, store STRING, price DECIMAL(10,2), ts TIMESTAMP"
RECENT_SNAPSHOT = "arrival BIGINT, " + RECENT_ORDER + ", updated_at TIMESTAMP, expires_at TIMESTAMP, batch_id BIGINT"

HOURLY = (
    "hour_start TIMESTAMP, top_drinks ARRAY<STRING>, revenue DECIMAL(20,2), order_count BIGINT,"
    " drink_counts MAP<STRING,BIGINT>, updated_at TIMESTAMP, expires_at TIMESTAMP"
)
DASHBOARD = (
    "current_hour STRUCT<hour: INT, top_drinks: ARRAY<STRING>, revenue: DOUBLE, order_count: BIGINT>,"
    " top5_drinks ARRAY<STRING>,"
    " recent_orders ARRAY<STRUCT<id: BIGINT, drink: STRING, store: STRING, price: DOUBLE, timestamp: STRING>>,"
    " server_timestamp TIMESTAMP"
)

APP_LOG = (
    "timestamp STRING, level STRING, logger STRING, message STRING, module STRING, function STRING,"
    " line INT, exception STRING"
)
REQUEST_LOG = (
    "ts TIMESTAMP, method STRING, endpoint STRING, name STRING, status_code INT, duration_s DOUBLE,"
    " bytes BIGINT, error STRING, node STRING"
)
RUN_LOG = "run_ts TIMESTAMP, job STRING, status STRING"

# The columns of the load-test report files.
STATS_COLUMNS = (
    "Type", "Name", "Request Count", "Failure Count", "Median Response Time", "Average Response Time",
    "Min Response Time", "Max Response Time", "Average Content Size", "Requests/s", "Failures/s",
    "50%", "66%", "75%", "80%", "90%", "95%", "98%", "99%", "99.9%", "99.99%", "100%",
)
HISTORY_COLUMNS = (
    "Timestamp", "User Count", "Type", "Name", "Requests/s", "Failures/s",
    "50%", "66%", "75%", "80%", "90%", "95%", "98%", "99%", "99.9%", "99.99%", "100%",
    "Total Request Count", "Total Failure Count", "Total Median Response Time", "Total Average Response Time",
    "Total Min Response Time", "Total Max Response Time", "Total Average Content Size",
)
FAILURE_COLUMNS = ("Method", "Name", "Error", "Occurrences")
EXCEPTION_COLUMNS = ("Count", "Message", "Traceback", "Nodes")
