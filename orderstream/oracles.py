"""DuckDB equivalents of the registered queries.

Written from the meaning of each query, not from its Spark plan: they use direct joins and windows
that would be poor plans at scale but are easy to check.
"""

from __future__ import annotations

from orderstream.queries import CORE_NAMES, STEPS, WAIT_SECONDS, WEEK_SECONDS
from orderstream.schemas import LATENCY_BOUNDS, REPORT_PERCENTILES

ORD = """ord AS (
  SELECT event_id AS id, CAST(event_id AS VARCHAR) AS message_id, event_type AS drink,
         CASE user_id % 4 WHEN 0 THEN 'uptown' WHEN 1 THEN 'downtown' WHEN 2 THEN 'central' ELSE 'southend' END AS store,
         CAST(value AS DECIMAL(10,2)) AS price, ts, 'v' || (event_id % 3 + 1) AS version, user_id
  FROM events),
clock AS (SELECT max(ts) AS as_of FROM events)"""

REQ = """req AS (
  SELECT ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
         '/api/' || event_type AS endpoint,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END || ' /api/' || event_type AS name,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
         value / 100.0::DOUBLE AS duration_s,
         CAST(json_extract(props, '$.k') AS BIGINT) * 10 AS bytes,
         CASE WHEN event_type = 'error' THEN 'server error ' || (CAST(json_extract(props, '$.k') AS BIGINT) % 5) END AS error,
         'node-' || (user_id % 3) AS node
  FROM events)"""

RUNS = """runs AS (
  SELECT ts AS run_ts,
         CASE user_id % 4 WHEN 0 THEN 'uptown' WHEN 1 THEN 'downtown' WHEN 2 THEN 'central' ELSE 'southend' END
           || CASE WHEN event_type = 'click' THEN '-cleanup' ELSE '-aggregator' END AS job,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'active' ELSE 'succeeded' END AS status
  FROM events)"""

# The faulty stream by its rules: what is wrong with an event, or nothing.
FAULTS = """faults AS (
  SELECT *,
    CASE WHEN user_id IN (3, 13, 15) THEN 'malformed'
         WHEN user_id = 23 THEN 'message_id missing'
         WHEN drink IN ('error', 'signup') THEN 'drink not in domain'
         WHEN user_id = 11 THEN 'store not in domain'
         WHEN user_id = 5 THEN 'price not a number'
         WHEN user_id IN (7, 9) THEN 'timestamp not readable' END AS reason,
    CASE WHEN user_id = 21 THEN date_trunc('day', ts) ELSE ts END AS sent_ts
  FROM ord)"""


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


TOP_ORDER = "count(*) DESC, max(ts) DESC, drink"


def _hourly(where: str) -> str:
    return f"""SELECT coalesce((SELECT string_agg(drink, ',' ORDER BY n DESC, l DESC, drink) FROM
        (SELECT drink, count(*) n, max(ts) l FROM hr GROUP BY drink ORDER BY {TOP_ORDER} LIMIT 5)), '') AS top_drinks,
      CAST(coalesce(sum(price), 0) AS DOUBLE) AS revenue, count(*) AS order_count FROM hr""".replace("hr", f"(SELECT * FROM ord, clock WHERE {where})")


HOUR_TOP = """per AS (SELECT date_trunc('hour', ts) AS hour_start, drink, count(*) n, max(ts) l, sum(price) rev FROM ord GROUP BY 1, 2),
rnk AS (SELECT *, row_number() OVER (PARTITION BY hour_start ORDER BY n DESC, l DESC, drink) r FROM per),
docs AS (SELECT hour_start, string_agg(drink, ',' ORDER BY r) FILTER (r <= 5) AS top_drinks,
    string_agg(drink, ', ' ORDER BY r) FILTER (r <= 5) AS shown,
    list(drink ORDER BY r) FILTER (r <= 5) AS names,
    CAST(sum(rev) AS DOUBLE) AS revenue, CAST(sum(n) AS BIGINT) AS order_count, max(l) AS updated_at,
    max(l) + INTERVAL 25 HOUR AS expires_at
  FROM rnk GROUP BY hour_start)"""


def _top(source: str, item: str = "drink", extra: str = "") -> str:
    return f"""SELECT {item}, count(*) AS order_count, max(ts) AS last_ts,
      row_number() OVER (ORDER BY count(*) DESC, max(ts) DESC, {item}) AS rank
    FROM {source} {extra} GROUP BY {item} QUALIFY rank <= 5"""


ISO = "CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END"


def _dashboard(*ctes: str, orders: str = "ord") -> str:
    return with_(
        ORD,
        *ctes,
        f"""hr AS (SELECT o.* FROM {orders} o, clock WHERE ts >= date_trunc('hour', as_of) AND ts < date_trunc('hour', as_of) + INTERVAL 1 HOUR),
hr_top AS (SELECT drink, row_number() OVER (ORDER BY count(*) DESC, max(ts) DESC, drink) AS rank FROM hr GROUP BY drink QUALIFY rank <= 5),
top AS (SELECT drink, row_number() OVER (ORDER BY count(*) DESC, max(ts) DESC, drink) AS rank
        FROM {orders}, clock WHERE ts >= as_of - INTERVAL 30 DAY GROUP BY drink QUALIFY rank <= 5),
rec AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS rank FROM {orders}, clock WHERE ts >= as_of - INTERVAL 1 HOUR QUALIFY rank <= 50)""",
        body=f"""SELECT 'current_hour' AS section, CAST(1 AS BIGINT) AS rank,
   coalesce((SELECT string_agg(drink, ',' ORDER BY rank) FROM hr_top), '') AS name,
   CAST((SELECT hour(as_of) FROM clock) AS VARCHAR) AS detail,
   CAST(coalesce(sum(price), 0) AS DOUBLE) AS amount, CAST(count(*) AS DOUBLE) AS number FROM hr
UNION ALL SELECT 'top5', rank, drink, NULL, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM top
UNION ALL SELECT 'recent', rank, drink, store || '|' || {ISO}, CAST(price AS DOUBLE), CAST(id AS DOUBLE) FROM rec""",
    )


def _totals(*keys: str, source: str = "ord") -> str:
    ks = "".join(f"{k}, " for k in keys)
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    return f"SELECT {ks}count(*) AS order_count, CAST(coalesce(sum(price), 0) AS DOUBLE) AS revenue FROM {source}{group}"


REDELIVERED = """batch AS (
  SELECT arrival, CASE WHEN drink = 'signup' THEN NULL ELSE message_id END AS message_id, drink, store, price, ts, version FROM (
    SELECT id AS arrival, * FROM ord
    UNION ALL SELECT id + 1000000000000, * FROM ord WHERE drink IN ('purchase', 'signup'))),
target AS (SELECT message_id FROM ord WHERE ts < TIMESTAMP '2024-01-11'),
grouped AS (SELECT *, row_number() OVER (PARTITION BY coalesce(message_id, 'lone ' || arrival) ORDER BY arrival) AS r FROM batch),
inserted AS (SELECT * FROM grouped WHERE r = 1 AND (message_id IS NULL OR message_id NOT IN (SELECT message_id FROM target)))"""


def _sliding(select: str, keys: str, source: str) -> str:
    """One row per event and range end it counts for: the five minute marks after it."""
    return f"""SELECT time_bucket(INTERVAL 1 MINUTE, ts) + to_minutes(CAST(k AS BIGINT)) AS sample_ts, {keys}, {select}
    FROM {source}, range(1, 6) AS r(k) GROUP BY sample_ts, {keys}"""


def _bucket_columns() -> str:
    return ", ".join(f"count(*) FILTER (duration_s <= {b}::DOUBLE) AS b{i}" for i, b in enumerate(LATENCY_BOUNDS)) + (
        f", count(duration_s) AS b{len(LATENCY_BOUNDS)}"
    )


def _quantile(q: float = 0.95) -> str:
    """Bucket by bucket: the first whose count reaches the rank."""
    n = len(LATENCY_BOUNDS)
    cases = []
    for i, bound in enumerate(LATENCY_BOUNDS):
        low = f"{LATENCY_BOUNDS[i - 1]}::DOUBLE" if i else "0.0::DOUBLE"
        before = f"b{i - 1}" if i else "0"
        rank = f"{q}::DOUBLE * b{n}::DOUBLE"
        cases.append(
            f"WHEN b{i}::DOUBLE >= {rank} THEN {low} + ({bound}::DOUBLE - {low}) *"
            f" (({rank} - {before}::DOUBLE) / (b{i}::DOUBLE - {before}::DOUBLE))"
        )
    return f"CASE WHEN b{n} = 0 THEN NULL {' '.join(cases)} ELSE {LATENCY_BOUNDS[-1]}::DOUBLE END AS latency_s"


FAILED = "(error IS NOT NULL OR coalesce(status_code >= 400, false))"


def _stats(source: str) -> str:
    """Each percentile is looked up among the sorted rounded times of its name."""
    pcts = ", ".join(
        f"max(rounded) FILTER (below <= floor(total::DOUBLE * {p}::DOUBLE)) AS p{f'{p * 100:g}'.replace('.', '_')}"
        for p in REPORT_PERCENTILES
    )
    return f"""raw AS (
  SELECT *, {FAILED} AS failed, CAST(duration_s * 1000.0::DOUBLE AS DECIMAL(18,6)) AS ms FROM {source}),
both_ AS (
  SELECT method, name, 0 AS overall, ms, failed, bytes FROM raw
  UNION ALL SELECT NULL, NULL, 1, ms, failed, bytes FROM raw),
rounded_ AS (
  SELECT *, CAST(CASE WHEN ms < 100 THEN round_even(ms::DOUBLE, 0) WHEN ms < 1000 THEN round_even(ms::DOUBLE, -1)
              WHEN ms < 10000 THEN round_even(ms::DOUBLE, -2) ELSE round_even(ms::DOUBLE, -3) END AS BIGINT) AS rounded FROM both_),
placed AS (
  SELECT *, rank() OVER (PARTITION BY overall, method, name ORDER BY rounded) - 1 AS below,
         row_number() OVER (PARTITION BY overall, method, name ORDER BY rounded) AS pos,
         count(*) OVER (PARTITION BY overall, method, name) AS total FROM rounded_),
secs AS (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS s FROM raw)
SELECT method, name, count(*) AS request_count, count(*) FILTER (failed) AS failure_count,
  min(rounded) FILTER (pos > (total - 1) / 2.0) AS median_ms,
  CAST(sum(ms) AS DOUBLE) / count(*) AS mean_ms, CAST(min(ms) AS DOUBLE) AS min_ms, CAST(max(ms) AS DOUBLE) AS max_ms,
  CAST(sum(bytes) AS DOUBLE) / count(*) AS mean_bytes, {pcts},
  count(*) / any_value(s) AS requests_per_s, count(*) FILTER (failed) / any_value(s) AS failures_per_s
FROM placed, secs GROUP BY overall, method, name"""


def _breaking(threshold: float) -> str:
    names = ", ".join(f"'{n}'" for n in CORE_NAMES)
    tick, step = STEPS["tick_seconds"], STEPS["step_seconds"]
    return with_(
        REQ,
        f"""core AS (SELECT *, {FAILED} AS failed FROM req WHERE name IN ({names})),
ticks AS (SELECT (epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM core)) // ({tick} * 1000000) AS tick,
          count(*) AS n, count(*) FILTER (failed) AS e FROM core GROUP BY 1),
cum AS (SELECT tick, sum(n) OVER (ORDER BY tick) AS requests, sum(e) OVER (ORDER BY tick) AS errors,
        least(10 + (tick * {tick} // {step}) * 20, 500) AS users FROM ticks),
judged AS (SELECT *, errors::DOUBLE / requests::DOUBLE AS share,
   CASE WHEN requests > 50 AND errors::DOUBLE / requests::DOUBLE >= {threshold}::DOUBLE THEN 'broke'
        WHEN users >= 500 THEN 'max users' ELSE 'completed' END AS outcome FROM cum),
chosen AS (SELECT coalesce(min(tick) FILTER (outcome <> 'completed'), max(tick)) AS t FROM judged)""",
        body="""SELECT outcome, CAST(users AS BIGINT) AS users, CAST(tick AS BIGINT) AS tick, CAST(requests AS BIGINT) AS requests,
 CAST(errors AS BIGINT) AS errors, share AS error_share FROM judged, chosen WHERE tick = t""",
    )


# Refreshes every ten minutes with orders; an order is seen at the first later refresh that counts
# more than the refresh before the order did.
VISIBLE = f"""refresh AS (
  SELECT s + INTERVAL 10 MINUTE AS refresh_ts, sum(n) OVER (PARTITION BY date_trunc('hour', s) ORDER BY s) AS seen
  FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS s, count(*) AS n FROM ord GROUP BY 1)),
based AS (
  SELECT o.id, o.ts, coalesce(r.seen, 0) AS baseline FROM ord o ASOF LEFT JOIN refresh r ON o.ts >= r.refresh_ts),
found AS (
  SELECT b.id, b.ts, min(r.refresh_ts) AS seen_at FROM based b
  LEFT JOIN refresh r ON r.refresh_ts > b.ts AND r.refresh_ts <= b.ts + INTERVAL {WAIT_SECONDS} SECOND AND r.seen > b.baseline
  GROUP BY b.id, b.ts),
seen_ AS (SELECT id, ts, (epoch_us(seen_at) - epoch_us(ts)) / 1000.0::DOUBLE AS latency_ms, seen_at IS NULL AS timed_out FROM found)"""

_INGESTED = """kept AS (SELECT id AS arrival, message_id, drink, store, price, sent_ts AS ts FROM faults WHERE reason IS NULL)"""


def all_oracles() -> dict[str, str]:
    hour_now = "ts >= date_trunc('hour', as_of) AND ts < date_trunc('hour', as_of) + INTERVAL 1 HOUR"
    sql = {
        "orders_scan": with_(ORD, body="SELECT id, drink, store, CAST(price AS DOUBLE) AS price, ts FROM ord ORDER BY ts DESC, id DESC"),
        "hourly_metrics": with_(ORD, body=_hourly(hour_now)),
        "hourly_metrics_empty": with_(
            ORD, body=_hourly("ts >= date_trunc('day', as_of) + INTERVAL 47 HOUR AND ts < date_trunc('day', as_of) + INTERVAL 48 HOUR")
        ),
        "hourly_of_day": with_(
            ORD, body=_hourly("ts >= date_trunc('day', as_of) + INTERVAL 9 HOUR AND ts < date_trunc('day', as_of) + INTERVAL 10 HOUR")
        ),
        "hourly_series": with_(ORD, HOUR_TOP, body="SELECT hour_start, top_drinks, revenue, order_count, updated_at, expires_at FROM docs"),
        "hourly_item_counts": with_(ORD, body="SELECT date_trunc('hour', ts) AS hour_start, drink, count(*) AS order_count FROM ord GROUP BY 1, 2"),
        "top_items_30d": with_(ORD, body=_top("ord, clock", extra="WHERE ts >= as_of - INTERVAL 30 DAY")),
        "top_items_7d_rolled": with_(ORD, body=_top("ord, clock", extra="WHERE ts >= as_of - INTERVAL 7 DAY")),
        "top_brands": """SELECT p_brand AS brand, count(*) AS order_count, max(l_shipdate) AS last_ts,
            row_number() OVER (ORDER BY count(*) DESC, max(l_shipdate) DESC, p_brand) AS rank
            FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand QUALIFY rank <= 5""",
        "recent_orders": with_(
            ORD, body="SELECT id, drink, store, CAST(price AS DOUBLE) AS price, ts FROM ord, clock WHERE ts >= as_of - INTERVAL 1 HOUR ORDER BY ts DESC, id DESC LIMIT 50"
        ),
        "recent_orders_day": with_(
            ORD, body="SELECT id, drink, store, CAST(price AS DOUBLE) AS price, ts FROM ord, clock WHERE ts >= as_of - INTERVAL 1 DAY ORDER BY ts DESC, id DESC LIMIT 200"
        ),
        "rolling_last_10": with_(ORD, body="SELECT id, drink, store, CAST(price AS DOUBLE) AS price, ts FROM ord ORDER BY id DESC LIMIT 10"),
        "dashboard_document": _dashboard(),
        "refresh_job": _dashboard(),
        "totals": with_(ORD, body=_totals()),
        "by_item": with_(ORD, body=_totals("drink")),
        "by_store": with_(ORD, body=_totals("store")),
        "volume_by_store": """SELECT l_returnflag AS store, count(*) AS order_count,
            CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1""",
        "null_amounts": with_(
            ORD,
            """holes AS (SELECT ts, CASE WHEN version <> 'v1' THEN price END AS price, CASE WHEN drink <> 'error' THEN drink END AS drink,
                CASE WHEN store <> 'central' THEN store END AS store FROM ord)""",
            body="""SELECT date_trunc('day', ts) AS window_start, store, count(*) AS total_orders,
            CAST(coalesce(sum(price), 0) AS DOUBLE) AS total_revenue, count(drink) AS named_orders,
            count(DISTINCT drink) AS items, CAST(CASE WHEN store IS NULL THEN 0 ELSE 1 END AS BIGINT) AS stores
            FROM holes GROUP BY 1, 2""",
        ),
        "window_maps": with_(
            ORD,
            "per AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS w, store, drink, count(*) AS n, sum(price) AS rev FROM ord GROUP BY 1, 2, 3)",
            body="""SELECT w AS window_start, w + INTERVAL 10 MINUTE AS window_end, store, drink, n AS drink_orders,
            CAST(rev AS DOUBLE) AS drink_revenue,
            CAST(sum(n) OVER s AS BIGINT) AS total_orders, CAST(sum(rev) OVER s AS DOUBLE) AS total_revenue,
            CAST(sum(n) OVER s AS BIGINT) AS store_orders, CAST(sum(rev) OVER s AS DOUBLE) AS store_revenue
            FROM per WINDOW s AS (PARTITION BY w, store)""",
        ),
        "orders_counter": with_(ORD, body="SELECT drink, store, version, count(*) AS order_count FROM ord GROUP BY 1, 2, 3"),
        "order_value_counter": with_(ORD, body="SELECT store, CAST(sum(price) AS DOUBLE) AS revenue FROM ord GROUP BY 1"),
        "state_merge": with_(
            ORD,
            "per AS (SELECT date_trunc('hour', ts) AS hour_start, drink, count(*) n, sum(price) rev FROM ord GROUP BY 1, 2)",
            "rnk AS (SELECT *, row_number() OVER (PARTITION BY hour_start ORDER BY n DESC, drink) r FROM per)",
            body="""SELECT hour_start, CAST(sum(rev) AS DOUBLE) AS revenue, CAST(sum(n) AS BIGINT) AS order_count,
            string_agg(drink, ',' ORDER BY r) FILTER (r <= 5) AS top_drinks FROM rnk GROUP BY 1""",
        ),
        "partial_merge": with_(
            ORD,
            body="SELECT date_trunc('hour', ts) AS hour_start, drink, count(*) AS order_count, CAST(sum(price) AS DOUBLE) AS revenue, max(ts) AS last_ts FROM ord GROUP BY 1, 2",
        ),
        "map_top_keys": with_(
            ORD,
            "per AS (SELECT date_trunc('day', ts) AS day, drink, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY count(*) DESC, drink) AS r FROM ord GROUP BY 1, 2)",
            body="SELECT day, string_agg(drink, ',' ORDER BY r) AS top_drinks FROM per WHERE r <= 3 GROUP BY day",
        ),
        "parse_valid": with_(
            ORD, FAULTS, body="SELECT id AS arrival, message_id, drink, store, CAST(price AS DOUBLE) AS price, sent_ts AS ts, version FROM faults WHERE reason IS NULL"
        ),
        "parse_quarantine": with_(ORD, FAULTS, body="SELECT id AS arrival, reason FROM faults WHERE reason IS NOT NULL"),
        "version_filter": with_(
            ORD,
            body="""SELECT id AS arrival, CASE WHEN user_id <> 23 THEN message_id END AS message_id, drink,
            CASE WHEN user_id <> 11 THEN store END AS store,
            CASE WHEN user_id = 5 THEN 'not_a_number' ELSE CAST(price AS VARCHAR) END AS price, version
            FROM ord WHERE version = 'v3' AND user_id NOT IN (3, 13, 15)""",
        ),
        "lenient_timestamp": with_(
            ORD,
            FAULTS,
            body="""SELECT id AS arrival, message_id, drink, store, CAST(price AS DOUBLE) AS price, 
            CASE WHEN user_id IN (7, 9) THEN ts + INTERVAL 90 MINUTE ELSE sent_ts END AS ts, version
            FROM faults WHERE reason IS NULL OR reason = 'timestamp not readable'""",
        ),
        "missing_price_allowed": with_(
            ORD,
            FAULTS,
            body="""SELECT coalesce(CASE WHEN reason = 'message_id missing' THEN
              CASE WHEN drink IN ('error', 'signup') THEN 'drink not in domain' END ELSE reason END, 'valid') AS result,
              count(*) AS events FROM faults GROUP BY 1""",
        ),
        "insert_if_absent": with_(
            ORD, REDELIVERED, body="SELECT arrival, message_id, drink, store, CAST(price AS DOUBLE) AS price, ts, version FROM inserted"
        ),
        "batch_outcome": with_(
            ORD, REDELIVERED, body="SELECT (SELECT count(*) FROM inserted) AS inserted, (SELECT count(*) FROM batch) - (SELECT count(*) FROM inserted) AS skipped"
        ),
        "first_of_each": with_(ORD, REDELIVERED, body="SELECT arrival, message_id, drink FROM grouped WHERE r = 1"),
        "numbered_orders": with_(ORD, REDELIVERED, body="SELECT arrival, message_id, row_number() OVER (ORDER BY arrival) + 1000 AS id FROM inserted"),
        "numbered_kafka_positions": with_(
            ORD,
            "placed AS (SELECT id // 5 * 8388608 + id % 5 AS arrival, message_id FROM ord)",
            body="SELECT arrival, message_id, row_number() OVER (ORDER BY arrival) AS id FROM placed",
        ),
        "legacy_ids": with_(
            ORD,
            "texts AS (SELECT id, 'order-' || drink || '-' || message_id AS message_id FROM ord)",
            "hashes AS (SELECT *, list_reduce(list_transform(string_split(message_id, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM texts)",
            body="SELECT id, message_id, CASE WHEN h >= 2147483648 THEN abs(h - 4294967296) ELSE h END AS legacy_id FROM hashes",
        ),
        "stable_ids": with_(ORD, body="SELECT id, sha256(message_id || chr(31) || drink || chr(31) || store) AS stable_id FROM ord"),
        "serialize_orders": with_(ORD, body=f"SELECT id, drink, store, CAST(price AS DOUBLE) AS price, {ISO} AS timestamp FROM ord"),
        "display_texts": with_(
            ORD,
            HOUR_TOP,
            body="""SELECT hour_start, 'metrics:hourly:' || hour(hour_start) AS hour_key, hour(hour_start) || ':00' AS hour_text,
            printf('$%.2f', revenue) AS revenue_text, shown AS names_text, 'N/A' AS no_names_text,
            CASE WHEN len(names) = 1 THEN names[1] ELSE names[len(names) - 1] || ', ' || names[len(names)] END AS last_two,
            strftime(updated_at, '%H:%M') AS clock_text, strftime(updated_at, '%Y-%m-%d %H:%M:%S UTC') AS updated_text,
            (epoch_us(updated_at) - epoch_us(hour_start)) / 1000.0::DOUBLE AS elapsed_ms FROM docs""",
        ),
        "publish_strings": with_(
            ORD, body=f"SELECT message_id, drink, store, CAST(price AS VARCHAR) AS price, {ISO} AS timestamp, 'v2' AS version FROM ord"
        ),
        "publish_keyed": with_(
            ORD, body=f"SELECT store AS key, message_id, drink, store, CAST(price AS DOUBLE) AS price, {ISO} AS timestamp, 'v3' AS version FROM ord"
        ),
        "fresh_snapshots": with_(ORD, HOUR_TOP, body="SELECT hour_start, order_count, revenue, expires_at FROM docs, clock WHERE expires_at > as_of"),
        "snapshot_point_read": with_(ORD, HOUR_TOP, body="SELECT hour_start, order_count, revenue FROM docs, clock WHERE hour_start = date_trunc('hour', as_of)"),
        "changed_only": with_(
            ORD,
            "a AS (SELECT date_trunc('hour', ts) AS h, drink, count(*) n, sum(price) rev FROM ord, clock WHERE ts < as_of - INTERVAL 2 HOUR GROUP BY 1, 2)",
            "b AS (SELECT date_trunc('hour', ts) AS h, drink, count(*) n, sum(price) rev FROM ord GROUP BY 1, 2)",
            body="""SELECT b.h AS hour_start, b.drink, CAST(a.n AS DOUBLE) AS order_count_before, CAST(a.rev AS DOUBLE) AS revenue_before,
            CAST(b.n AS DOUBLE) AS order_count_after, CAST(b.rev AS DOUBLE) AS revenue_after,
            CASE WHEN a.h IS NULL THEN 'added' ELSE 'changed' END AS status
            FROM b LEFT JOIN a ON a.h = b.h AND a.drink = b.drink WHERE a.n IS DISTINCT FROM b.n OR a.rev IS DISTINCT FROM b.rev""",
        ),
        "stream_dedup": with_(ORD, body="SELECT message_id, drink, store, CAST(price AS DOUBLE) AS price, ts FROM ord"),
        "stream_tumbling_store": with_(
            ORD,
            body="""SELECT date_trunc('second', ts) AS window_start, date_trunc('second', ts) + INTERVAL 1 SECOND AS window_end, store,
            count(*) AS total_orders, CAST(sum(price) AS DOUBLE) AS total_revenue FROM ord GROUP BY 1, 2, 3""",
        ),
        "reconcile_stream": with_(
            ORD,
            body="""SELECT date_trunc('hour', ts) AS hour_start, drink, count(*) AS order_count_before, CAST(sum(price) AS DOUBLE) AS revenue_before,
            count(*) AS order_count_after, CAST(sum(price) AS DOUBLE) AS revenue_after, 'same' AS status FROM ord GROUP BY 1, 2""",
        ),
        "stream_ingest": with_(
            ORD,
            FAULTS,
            _INGESTED,
            body="""SELECT row_number() OVER (ORDER BY arrival) AS id, message_id, drink, store, CAST(price AS DOUBLE) AS price, ts,
            strftime(ts, '%Y-%m-%d') AS order_date FROM kept""",
        ),
        "stream_ingest_hours": with_(
            ORD,
            FAULTS,
            _INGESTED,
            body="SELECT date_trunc('hour', ts) AS hour_start, drink, count(*) AS order_count, CAST(sum(price) AS DOUBLE) AS revenue, max(ts) AS last_ts FROM kept GROUP BY 1, 2",
        ),
        "stream_ingest_outcomes": with_(
            ORD,
            FAULTS,
            body="""SELECT count(*) FILTER (reason IS NULL) AS inserted, CAST(0 AS BIGINT) AS skipped,
            count(*) FILTER (reason IS NOT NULL) AS quarantined, count(*) FILTER (reason IS NULL) AS max_id FROM faults""",
        ),
        "stream_quarantine": with_(ORD, FAULTS, body="SELECT id AS arrival, reason FROM faults WHERE reason IS NOT NULL"),
        "stream_recent": with_(
            ORD,
            FAULTS,
            _INGESTED,
            body="""SELECT row_number() OVER (ORDER BY arrival) AS id, drink, store, CAST(price AS DOUBLE) AS price, ts
            FROM kept ORDER BY arrival DESC LIMIT 10""",
        ),
        "stream_dashboard": _dashboard(
            FAULTS, _INGESTED, "numbered AS (SELECT *, row_number() OVER (ORDER BY arrival) AS id FROM kept)", orders="numbered"
        ),
        "hourly_by_arrival": with_(
            ORD,
            FAULTS,
            body="""SELECT date_trunc('hour', ts + INTERVAL 90 MINUTE) AS hour_start, drink, count(*) AS order_count,
            CAST(sum(price) AS DOUBLE) AS revenue, max(ts) + INTERVAL 90 MINUTE AS last_ts FROM faults WHERE reason IS NULL GROUP BY 1, 2""",
        ),
        "kafka_records": with_(
            ORD, FAULTS, body="SELECT id // 6 * 8388608 + id % 6 AS arrival, message_id, sent_ts AS ts FROM faults WHERE reason IS NULL"
        ),
        "stream_job": with_(
            ORD,
            FAULTS,
            body="""SELECT store, date_trunc('day', sent_ts) AS window_start, count(*) AS total_orders,
            CAST(sum(price) AS DOUBLE) AS total_revenue, count(*) AS stored_orders
            FROM faults WHERE reason IS NULL AND version = 'v3' GROUP BY 1, 2""",
        ),
        "request_counter": with_(REQ, body="SELECT method, endpoint, CAST(status_code AS BIGINT) AS status_code, count(*) AS request_count FROM req GROUP BY 1, 2, 3"),
        "latency_histogram": with_(
            REQ,
            "bounds(le, up) AS (VALUES " + ", ".join(f"('{b}', {b}::DOUBLE)" for b in LATENCY_BOUNDS) + ", ('+Inf', 'inf'::DOUBLE))",
            "named AS (SELECT DISTINCT method, endpoint FROM req)",
            body="""SELECT n.method, n.endpoint, le, count(r.ts) AS bucket_count FROM named n JOIN bounds ON true
            LEFT JOIN req r ON r.method = n.method AND r.endpoint = n.endpoint AND r.duration_s <= up GROUP BY 1, 2, 3""",
        ),
        "latency_p95": with_(
            REQ, f"h AS (SELECT endpoint, {_bucket_columns()} FROM req GROUP BY 1)", body=f"SELECT endpoint, {_quantile()} FROM h"
        ),
        "latency_p95_over_time": with_(
            REQ, f"h AS ({_sliding(_bucket_columns(), 'endpoint', 'req')})", body=f"SELECT sample_ts, endpoint, {_quantile()} FROM h"
        ),
        "request_rate": with_(REQ, body=_sliding("count(*) / 300.0::DOUBLE AS rate", "endpoint, method", "req")),
        "items_per_minute": with_(ORD, body=_sliding("count(*) / 300.0::DOUBLE * 60 AS per_minute", "drink", "ord")),
        "revenue_per_minute": with_(ORD, body=_sliding("CAST(sum(price) AS DOUBLE) / 300.0::DOUBLE * 60 AS per_minute", "store", "ord")),
        "run_ledger": with_(
            RUNS,
            body="""SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'succeeded') AS succeeded,
            count(*) FILTER (status = 'failed') AS failed FROM runs WHERE job LIKE '%aggregator%'""",
        ),
        "freshness_lag": with_(
            RUNS,
            body="""SELECT ((SELECT epoch_us(max(ts)) FROM events) - epoch_us(max(run_ts))) / 1000000.0::DOUBLE AS lag_s
            FROM runs WHERE job LIKE '%aggregator%'""",
        ),
        "log_select": """SELECT event_id AS line_no, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 'ERROR' AS level, 'shop.error' AS logger,
            props AS message, 'handlers' AS module, 'handle' AS function, CAST(json_extract(props, '$.k') AS BIGINT) AS line,
            'ValueError: bad order' AS exception FROM events WHERE event_type = 'error' ORDER BY ts""",
        "request_stats": "WITH " + REQ + ",\n" + _stats("req"),
        "failures": with_(REQ, body=f"SELECT method, name, error, count(*) AS occurrences FROM req WHERE {FAILED} GROUP BY 1, 2, 3"),
        "exceptions": with_(
            REQ,
            body="""SELECT error AS message, count(*) AS occurrences, string_agg(DISTINCT node, ', ' ORDER BY node) AS nodes
            FROM req WHERE error IS NOT NULL GROUP BY 1""",
        ),
        "breaking_point": _breaking(0.10),
        "breaking_point_unbroken": _breaking(0.9),
        "visibility_latency": with_(ORD, VISIBLE, body="SELECT id, ts, latency_ms, timed_out FROM seen_"),
        "visibility_summary": "WITH "
        + ORD
        + ",\n"
        + VISIBLE
        + f""",
late AS (SELECT ts, 'E2E' AS method, CASE WHEN timed_out THEN 'e2e_latency_v1_timeout' ELSE 'e2e_latency_v1' END AS name,
  CAST(NULL AS INTEGER) AS status_code,
  CASE WHEN timed_out THEN {WAIT_SECONDS}::DOUBLE ELSE latency_ms / 1000.0::DOUBLE END AS duration_s, 0 AS bytes,
  CASE WHEN timed_out THEN 'late' END AS error FROM seen_),
"""
        + _stats("late"),
    }
    week = VISIBLE.replace(f"INTERVAL {WAIT_SECONDS} SECOND", f"INTERVAL {WEEK_SECONDS} SECOND")
    sql["visibility_week"] = with_(ORD, week, body="SELECT id, ts, latency_ms, timed_out FROM seen_")
    sql["stream_hourly"] = sql["partial_merge"]
    sql["stream_hourly_batches"] = sql["stream_ingest_hours"]
    sql["stream_arrival_hours"] = sql["hourly_by_arrival"]
    sql["stream_late_rows"] = with_(
        ORD,
        FAULTS,
        body="""SELECT date_trunc('hour', sent_ts) AS hour_start, drink, count(*) AS order_count, CAST(sum(price) AS DOUBLE) AS revenue,
        max(sent_ts) AS last_ts FROM faults WHERE reason IS NULL AND version = 'v3' GROUP BY 1, 2""",
    )
    sql["stream_redelivered"] = with_(
        ORD,
        FAULTS,
        body="""SELECT count(*) FILTER (reason IS NULL) AS inserted, 2 * count(*) FILTER (reason IS NULL AND id % 5 = 2) AS skipped,
        count(*) FILTER (reason IS NOT NULL) + 2 * count(*) FILTER (reason IS NOT NULL AND id % 5 = 2) AS quarantined,
        count(*) FILTER (reason IS NULL) AS max_id, CAST(4 AS BIGINT) AS batches FROM faults""",
    )
    sql["kafka_positions"] = with_(
        ORD,
        FAULTS,
        # places: the three partitions of orders-1, seen first, then those of orders-0
        body="""SELECT id // 6 * 8388608 + (1 - id % 2) * 3 + id // 2 % 3 AS arrival, CAST(NULL AS VARCHAR) AS message_id, sent_ts AS ts
        FROM faults WHERE reason IS NULL OR reason = 'message_id missing' AND drink NOT IN ('error', 'signup')""",
    )
    slices = """slices AS (SELECT *, CAST(id % 3 AS BIGINT) AS batch_id FROM ord),
tops AS (SELECT batch_id, max(ts) AS top FROM slices GROUP BY batch_id),
marks AS (SELECT a.batch_id, max(b.top) AS newest_before, max(b.top) - INTERVAL 3 DAY AS watermark
  FROM tops a LEFT JOIN tops b ON b.batch_id < a.batch_id GROUP BY a.batch_id),
split AS (SELECT s.*, watermark, newest_before, coalesce(ts < watermark, false) AS is_late FROM slices s JOIN marks USING (batch_id))"""
    sql["late_ledger"] = with_(
        ORD,
        slices,
        body="""SELECT batch_id, count(*) AS seen, count(*) FILTER (is_late) AS late, any_value(watermark) AS watermark,
        greatest(max(ts), any_value(newest_before)) AS newest_ts FROM split GROUP BY batch_id""",
    )
    sql["late_rows_split"] = with_(
        ORD,
        slices,
        body="""SELECT date_trunc('hour', ts) AS hour_start, drink, count(*) FILTER (NOT is_late) AS in_time, count(*) FILTER (is_late) AS late
        FROM split GROUP BY 1, 2""",
    )
    sql["dashboard_changes"] = with_(
        ORD,
        """moments AS (SELECT n AS batch_id, as_of - CASE WHEN n < 2 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS moment
          FROM clock, range(3) r(n))""",
        """hourly AS (SELECT batch_id, 'hourly' AS part, CAST(count(id) AS VARCHAR) AS shown,
          date_trunc('hour', moment) || ' ' || count(id) || ' ' || coalesce(sum(price), 0) AS compared FROM moments LEFT JOIN ord
          ON ts >= date_trunc('hour', moment) AND ts < date_trunc('hour', moment) + INTERVAL 1 HOUR GROUP BY batch_id, moment)""",
        """ranks AS (SELECT batch_id, drink, row_number() OVER (PARTITION BY batch_id ORDER BY count(*) DESC, max(ts) DESC, drink) AS k
          FROM moments JOIN ord ON ts >= moment - INTERVAL 30 DAY GROUP BY batch_id, drink)""",
        """tops AS (SELECT batch_id, 'top' AS part, string_agg(drink, ',' ORDER BY k) AS shown, shown AS compared FROM ranks WHERE k <= 5 GROUP BY batch_id)""",
        """last_orders AS (SELECT batch_id, id, row_number() OVER (PARTITION BY batch_id ORDER BY ts DESC, id DESC) AS k
          FROM moments JOIN ord ON ts >= moment - INTERVAL 1 HOUR)""",
        """recents AS (SELECT batch_id, 'recent' AS part, string_agg(id, ',' ORDER BY k) AS shown, shown AS compared FROM last_orders WHERE k <= 50 GROUP BY batch_id)""",
        "parts AS (SELECT * FROM hourly UNION ALL SELECT * FROM tops UNION ALL SELECT * FROM recents)",
        "compared AS (SELECT *, lag(compared) OVER (PARTITION BY part ORDER BY batch_id) AS sent FROM parts)",
        body="SELECT CAST(batch_id AS BIGINT) AS batch_id, part, shown FROM compared WHERE compared IS DISTINCT FROM sent",
    )
    sql["known_message_ids"] = with_(ORD, FAULTS, body="SELECT message_id FROM faults WHERE reason IS NULL")
    sql["levelled_hours"] = sql["partial_merge"]
    sql["reconcile_drift"] = with_(
        ORD,
        FAULTS,
        body="""SELECT date_trunc('hour', sent_ts) AS hour_start, drink, count(*) AS order_count_before, CAST(sum(price) AS DOUBLE) AS revenue_before,
        count(*) AS order_count_after, CAST(sum(price) AS DOUBLE) AS revenue_after, 'same' AS status FROM faults WHERE reason IS NULL GROUP BY 1, 2""",
    )
    sql["stream_resumed"] = with_(
        ORD,
        FAULTS,
        body="""SELECT message_id, drink, store, CAST(price AS DOUBLE) AS price, sent_ts AS ts, count(*) OVER () AS last_id
        FROM faults WHERE reason IS NULL""",
    )
    sql["stream_recent_batches"] = with_(
        ORD,
        FAULTS,
        body="""SELECT id AS arrival, drink, store, CAST(price AS DOUBLE) AS price, sent_ts AS ts FROM faults
        WHERE reason IS NULL ORDER BY id DESC LIMIT 10""",
    )
    sql["append_orders"] = with_(
        ORD,
        body="""SELECT row_number() OVER (ORDER BY o.id % 2, o.id) AS id, o.id AS arrival, message_id, drink, store,
        CAST(price AS DOUBLE) AS price, ts FROM ord o""",
    )
    sql["id_rules"] = with_(
        ORD,
        FAULTS,
        body="""SELECT id AS arrival, id_required, CASE WHEN reason IN ('malformed', 'message_id missing') THEN reason
        WHEN id_required AND id % 3 <> 0 THEN 'id missing' WHEN NOT id_required AND id % 3 = 0 THEN 'id not allowed' ELSE reason END AS reason
        FROM faults, (VALUES (false), (true)) r(id_required)""",
    )
    sql["load_report_files"] = (
        "WITH "
        + REQ
        + ",\nstats AS (WITH "
        + _stats("req")
        + """),
listed AS (SELECT name, count(*) AS n FROM req WHERE """
        + FAILED
        + """ GROUP BY 1)
SELECT coalesce(method, '') AS type, coalesce(s.name, 'Aggregated') AS name, request_count, failure_count, mean_ms,
  CAST(p95 AS DOUBLE) AS p95, coalesce(n, 0) AS listed_failures FROM stats s LEFT JOIN listed l ON l.name = s.name"""
    )
    return sql
