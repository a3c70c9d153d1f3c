import math
import random
from datetime import timedelta

import pytest
from conftest import rows_of, utc
from pyspark.sql import functions as F

from orderstream.operators import loadstats, metrics, rates, requests, visibility
from orderstream.operators.recent import recent_orders
from orderstream.plans.loadreport import export_load_report, load_report
from orderstream.plans.observability import panels
from orderstream.plans.refresh import Documents, commit, committed_documents, current_hour_document
from orderstream.schemas import APP_LOG, LATENCY_BOUNDS, REQUEST_LOG, RUN_LOG
from orderstream.sources.logs import read_logs, stream_logs
from orderstream.sources.reports import read_exceptions, read_failures, read_history, read_stats

START = utc("2025-12-09 10:00:00")


def log_of(spark, rows):
    """Requests from (seconds, name, status, duration in ms, error) tuples."""
    data = [
        (START + timedelta(seconds=s), name.split()[0], name.split()[1], name, status, ms / 1000, 100, error, f"n{i % 2}")
        for i, (s, name, status, ms, error) in enumerate(rows)
    ]
    return spark.createDataFrame(data, REQUEST_LOG)


def random_log(spark, n=400, seed=3):
    rng = random.Random(seed)
    return log_of(
        spark,
        [
            (rng.uniform(0, 900), rng.choice(["GET /a", "POST /b"]), rng.choice([200, 200, 200, 404, 500]), round(rng.expovariate(1 / 80), 1), rng.choice([None, None, "reset", "refused"]))
            for _ in range(n)
        ],
    )


def test_histogram_and_quantile(spark):
    log = random_log(spark)
    durations = {}
    for r in log.collect():
        durations.setdefault(r.endpoint, []).append(r.duration_s)
    buckets = {(r.endpoint, r.method, r.le): r.bucket_count for r in requests.latency_histogram(log).collect()}
    for endpoint, values in durations.items():
        method = "GET" if endpoint == "/a" else "POST"
        for bound in LATENCY_BOUNDS:
            assert buckets[endpoint, method, str(bound)] == sum(v <= bound for v in values)
        assert buckets[endpoint, method, "+Inf"] == len(values)
    got = {r.endpoint: r.latency_s for r in requests.latency_quantile(log, ["endpoint"]).collect()}
    for endpoint, values in durations.items():
        rank, below, low = 0.95 * len(values), 0, 0.0
        for bound in LATENCY_BOUNDS:
            upto = sum(v <= bound for v in values)
            if upto >= rank:
                assert got[endpoint] == pytest.approx(low + (bound - low) * (rank - below) / (upto - below))
                break
            low, below = bound, upto


def test_quantile_edges(spark):
    slow = log_of(spark, [(0, "GET /a", 200, 60_000, None)])
    assert requests.latency_quantile(slow, ["endpoint"]).first().latency_s == 10.0
    unknown = slow.withColumn("duration_s", F.lit(None).cast("double"))
    assert requests.latency_quantile(unknown, ["endpoint"]).first().latency_s is None


def test_rates_match_a_count_per_range(spark):
    log = random_log(spark, 120)
    times = {}
    for r in log.collect():
        times.setdefault((r.endpoint, r.method), []).append(r.ts.replace(tzinfo=START.tzinfo))
    points = {(r.sample_ts.replace(tzinfo=START.tzinfo), r.endpoint, r.method): r.rate for r in rates.request_rate(log).collect()}
    for key, ts in times.items():
        for minute in range(0, 25):
            at = START + timedelta(minutes=minute)
            n = sum(at - timedelta(minutes=5) <= t < at for t in ts)
            assert points.get((at, *key), 0.0) == pytest.approx(n / 300)
    assert all(rate > 0 for rate in points.values())


def test_run_ledger(spark):
    runs = spark.createDataFrame(
        [(START, "x-aggregator", "failed"), (START + timedelta(seconds=30), "x-aggregator", "active"), (START + timedelta(minutes=5), "cleanup", "succeeded")], RUN_LOG
    )
    assert tuple(requests.run_ledger(runs, "aggregator").first()) == (1, 0, 1)
    assert tuple(requests.run_ledger(runs.limit(0), "aggregator").first()) == (0, 0, 0)
    assert requests.freshness_lag(runs, START + timedelta(minutes=2), "aggregator").first().lag_s == 90.0


def rounded(ms):
    return round(ms, 0 if ms < 100 else -1 if ms < 1000 else -2 if ms < 10000 else -3)


def test_rounding(spark):
    values = [0.4, 0.5, 1.5, 2.5, 99.4, 99.5, 99.9, 100.0, 104.9, 105.0, 115.0, 172.9, 994.9, 1050.0, 1150.0, 9949.0, 10500.0, 11500.0]
    df = spark.createDataFrame([(v,) for v in values], "ms DOUBLE").select(loadstats.rounded_ms(F.col("ms").cast("decimal(18,6)")).alias("r"))
    assert [r.r for r in df.collect()] == [int(rounded(v)) for v in values]


def test_request_statistics(spark):
    log = random_log(spark)
    by_name = {}
    for r in log.collect():
        for name in (r.name, None):
            by_name.setdefault(name, []).append(r)
    span = (max(r.ts for r in by_name[None]) - min(r.ts for r in by_name[None])).total_seconds()
    stats = {r.name: r for r in loadstats.request_stats(log).collect()}
    assert set(stats) == set(by_name)
    for name, rows in by_name.items():
        got, ms = stats[name], [round(r.duration_s * 1000, 6) for r in rows]
        ordered = sorted(rounded(m) for m in ms)
        failures = sum(r.error is not None or r.status_code >= 400 for r in rows)
        assert (got.request_count, got.failure_count) == (len(rows), failures)
        assert got.median_ms == ordered[(len(ordered) - 1) // 2]
        assert got.mean_ms == pytest.approx(sum(ms) / len(ms)) and (got.min_ms, got.max_ms) == (min(ms), max(ms))
        assert got.requests_per_s == pytest.approx(len(rows) / span)
        for p, column in ((0.5, "p50"), (0.95, "p95"), (0.999, "p99_9"), (1.0, "p100")):
            allowed = math.floor(len(rows) * p)
            assert got[column] == max(v for v in ordered if sum(o < v for o in ordered) <= allowed), (name, p)


def test_median_and_half_differ_on_even_counts(spark):
    """With 12 times the median is the 6th and the 50 % mark the 7th."""
    times = [2, 3, 4, 4, 5, 5, 9, 10, 16, 17, 41, 46]
    stats = loadstats.request_stats(log_of(spark, [(i, "GET /a", 200, t, None) for i, t in enumerate(times)])).where("name IS NOT NULL").first()
    assert (stats.median_ms, stats.p50, stats.p90, stats.p95, stats.p100) == (5, 9, 41, 46, 46)


def test_single_request_has_no_rate(spark):
    stats = loadstats.request_stats(log_of(spark, [(0, "GET /a", 200, 5, None)])).first()
    assert stats.requests_per_s == 0.0


def test_breaking_point(spark):
    core = ("GET /a",)
    ok = [(i / 10, "GET /a", 200, 5, None) for i in range(600)]
    failing = [(60 + i / 10, "GET /a", 500, 5, None) for i in range(100)]
    noise = [(i / 10, "GET /other", 500, 5, None) for i in range(600)]
    broke = loadstats.breaking_point(log_of(spark, ok + failing + noise), core).first()
    # 67 errors in 667 requests are the first share of at least 10 %; the tick ends with 70.
    assert (broke.outcome, broke.tick, broke.users, broke.requests, broke.errors) == ("broke", 66, 90, 670, 70)
    few = loadstats.breaking_point(log_of(spark, failing[:40]), core).first()
    assert (few.outcome, few.requests, few.tick) == ("completed", 40, 3)
    full = loadstats.breaking_point(log_of(spark, ok), core, max_users=50).first()
    assert (full.outcome, full.users, full.tick, full.errors) == ("max users", 50, 30, 0)


def test_report_files(spark, tmp_path):
    report = load_report(random_log(spark), ("GET /a",))
    paths = export_load_report(report, str(tmp_path), "v2", "spike")
    assert paths["stats"].endswith("v2_spike_stats")
    stats = {r.Name: r for r in read_stats(spark, paths["stats"]).collect()}
    want = {r.name or "Aggregated": r for r in report["stats"].collect()}
    assert {n: (r["Request Count"], r["95%"]) for n, r in stats.items()} == {n: (r.request_count, float(r.p95)) for n, r in want.items()}
    assert rows_of(read_failures(spark, paths["failures"])) == rows_of(report["failures"])
    assert rows_of(read_exceptions(spark, paths["exceptions"]), "Message", "Count", "Nodes") == rows_of(report["exceptions"])


def test_history_file(spark, tmp_path):
    from orderstream.schemas import HISTORY_COLUMNS

    values = ["1765483319", "0", "", "Aggregated", "0.0", "0.0", *["N/A"] * 11, "0", "0", "0", "0.0", "0", "0", "0"]
    (tmp_path / "h.csv").write_text(",".join(HISTORY_COLUMNS) + "\n" + ",".join(values) + "\n")
    row = read_history(spark, str(tmp_path / "h.csv")).first()
    assert (row["Timestamp"], row["Name"], row["95%"], row["Total Request Count"]) == (1765483319, "Aggregated", None, 0)


def test_logs(spark, tmp_path):
    (tmp_path / "api").mkdir()
    (tmp_path / "api" / "a.log").write_text('{"timestamp":"2025-01-01T00:00:01","level":"INFO","logger":"api","message":"hi","module":"m","function":"f","line":3}\nnot json\n')
    logs = read_logs(spark, str(tmp_path / "api"), "shop", "api").withColumn("ts", F.to_timestamp("timestamp"))
    chosen = requests.select_logs(logs, "shop", "api").collect()
    assert [(r.level, r.line, r.malformed) for r in chosen] == [(None, None, "not json"), ("INFO", 3, None)]
    assert requests.select_logs(logs, "shop", "frontend").count() == 0
    streamed = stream_logs(spark, str(tmp_path / "api"), "shop", "api")
    assert streamed.isStreaming and {c.split()[0] for c in APP_LOG.split(", ")} <= set(streamed.columns)


def test_panels(spark, five_orders):
    runs = spark.createDataFrame([(START, "aggregator", "succeeded")], RUN_LOG)
    made = panels(random_log(spark, 50), five_orders, runs, START + timedelta(minutes=1))
    assert set(made) >= {"request_rate", "latency_p95", "items_per_minute", "revenue_per_minute", "run_ledger", "freshness_lag"}
    per_minute = made["items_per_minute"].where("drink = 'cappuccino'").collect()
    assert len(per_minute) == 5 and per_minute[0].per_minute == pytest.approx(3 / 300 * 60)
    assert rows_of(made["orders_counter"].where("drink = 'latte'")) == [("latte", "uptown", "v3", 1)]


def brute_visibility(orders, refreshes, wait):
    refreshes = sorted(refreshes)
    out = {}
    for i, ts in orders:
        before = [c for r, c in refreshes if r <= ts]
        baseline = before[-1] if before else 0
        later = [r for r, c in refreshes if r > ts and (r - ts).total_seconds() <= wait and c > baseline]
        out[i] = (min(later) - ts).total_seconds() * 1000 if later else None
    return out


@pytest.mark.parametrize("seed", range(5))
def test_visibility_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    base = utc("2025-12-09 22:00:00")
    wait = 7 * 86_400 if seed == 4 else 1800 if seed % 2 else 60
    refreshes, at = [], base
    for _ in range(60):
        at += timedelta(seconds=rng.choice([7, 60, 300, 900, 1801, 9000]))
        refreshes.append((at, rng.randint(0, 6)))
    span = (at - base).total_seconds()
    orders = [(i, base + timedelta(seconds=rng.uniform(-4000, span + 4000))) for i in range(300)]
    orders += [(1000 + i, r) for i, (r, _) in enumerate(refreshes)]  # placed exactly at a refresh
    got = visibility.visibility(
        spark.createDataFrame(orders, "id BIGINT, ts TIMESTAMP"), spark.createDataFrame(refreshes, "refresh_ts TIMESTAMP, order_count BIGINT"), wait
    ).collect()
    want = brute_visibility(orders, refreshes, wait)
    assert len(got) == len(orders)
    for r in got:
        assert (r.latency_ms is None) == r.timed_out == (want[r.id] is None)
        if want[r.id] is not None:
            assert r.latency_ms == pytest.approx(want[r.id], abs=0.01)


def test_visibility_without_refreshes(spark):
    orders = spark.createDataFrame([(1, START)], "id BIGINT, ts TIMESTAMP")
    none = spark.createDataFrame([], "refresh_ts TIMESTAMP, order_count BIGINT")
    assert visibility.visibility(orders, none, 30).first().timed_out
    assert visibility.visibility(orders, none, 90_000).first().timed_out


@pytest.mark.parametrize(("n", "kind"), [(0, "any"), (1, "any"), (400, "any"), (400, "falling"), (400, "rising"), (400, "equal")])
def test_next_greater_equals_brute_force(spark, tmp_path, n, kind):
    """Over several ranges, also where every value waits beyond its own."""
    from orderstream.operators.nextgreater import next_greater

    rng = random.Random(n)
    times = [rng.randrange(300) for _ in range(n)]
    of = {"any": lambda t: rng.randrange(40), "falling": lambda t: -t if t < 299 else 7, "rising": lambda t: t, "equal": lambda t: 3}[kind]
    rows = [(t, of(t)) for t in times]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:  # as many ranges as there are partitions
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        df = next_greater(spark.createDataFrame(rows, "at bigint, value bigint"), str(tmp_path / "ranges"))
        got = sorted(df.collect(), key=lambda r: (r["at"], r.value, r.following is None, r.following or 0))
        assert n < 2 or spark.read.parquet(str(tmp_path / "ranges" / "ranges")).select("range").distinct().count() >= 5 or kind == "equal"
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    rows.sort()
    want = []
    for i, (t, v) in enumerate(rows):
        greater = next((a for a, x in rows[i + 1 :] if x > v), None)
        want.append((t, v, rows[i + 1][0] if i + 1 < n else None, greater))
    assert [tuple(r) for r in got] == want


def test_null_keys_meet_in_a_diff(spark):
    from orderstream.operators.diffing import compared

    one = spark.createDataFrame([(1, None, 2), (1, "a", 3)], "hour int, item string, n int")
    two = spark.createDataFrame([(1, None, 2), (1, "b", 3)], "hour int, item string, n int")
    got = compared(one, two, ["hour", "item"], ["n"]).select("hour", "item", "status").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a", "removed"), (1, "b", "added"), (1, None, "same")]


def test_positions_never_collide(spark):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from orderstream.sources.streams import arrival_of, kafka_text

    rows = [(p, o, t) for p in (0, 1, 1023, 1024, 5000) for o in (0, 1, 2) for t in ("x", "y")]
    df = spark.createDataFrame(rows, "partition int, offset bigint, topic string")
    place = lambda topics: arrival_of(F.col("partition"), F.col("offset"), F.col("topic"), topics)
    assert df.select(place(("x", "y")).alias("p")).distinct().count() == len(rows)
    for topics in (("x",), ("y", "z")):
        with pytest.raises(PySparkException):
            df.select(place(topics).alias("p")).collect()
    for bad in ((0, 0, None), (None, 0, "x"), (-1, 0, "x"), (0, None, "x"), (0, 1 << 40, "x"), (1 << 22, 0, "x")):
        with pytest.raises(PySparkException):
            spark.createDataFrame([bad], df.schema).select(place(("x", "y")).alias("p")).collect()
    shaped = df.select(F.lit(None).cast("binary").alias("key"), F.encode(F.lit("v"), "UTF-8").alias("value"), "*", F.current_timestamp().alias("timestamp"))
    assert kafka_text(shaped, ("x", "y")).select("arrival").distinct().count() == len(rows)


def test_a_version_is_whole_or_absent(spark, five_orders, tmp_path):
    """Readers take all three documents of the newest whole version; a half-written one is not there."""
    root, stamps = str(tmp_path / "versions"), [F.lit(None).cast("timestamp").alias(c) for c in ("updated_at", "expires_at")]
    for minute in (15, 45):
        now = utc(f"2025-12-09 10:{minute}:00")
        seen = five_orders.where(F.col("ts") <= F.lit(now))
        documents = Documents(
            current_hour_document(metrics.hour_items(seen), now),
            metrics.name_list(metrics.top_items_over(seen, now)).select("names", *stamps),
            recent_orders(seen, now).select("*", *stamps),
        )
        commit(documents, root, now)
    half = tmp_path / "versions" / "version=9000000000000000" / "_temporary" / "0"
    half.mkdir(parents=True)
    (half / "part-00000.parquet").write_bytes(b"PAR1 and no more")
    got = committed_documents(spark, root)
    n = five_orders.where(F.col("ts") <= F.lit(now)).count()
    assert got.hourly.first().order_count == n and got.recent.count() == n and got.top.count() == 1
    assert got.hourly.first().updated_at == documents.hourly.first().updated_at
