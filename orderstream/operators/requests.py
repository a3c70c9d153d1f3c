"""Request counters, cumulative latency histograms and quantiles estimated from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderstream.functions.times import AsOf, moment
from orderstream.operators.rates import sliding_sums
from orderstream.schemas import LATENCY_BOUNDS


def request_counter(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", "endpoint", "status_code").agg(F.count("*").alias("request_count"))


def bucket_counts(bounds: tuple[float, ...], duration: str = "duration_s") -> dict[str, Column]:
    """One cumulative count per bound, and one for everything, as plain aggregates.

    The bounds become columns of one aggregation; rows are not multiplied by the number of bounds.
    """
    d = F.col(duration)
    counts = {f"b{i}": F.count_if(d <= F.lit(bound)) for i, bound in enumerate(bounds)}
    return counts | {f"b{len(bounds)}": F.count(d)}


def latency_histogram(requests: DataFrame, bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """Per method and endpoint one row per bucket; each count includes the smaller buckets."""
    labels = [*map(str, bounds), "+Inf"]
    wide = requests.groupBy("method", "endpoint").agg(*[c.alias(n) for n, c in bucket_counts(bounds).items()])
    rows = F.array(*[F.struct(F.lit(le).alias("le"), F.col(f"b{i}").alias("bucket_count")) for i, le in enumerate(labels)])
    return wide.select("method", "endpoint", F.inline(rows))


def quantile_of_buckets(bounds: tuple[float, ...], q: float) -> Column:
    """Linear interpolation inside the bucket that holds rank q·total, from `bucket_counts` columns.

    The last finite bound when the rank falls beyond it; null when nothing was counted. Spelled out
    bucket by bucket, so that it compiles into the surrounding stage.
    """
    counts = [F.col(f"b{i}").cast("double") for i in range(len(bounds) + 1)]
    total = counts[-1]
    rank = F.lit(q) * total
    estimate = F.when(total == 0, F.lit(None).cast("double"))
    low, below = F.lit(0.0), F.lit(0.0)
    for bound, upto in zip(bounds, counts, strict=False):
        high = F.lit(float(bound))
        estimate = estimate.when(upto >= rank, low + (high - low) * ((rank - below) / (upto - below)))
        low, below = high, upto
    return estimate.otherwise(F.lit(float(bounds[-1])))


def latency_quantile(
    requests: DataFrame, keys: list[str], q: float = 0.95, bounds: tuple[float, ...] = LATENCY_BOUNDS
) -> DataFrame:
    wide = requests.groupBy(*keys).agg(*[c.alias(n) for n, c in bucket_counts(bounds).items()])
    return wide.select(*keys, quantile_of_buckets(bounds, q).alias("latency_s"))


def latency_quantile_over_time(
    requests: DataFrame,
    keys: list[str],
    q: float = 0.95,
    range_minutes: int = 5,
    step_minutes: int = 1,
    bounds: tuple[float, ...] = LATENCY_BOUNDS,
) -> DataFrame:
    """The same quantile over a sliding range; the ratio of two rates is the ratio of their counts."""
    sums = sliding_sums(requests, keys, bucket_counts(bounds), range_minutes, step_minutes)
    return sums.select("sample_ts", *keys, quantile_of_buckets(bounds, q).alias("latency_s"))


def run_ledger(runs: DataFrame, job_pattern: str) -> DataFrame:
    """Active, succeeded and failed runs of the matching jobs; zeros when there are none."""
    mine = runs.where(F.col("job").rlike(job_pattern))
    return mine.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("active", "succeeded", "failed")])


def freshness_lag(runs: DataFrame, as_of: AsOf, job_pattern: str) -> DataFrame:
    """Seconds since the newest matching run."""
    newest_run = runs.where(F.col("job").rlike(job_pattern)).agg(F.max("run_ts").alias("run_ts"))
    lag = (F.unix_micros(moment(as_of)) - F.unix_micros("run_ts")) / F.lit(1_000_000.0)
    return newest_run.select(lag.alias("lag_s"))


def select_logs(logs: DataFrame, ns: str, app: str) -> DataFrame:
    """Log lines of one application, in time order."""
    return logs.where((F.col("ns") == ns) & (F.col("app") == app)).orderBy("ts")
