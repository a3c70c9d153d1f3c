"""Load-test statistics from a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderstream.functions.values import share
from orderstream.operators.numbering import running_totals
from orderstream.schemas import CORE_REQUESTS, REPORT_PERCENTILES


def is_error(error: Column, status: Column) -> Column:
    """A request failed if it raised, or else if its status is 400 or above."""
    return F.when(error.isNotNull(), F.lit(True)).otherwise(F.coalesce(status >= 400, F.lit(False)))


def rounded_ms(ms: Column) -> Column:
    """Response times as a report keeps them: about two significant digits, halves to even."""
    return (
        F.when(ms < 100, F.bround(ms, 0))
        .when(ms < 1000, F.bround(ms, -1))
        .when(ms < 10000, F.bround(ms, -2))
        .otherwise(F.bround(ms, -3))
        .cast("bigint")
    )


def percentile_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def request_stats(requests: DataFrame, percentiles: tuple[float, ...] = REPORT_PERCENTILES) -> DataFrame:
    """Per method and name, and overall (both null): counts, response times, sizes, rates, percentiles.

    Percentiles and median are those of the rounded response times, as the report defines them, so
    one shuffle reduces the log to a short histogram per name and everything else runs on that.
    Rates are per second of the whole log.
    """
    ms = (F.col("duration_s") * F.lit(1000.0)).cast("decimal(18,6)")
    failed = is_error(F.col("error"), F.col("status_code"))
    histogram = (
        requests.select("method", "name", "bytes", "ts", ms.alias("ms"), failed.alias("failed"))
        .groupBy("method", "name", rounded_ms(F.col("ms")).alias("rounded"))
        .agg(
            F.count("*").alias("n"),
            F.count_if("failed").alias("fails"),
            F.sum("ms").alias("sum_ms"),
            F.min("ms").alias("min_ms"),
            F.max("ms").alias("max_ms"),
            F.sum("bytes").alias("bytes"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )
    with_overall = histogram.groupingSets(
        [[F.col("method"), F.col("name"), F.col("rounded")], [F.col("rounded")]], "method", "name", "rounded"
    ).agg(
        F.grouping("name").alias("overall"),
        *[F.sum(c).alias(c) for c in ("n", "fails", "sum_ms", "bytes")],
        *[F.min(c).alias(c) for c in ("min_ms", "first_ts")],
        *[F.max(c).alias(c) for c in ("max_ms", "last_ts")],
    )
    group = Window.partitionBy("overall", "method", "name")
    below = group.orderBy("rounded").rowsBetween(Window.unboundedPreceding, -1)
    placed = with_overall.withColumns(
        {"below": F.coalesce(F.sum("n").over(below), F.lit(0)), "total": F.sum("n").over(group)}
    )

    def at_percentile(p: float) -> Column:
        rank = F.floor(F.col("total").cast("double") * F.lit(p))
        return F.max(F.when(F.col("below") <= rank, F.col("rounded"))).alias(percentile_name(p))

    middle = (F.col("total") - 1) / F.lit(2.0)
    median = F.min(F.when(F.col("below") + F.col("n") > middle, F.col("rounded")))
    n = F.sum("n")
    stats = placed.groupBy("overall", "method", "name").agg(
        n.cast("bigint").alias("request_count"),
        F.sum("fails").cast("bigint").alias("failure_count"),
        median.alias("median_ms"),
        (F.sum("sum_ms").cast("double") / n).alias("mean_ms"),
        F.min("min_ms").cast("double").alias("min_ms"),
        F.max("max_ms").cast("double").alias("max_ms"),
        (F.sum("bytes").cast("double") / n).alias("mean_bytes"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        *[at_percentile(p) for p in percentiles],
    )
    span = Window.partitionBy(F.lit(0))  # one row per request name
    seconds = (
        F.unix_micros(F.max("last_ts").over(span)) - F.unix_micros(F.min("first_ts").over(span))
    ) / F.lit(1_000_000.0)
    return (
        stats.withColumn("seconds", seconds)
        .withColumns(
            {
                "requests_per_s": F.coalesce(F.try_divide(F.col("request_count"), F.col("seconds")), F.lit(0.0)),
                "failures_per_s": F.coalesce(F.try_divide(F.col("failure_count"), F.col("seconds")), F.lit(0.0)),
            }
        )
        .drop("overall", "first_ts", "last_ts", "seconds")
    )


def failures_by_error(requests: DataFrame) -> DataFrame:
    """Occurrences of each failure by method, name and error text."""
    failed = requests.where(is_error(F.col("error"), F.col("status_code")))
    return failed.groupBy("method", "name", "error").agg(F.count("*").alias("occurrences"))


def exceptions_by_message(requests: DataFrame) -> DataFrame:
    """Occurrences of each exception message, with the load nodes it happened on."""
    raised = requests.where(F.col("error").isNotNull())
    per_node = raised.groupBy("error", "node").agg(F.count("*").alias("n"))
    return per_node.groupBy(F.col("error").alias("message")).agg(
        F.sum("n").cast("bigint").alias("occurrences"),
        F.array_join(F.sort_array(F.collect_set("node")), ", ").alias("nodes"),
    )


def breaking_point(
    requests: DataFrame,
    core_names: tuple[str, ...] = CORE_REQUESTS,
    start_users: int = 10,
    step_users: int = 20,
    step_seconds: int = 15,
    max_users: int = 500,
    threshold: float = 0.10,
    min_requests: int = 50,
    tick_seconds: int = 1,
) -> DataFrame:
    """Where a stepped load test stopped: one row with outcome, users, counts and error share.

    Every tick looks at the requests so far. The test breaks at the first tick with more than
    `min_requests` of them and an error share at or above the threshold, ends unbroken once the
    users reach the maximum, and is `completed` if the log ends before either.
    """
    core = requests.where(F.col("name").isin(*core_names)).select(
        "ts", is_error(F.col("error"), F.col("status_code")).alias("failed")
    )
    first = core.agg(F.min("ts").alias("at")).select(F.unix_micros("at").alias("at")).scalar()
    tick = F.floor((F.unix_micros("ts") - first) / F.lit(tick_seconds * 1_000_000))
    per_tick = core.groupBy(tick.alias("tick")).agg(
        F.count("*").alias("requests"), F.count_if("failed").alias("errors")
    )
    so_far = running_totals(per_tick, "tick", ["requests", "errors"], 100_000)
    steps = F.floor(F.col("tick") * tick_seconds / F.lit(step_seconds))
    users = F.least(F.lit(start_users) + steps * step_users, F.lit(max_users)).cast("bigint")
    error_share = share(F.col("errors"), F.col("requests"))
    broke = (F.col("requests") > min_requests) & (error_share >= threshold)
    judged = so_far.select(
        F.when(broke, "broke").when(users >= max_users, "max users").otherwise("completed").alias("outcome"),
        users.alias("users"),
        F.col("tick").cast("bigint").alias("tick"),
        F.col("requests").cast("bigint").alias("requests"),
        F.col("errors").cast("bigint").alias("errors"),
        error_share.alias("error_share"),
    )
    ended = F.col("outcome") != "completed"
    # The first ending tick; without one, the last tick of the log.
    return judged.orderBy(F.when(ended, F.col("tick")).asc_nulls_last(), F.col("tick").desc()).limit(1)
