"""Load-test report files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderstream.operators.loadstats import percentile_name
from orderstream.schemas import REPORT_PERCENTILES


def stats_rows(stats: DataFrame) -> DataFrame:
    """Request statistics under the column titles of the report; the overall row is `Aggregated`."""
    title = F.coalesce("name", F.lit("Aggregated"))
    named = {
        "Request Count": "request_count",
        "Failure Count": "failure_count",
        "Median Response Time": "median_ms",
        "Average Response Time": "mean_ms",
        "Min Response Time": "min_ms",
        "Max Response Time": "max_ms",
        "Average Content Size": "mean_bytes",
        "Requests/s": "requests_per_s",
        "Failures/s": "failures_per_s",
    }
    percentiles = [F.col(percentile_name(p)).alias(f"{p * 100:g}%") for p in REPORT_PERCENTILES]
    return stats.select(
        F.coalesce("method", F.lit("")).alias("Type"),
        title.alias("Name"),
        *[F.col(column).alias(title) for title, column in named.items()],
        *percentiles,
    )


def export_report(report: DataFrame, folder: str, version: str, phase: str, kind: str = "stats") -> str:
    """Writes a report as one CSV part below `{version}_{phase}_{kind}`; one row per request name."""
    path = f"{folder}/{version}_{phase}_{kind}"
    report.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "N/A").option(
        "escape", '"'
    ).csv(path)
    return path
