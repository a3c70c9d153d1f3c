"""Application logs: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderstream.schemas import APP_LOG


def parse_log_lines(lines: DataFrame, value: str = "value", schema: str = APP_LOG) -> DataFrame:
    """Adds the declared fields of each JSON line; other columns (labels of the source) are kept.

    A line that is not a JSON object has null fields and keeps its text in `malformed`.
    """
    parsed = F.from_json(value, f"{schema}, malformed STRING", {"columnNameOfCorruptRecord": "malformed"})
    return lines.select("*", F.inline(F.array(parsed)))


def read_logs(spark: SparkSession, path: str, ns: str, app: str) -> DataFrame:
    """Batch read of one application's log files, labelled."""
    return parse_log_lines(spark.read.text(path)).withColumns({"ns": F.lit(ns), "app": F.lit(app)})


def stream_logs(spark: SparkSession, path: str, ns: str, app: str) -> DataFrame:
    """Streaming read of one application's log files, labelled."""
    return parse_log_lines(spark.readStream.text(path)).withColumns({"ns": F.lit(ns), "app": F.lit(app)})
