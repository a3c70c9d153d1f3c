"""Load-test report files: CSV with a header, `N/A` for a missing value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from orderstream.schemas import EXCEPTION_COLUMNS, FAILURE_COLUMNS, HISTORY_COLUMNS, STATS_COLUMNS

_TEXT = {"Type", "Name", "Method", "Error", "Message", "Traceback", "Nodes"}
_COUNT = {
    "Timestamp", "User Count", "Request Count", "Failure Count", "Total Request Count", "Total Failure Count",
    "Occurrences", "Count",
}


def report_schema(columns: tuple[str, ...]) -> T.StructType:
    def kind(name: str) -> T.DataType:
        if name in _TEXT:
            return T.StringType()
        return T.LongType() if name in _COUNT else T.DoubleType()

    return T.StructType([T.StructField(name, kind(name)) for name in columns])


def _read(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    return (
        spark.read.schema(report_schema(columns))
        .option("header", True)
        .option("nullValue", "N/A")
        .option("emptyValue", "")
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, STATS_COLUMNS)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, HISTORY_COLUMNS)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, FAILURE_COLUMNS)


def read_exceptions(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, EXCEPTION_COLUMNS)
