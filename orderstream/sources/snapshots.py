"""Point reads of stored snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderstream.functions.times import AsOf, moment, start_of_hour
from orderstream.operators.ranges import fresh


def hourly_at(hourly: DataFrame, as_of: AsOf) -> DataFrame:
    """The document of the current hour: one row, or none when it is missing or has expired."""
    return fresh(hourly.where(F.col("hour_start") == moment(as_of, start_of_hour)), as_of)
