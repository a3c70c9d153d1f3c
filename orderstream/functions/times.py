"""Time expressions. The moment of evaluation is always an argument, never the clock."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A fixed moment, or a column that holds it.
AsOf = datetime | Column

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def newest(df: DataFrame, ts: str = "ts") -> datetime:
    """The latest timestamp of a table: one number read back from a one-column scan.

    Jobs get their moment from outside; this is for data whose newest row stands for now. As a
    literal it reaches partition pruning and the Parquet filters, which a subquery would not.
    """
    micros = df.agg(F.unix_micros(F.max(ts)).alias("at")).first()["at"]
    return _EPOCH + timedelta(microseconds=micros or 0)


def moment(as_of: AsOf, shift: Callable[[Column], Column] = lambda c: c) -> Column:
    """The moment, shifted. A moment without a zone is UTC."""
    if isinstance(as_of, datetime):
        as_of = F.lit(as_of if as_of.tzinfo else as_of.replace(tzinfo=UTC))
    return shift(as_of)


def back(interval: str) -> Callable[[Column], Column]:
    return lambda c: c - F.expr(f"interval {interval}")


def start_of_hour(c: Column) -> Column:
    return F.date_trunc("hour", c)


def hour_of_day(hour: int) -> Callable[[Column], Column]:
    """The given hour on the UTC day of the moment."""
    return lambda c: F.date_trunc("day", c) + F.make_interval(hours=F.lit(hour))


def plus(shift: Callable[[Column], Column], interval: str) -> Callable[[Column], Column]:
    return lambda c: shift(c) + F.expr(f"interval {interval}")


def elapsed_ms(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1000.0)


def iso_text(ts: Column) -> Column:
    """ISO-8601 text; the fraction appears only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def parse_iso(text: Column) -> Column:
    """Timestamp from ISO-8601 text, null when it is not one.

    The leading check keeps out texts Spark's cast would complete by itself, such as a bare year
    or a time without a date. A zone-less text is read in the session zone.
    """
    looks_iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$")
    return F.when(looks_iso, F.try_to_timestamp(text))


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def updated_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'")


def hour_text(hour: Column) -> Column:
    return F.concat(hour.cast("string"), F.lit(":00"))
