from __future__ import annotations

import sys
from datetime import UTC, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


ORDER_ROW = (
    "id BIGINT, arrival BIGINT, message_id STRING, drink STRING, store STRING, price DECIMAL(10,2), ts TIMESTAMP,"
    " version STRING"
)


@pytest.fixture(scope="session")
def orders_of(spark):
    """Orders from (drink, store, price, time) tuples; id, arrival and message id by position."""

    def build(rows, start: int = 1):
        data = [
            (i, i, f"m{i}", drink, store, None if price is None else Decimal(str(price)), utc(ts), "v3")
            for i, (drink, store, price, ts) in enumerate(rows, start)
        ]
        return spark.createDataFrame(data, ORDER_ROW)

    return build


@pytest.fixture(scope="session")
def five_orders(orders_of):
    at = "2025-12-09 10:30:00"
    return orders_of(
        [
            ("cappuccino", "downtown", "5.50", at),
            ("latte", "uptown", "4.75", at),
            ("cappuccino", "central", "5.50", at),
            ("americano", "southend", "3.50", at),
            ("cappuccino", "downtown", "5.50", at),
        ]
    )


def rows_of(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=str)
