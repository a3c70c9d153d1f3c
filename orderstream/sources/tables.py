"""The order fact table: stored as Parquet, or reachable through JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException

from orderstream.schemas import ORDER

ORDER_COLUMNS = ("id", "drink", "store", "price", "ts")


def read_table(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(root)


def ensure_table(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Reads a table of batch folders; one that has no batch yet is empty."""
    try:
        return read_table(spark, root, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], schema)


def read_batch(spark: SparkSession, root: str, schema: str, batch_id: int) -> DataFrame:
    """One batch of a table; only its own folder is listed."""
    return spark.read.schema(schema).option("basePath", root).parquet(f"{root}/batch_id={batch_id}")


def orders_scan(spark: SparkSession, root: str) -> DataFrame:
    """The five reporting columns; Parquet reads only these, and prunes by `order_date`."""
    return read_table(spark, root, ORDER).select(*ORDER_COLUMNS, "order_date")


def jdbc_orders_scan(
    spark: SparkSession, url: str, table: str, bounds: tuple[int, int], partitions: int, **options: str
) -> DataFrame:
    """Orders from a database table, read in parallel ranges of the primary key.

    `bounds` only places the range limits; rows outside them are still read.
    """
    return (
        spark.read.format("jdbc")
        .options(**options)
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", "id")
        .option("lowerBound", bounds[0])
        .option("upperBound", bounds[1])
        .option("numPartitions", partitions)
        .load()
        .select("id", "drink", "store", "price", "timestamp")
        .withColumnRenamed("timestamp", "ts")
    )
