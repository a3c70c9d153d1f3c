"""Tables written in batch folders.

Batch `n` of a table lives below `batch_id=n` and is written as a whole. Writing it again replaces
it, so a batch that is retried after a lost executor or driver leaves the same table behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_batch(df: DataFrame, root: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/batch_id={batch_id}")


def before_batch(table: DataFrame, batch_id: int) -> DataFrame:
    """What was stored before this batch, whether or not an earlier attempt at it got written."""
    return table.where(F.col("batch_id") < batch_id)


def latest_per_key(log: DataFrame, keys: list[str]) -> DataFrame:
    """Newest value per key of a table whose batches hold absolute values of the keys they changed."""
    values = [c for c in log.columns if c not in {*keys, "batch_id"}]
    newest = F.max_by(F.struct(*values), "batch_id").alias("newest")
    return log.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def merge_batches(table: DataFrame, new_root: str, upto: int, partition_by: tuple[str, ...] = ()) -> None:
    """Rewrites all batches up to one as that batch of a new table, in files of the advisory size.

    The rebalance hint gathers the rows of a partition value and splits the large ones again, so
    neither many small files nor one huge task comes out of it.
    """
    settled = table.where(F.col("batch_id") <= upto).drop("batch_id")
    write_batch(settled.hint("rebalance", *partition_by), new_root, upto, partition_by)


def compact(log: DataFrame, keys: list[str], new_root: str, upto: int, additive: dict | None = None) -> None:
    """Writes the state up to a batch as one batch of a new table; later batches are added to that.

    The old table stays as it is. `additive` maps columns to aggregates for tables whose batches
    hold increments instead of absolute values.
    """
    settled = log.where(F.col("batch_id") <= upto)
    if additive is None:
        state = latest_per_key(settled, keys)
    else:
        state = settled.groupBy(*keys).agg(*[agg.alias(name) for name, agg in additive.items()])
    write_batch(state, new_root, upto)
