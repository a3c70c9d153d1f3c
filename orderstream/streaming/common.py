"""Starting queries and writing their batches."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from orderstream.sinks.batches import write_batch


def start(
    stream: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
    mode: str = "append",
    partitions: int | None = None,
) -> StreamingQuery:
    """Starts a query that hands each micro-batch to `on_batch`.

    `every` is the trigger interval; without it the query works off what is there and stops.
    `partitions` is the number of state partitions, which the first start of a checkpoint fixes;
    without it the session's setting counts. A failing batch fails the query, and its offsets are
    not committed.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if partitions is None:
        return writer.start()
    # A query copies the session's settings when it starts.
    conf, name = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    conf.set(name, partitions)
    try:
        return writer.start()
    finally:
        conf.set(name, before)


def together(spark: SparkSession, *writes: Callable[[], None]) -> None:
    """Runs independent writes of one batch side by side; the first failure is raised.

    The threads carry the job group of the batch, so stopping the query also stops their jobs.
    """
    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(write)) for write in writes]:
            done.result()


def keep_changes(root: str) -> Callable[[DataFrame, int], None]:
    """Batch handler that stores the absolute values a stateful query emits."""

    def write(changes: DataFrame, batch_id: int) -> None:
        write_batch(changes, root, batch_id)

    return write
