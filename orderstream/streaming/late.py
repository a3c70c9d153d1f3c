"""Late rows: split off before figures are kept, or counted where Spark's state drops them.

A split stream keeps its own watermark: the newest order time of all earlier batches less a delay.
Rows before it go to a side table, the others into the hours, and each batch leaves one row in a
ledger. Watermark and ledger live with the tables, under the batch's number, so they are exact after
any number of batches and restarts, and the two tables together have every row.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from orderstream.operators.metrics import hour_items, merge_hour_items
from orderstream.schemas import ARRIVED_ORDER, HOUR_RUN
from orderstream.sinks.batches import write_batch
from orderstream.sinks.files import get_text, put_text
from orderstream.sinks.levels import Levels
from orderstream.sources.tables import ensure_table, read_batch
from orderstream.streaming.common import start, together

LEDGER = "seen BIGINT, late BIGINT, watermark TIMESTAMP, newest_ts TIMESTAMP, batch_id BIGINT"
_ORDER = [c.split()[0] for c in ARRIVED_ORDER.split(", ")]


@dataclass(frozen=True)
class SplitHours:
    """Hours of the rows in time, late rows, and the ledger, below a root folder."""

    root: str

    def hours(self) -> Levels:
        return Levels(f"{self.root}/hours", HOUR_RUN, merge_hour_items, "hour_start", void_key="hour_start")

    def ledger(self, spark: SparkSession) -> DataFrame:
        return ensure_table(spark, f"{self.root}/ledger", LEDGER)

    def late(self, spark: SparkSession) -> DataFrame:
        """The late rows, under the batch that brought them."""
        return ensure_table(spark, f"{self.root}/late", ARRIVED_ORDER + ", batch_id BIGINT")

    def complete(self, spark: SparkSession) -> DataFrame:
        """The hours with the late rows in them."""
        return merge_hour_items(self.hours().current(spark), hour_items(self.late(spark)))

    def _before(self, spark: SparkSession, batch_id: int):
        """The ledger's row of the batch before; its folder is read directly where there is no gap."""
        try:
            return read_batch(spark, f"{self.root}/ledger", LEDGER, batch_id - 1).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        return self.ledger(spark).where(F.col("batch_id") < batch_id).orderBy(F.desc("batch_id")).first()

    def add(self, orders: DataFrame, batch_id: int, delay: str) -> None:
        """Splits a batch. A row without a time is in time. The ledger comes last; a repeated batch writes the same."""
        spark = orders.sparkSession
        before = self._before(spark, batch_id)
        newest = F.lit(before.newest_ts if before else None).cast("timestamp")
        watermark = newest - F.expr(f"interval {delay}")
        is_late = F.coalesce(F.col("ts") < watermark, F.lit(False))
        together(
            spark,
            lambda: write_batch(orders.where(is_late).select(*_ORDER), f"{self.root}/late", batch_id),
            lambda: self.hours().add(hour_items(orders.where(~is_late)), batch_id),
        )
        counts = orders.agg(
            F.count("*").alias("seen"),
            F.count_if(is_late).alias("late"),
            F.first(watermark).alias("watermark"),
            F.greatest(F.max("ts"), F.first(newest)).alias("newest_ts"),
        )
        # An empty batch has no row to take the watermark from.
        counts = counts.withColumns({"watermark": F.coalesce("watermark", watermark), "newest_ts": F.coalesce("newest_ts", newest)})
        write_batch(counts, f"{self.root}/ledger", batch_id)


def start_split_hours(
    orders: DataFrame, into: SplitHours, checkpoint: str, delay: str = "1 hour", every: str | None = None
) -> StreamingQuery:
    """Hours of a stream of orders, with late rows in a table of their own."""
    return start(orders, lambda batch, batch_id: into.add(batch, batch_id, delay), checkpoint, every)


class DroppedRows(StreamingQueryListener):
    """Keeps the number of rows that the state of each query has dropped as late, in a file per query.

    `recentProgress` forgets all but the newest updates; the files outlive the query and its session,
    and a query that goes on from its checkpoint goes on in its file. Spark counts what its state
    sees: rows of one group may have been added up before. An update that Spark could not deliver
    before it was ended is missing; `SplitHours` is exact.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def path(self, query_id) -> str:
        return f"{self.root}/{query_id}.json"

    def total(self, query_id) -> int:
        text = get_text(self.spark, self.path(query_id))
        return json.loads(text)["dropped"] if text else 0

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        text = get_text(self.spark, self.path(progress.id))
        last = json.loads(text) if text else {"batch": -1, "dropped": 0}
        if progress.batchId <= last["batch"]:
            return
        dropped = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        put_text(self.spark, self.path(progress.id), json.dumps({"batch": progress.batchId, "dropped": last["dropped"] + dropped}))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
