"""A stored numbering of the partitions of several topics.

A position must stay the same for a record however often it is read, and differ from that of every
other record. So each (topic, partition) gets a place when a record of it is first seen, and keeps
it: places are only appended. The table has one row per partition of the source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderstream.sources.streams import PLACES, position
from orderstream.sources.tables import ensure_table

PLACE = "topic STRING, partition INT, place BIGINT"


@dataclass(frozen=True)
class Topics:
    """The registry below a folder, for the named topics; records of any other fail the batch."""

    root: str
    names: tuple[str, ...]

    def places(self, spark: SparkSession) -> dict[tuple[str, int], int]:
        table = ensure_table(spark, self.root, PLACE).select("topic", "partition", "place")
        return {(r.topic, r.partition): r.place for r in table.collect()}  # one row per partition of the source

    def extend(self, records: DataFrame) -> dict[tuple[str, int], int]:
        """The places of all partitions seen so far, after numbering those the records bring for the first time.

        An extension is one folder, named after the first place it gives away: of two that start from
        the same state the second fails.
        """
        spark = records.sparkSession
        known = self.places(spark)
        seen = {(r.topic, r.partition) for r in records.select("topic", "partition").distinct().collect()}
        strange = sorted({str(t) for t, p in seen if t not in self.names or p is None or p < 0})
        if strange:
            raise ValueError(f"records of topics that are not registered, or without a partition: {', '.join(strange)}")
        new = sorted(seen - known.keys())
        if not new:
            return known
        given = {pair: len(known) + i for i, pair in enumerate(new)}
        if len(known) + len(new) > PLACES:
            raise ValueError(f"more than {PLACES} partitions")
        rows = spark.createDataFrame([(t, p, n) for (t, p), n in given.items()], PLACE)
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/from={len(known)}")
        return known | given

    def text(self, records: DataFrame) -> DataFrame:
        """`arrival, value, ingest_ts` from a batch of Kafka-shaped records of these topics."""
        places = self.extend(records)
        table = records.sparkSession.createDataFrame([(t, p, n) for (t, p), n in places.items()], PLACE)
        return records.join(table, ["topic", "partition"]).select(
            position(F.col("offset"), F.col("place")).alias("arrival"),
            F.col("value").cast("string").alias("value"),
            F.col("timestamp").alias("ingest_ts"),
        )
