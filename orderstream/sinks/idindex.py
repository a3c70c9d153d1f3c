"""Index of the message ids an order table has, for checking a batch without reading them all.

Ids lie in hash buckets, in runs that merge in levels, so a table of n batches has about log(n) runs.
Every run has a Bloom filter per bucket, in segments of a fixed number of bits that are dealt out by
another hash, about 16 bits an id. A batch first meets the filters, a 1/20 of the ids' size and less;
of the ids it opens only the buckets in which a filter says that one of its ids may be. What a filter
says is then checked against the ids themselves, so the answer is exact, and it reaches back to the
first batch.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderstream.sinks.files import names_in
from orderstream.sinks.levels import Levels, Run, union_all, with_info

STORED_ID = "message_id STRING, batch_id BIGINT"
FILTER = "bucket INT, segment INT, bits BINARY"

# Bits of a segment, in words of 64.
SEGMENT_BITS = 32_768
IDS_PER_SEGMENT = 2_000
PROBES = 8
# The bits of an id's hash below these choose its bucket, those above its segment.
BUCKET_HASH_BITS = 20


def _positions(message_id: Column) -> Column:
    """The bits of an id in its segment."""
    first, step = (F.pmod(F.xxhash64(message_id, F.lit(i)), F.lit(SEGMENT_BITS)) for i in (1, 2))
    return F.array(*[(first + i * (step.bitwiseOR(1))) % SEGMENT_BITS for i in range(PROBES)])


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, position.bitwiseAND(7).cast("int")) == 1


def filters_of(bits: DataFrame) -> DataFrame:
    """The segments (bucket, segment, bits) with the bits of all rows (bucket, segment, position) set.

    What `bitmap_construct_agg` gives, which sorts its rows, eight an id. Here a task's hash map has a word of 64 bits at
    most once, a quarter of an entry an id, and only words meet and are put together.
    """
    # A word is written as hexadecimal digits, so its first byte is the highest.
    mask = F.expr("bit_or(shiftleft(1L, cast(56 - (position & 56) + (position & 7) as int)))")
    words = bits.groupBy("bucket", "segment", F.shiftright("position", 6).cast("int").alias("word")).agg(mask.alias("mask"))
    listed = words.groupBy("bucket", "segment").agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("words"))

    def digits(x: Column, i: Column) -> Column:
        missing = x["word"] - F.coalesce(F.get("words", i - 1)["word"], F.lit(-1)) - 1
        return F.concat(F.repeat(F.lit("0" * 16), missing), F.lpad(F.hex(x["mask"]), 16, "0"))

    text = F.rpad(F.concat_ws("", F.transform("words", digits)), SEGMENT_BITS // 4, "0")
    return listed.select("bucket", "segment", F.unhex(text).alias("bits"))


@dataclass(frozen=True)
class IdIndex(Levels):
    """The index below a folder. `buckets`: a power of two, the same for the life of the index."""

    buckets: int = 16

    @classmethod
    def at(cls, root: str, buckets: int = 16, fanout: int = 4, keep: int = 8) -> IdIndex:
        return cls(root, STORED_ID, lambda rows: rows, "message_id", fanout=fanout, keep=keep, buckets=buckets)

    def _bucket(self, message_id: Column) -> Column:
        return F.pmod(F.xxhash64(message_id), F.lit(self.buckets)).cast("int")

    def _segment(self, message_id: Column, segments: Column) -> Column:
        return F.pmod(F.shiftright(F.xxhash64(message_id), BUCKET_HASH_BITS), segments).cast("int")

    # Writing

    def write(self, rows: DataFrame, run: Run) -> Run:
        spark, folder = rows.sparkSession, f"{self.root}/runs/{run.name}"
        placed = rows.select("message_id", "batch_id", self._bucket(F.col("message_id")).alias("bucket"))
        placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/ids")
        if not names_in(spark, f"{folder}/ids"):
            return with_info(run, rows=0, segments=1)
        stored = self.rows_of(spark, [run])
        count = stored.count()
        segments = 1
        while segments * self.buckets * IDS_PER_SEGMENT < count:
            segments *= 2
        bits = stored.select(
            self._bucket(F.col("message_id")).alias("bucket"),
            self._segment(F.col("message_id"), F.lit(segments)).alias("segment"),
            F.explode(_positions(F.col("message_id"))).alias("position"),
        )
        filters_of(bits).sortWithinPartitions("bucket", "segment").write.mode("overwrite").parquet(f"{folder}/filters")
        return with_info(run, rows=count, segments=segments)

    def rows_of(self, spark: SparkSession, runs: list[Run]) -> DataFrame:
        filled = [r for r in runs if r.info.get("rows", 1)]
        if not filled:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.root}/runs/{r.name}/ids/bucket=*" for r in filled])

    def add_ids(self, orders: DataFrame, batch_id: int) -> None:
        """Adds the ids of a batch's inserted orders; orders without one have no place here."""
        ids = orders.where(F.col("message_id").isNotNull()).select("message_id", F.lit(batch_id).cast("bigint").alias("batch_id"))
        self.add(ids, batch_id)

    def build(self, orders: DataFrame, batch_id: int) -> None:
        """Indexes an order table that has no index yet, as of the batch before the given one."""
        earlier = orders.where((F.col("batch_id") < batch_id) & F.col("message_id").isNotNull())
        if not earlier.isEmpty():
            self.add(earlier.select("message_id", "batch_id"), batch_id - 1)

    # Checking

    def buckets_to_open(self, wanted: DataFrame, before: int) -> list[str]:
        """The folders in which one of the ids (message_id) may be: at most one per live run and bucket."""
        spark = wanted.sparkSession
        last = self.manifest(spark, before=before)
        runs = [r for r in last.runs if r.info["rows"]] if last else []
        if not runs:
            return []
        filters = union_all(
            [spark.read.schema(FILTER).parquet(f"{self.root}/runs/{r.name}/filters").withColumn("run", F.lit(i)) for i, r in enumerate(runs)]
        )
        live = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(r.info["segments"]).alias("segments")) for i, r in enumerate(runs)])
        probes = wanted.select("message_id", F.explode(live).alias("live")).select(
            F.col("live.run").alias("run"),
            self._bucket(F.col("message_id")).alias("bucket"),
            self._segment(F.col("message_id"), F.col("live.segments")).alias("segment"),
            _positions(F.col("message_id")).alias("positions"),
        )
        # Bit by bit, so that most unknown ids are done with after one or two.
        all_set = reduce(and_, [_is_set(F.col("bits"), F.col("positions")[i]) for i in range(PROBES)])
        met = probes.join(filters, ["run", "bucket", "segment"]).where(all_set)
        found = met.select("run", "bucket").distinct().collect()
        return sorted(f"{self.root}/runs/{runs[r.run].name}/ids/bucket={r.bucket}" for r in found)

    def known(self, batch: DataFrame, before: int) -> DataFrame:
        """The ids of the batch (message_id) that an earlier batch stored."""
        spark = batch.sparkSession
        wanted = batch.where(F.col("message_id").isNotNull()).select("message_id").distinct()
        paths = self.buckets_to_open(wanted, before)
        if not paths:
            return spark.createDataFrame([], "message_id STRING")
        opened = spark.read.schema(self.schema).parquet(*paths).where(F.col("batch_id") < before)
        return opened.select("message_id").join(wanted, "message_id", "left_semi")
