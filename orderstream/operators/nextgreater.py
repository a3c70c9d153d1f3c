"""For every value of a long series, the first later one that is greater.

The series is cut into sorted ranges of time. Inside a range a stack of the values still waiting
finds the answer in one pass. A value that waits beyond its range looks for the first later range
with a greater maximum, of which there is one per range, and takes its answer from that range's
records: the values greater than all before them in the range. No list of candidates is built, and
the distance to the answer does not matter.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "range int, at bigint, value bigint, following bigint, greater bigint, record boolean"
# A range whose records many others wait for is looked up in so many tasks.
SALTS = 8


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range: its partition."""
    found = [b for b in batches if len(b)]
    if not found:
        return
    at, value = (np.concatenate([b.column(c).to_numpy() for b in found]) for c in ("at", "value"))
    greater, waiting = np.full(len(at), -1, np.int64), []
    for i, v in enumerate(value.tolist()):
        while waiting and value[waiting[-1]] < v:
            greater[waiting.pop()] = i
        waiting.append(i)
    none = greater < 0
    best = np.maximum.accumulate(value)
    record = np.concatenate([[True], value[1:] > best[:-1]])
    following = np.append(at[1:], 0)
    last = np.arange(len(at)) == len(at) - 1
    columns = [
        pa.array(np.full(len(at), TaskContext.get().partitionId(), np.int32)), pa.array(at), pa.array(value),
        pa.array(following, mask=last), pa.array(at[greater], mask=none), pa.array(record),
    ]
    yield pa.RecordBatch.from_arrays(columns, ["range", "at", "value", "following", "greater", "record"])


def _completed(ranges: list, maxima: list, firsts: list):
    """Adds what only other ranges know: the row after a range's last one, and the range that has a value's answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, most = {r: i for i, r in enumerate(ranges)}, np.array(maxima, np.int64)
        for batch in batches:
            own, value = batch.column("range").to_pylist(), batch.column("value").to_pylist()
            following, greater = batch.column("following").to_pylist(), batch.column("greater").to_pylist()
            target: list[int | None] = [None] * len(own)
            for i, r in enumerate(own):
                after = place[r] + 1
                if following[i] is None and after < len(ranges):
                    following[i] = firsts[after]
                if greater[i] is None and after < len(ranges):
                    above = most[after:] > value[i]
                    if above.any():
                        target[i] = ranges[after + int(above.argmax())]
            columns = [*(batch.column(c) for c in ("range", "at", "value")), pa.array(following, pa.int64()), batch.column("greater")]
            columns += [batch.column("record"), pa.array(target, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["range", "at", "value", "following", "greater", "record", "target"])

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range and salt the records come first, by rising value; a waiting value takes the first above it."""
    now, at, value = None, [], []
    names = ("target", "salt", "record", "at", "value", "following")
    for batch in batches:
        out = []
        for target, salt, record, t, v, following in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if (target, salt) != now:
                now, at, value = (target, salt), [], []
            if record:
                at.append(t)
                value.append(v)
            else:
                out.append((t, v, following, at[bisect_right(value, v)]))
        columns = zip(*out, strict=True) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["at", "value", "following", "greater"])


def _stored(df: DataFrame, folder: str) -> DataFrame:
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def next_greater(series: DataFrame, folder: str) -> DataFrame:
    """(at, value, following, greater) of a series (at, value) of longs.

    `following` is the time of the next row, `greater` that of the first later row with a greater
    value; null where there is none. Of rows at the same time the greatest value comes last. The folder
    keeps the ranges for as long as the result is read.
    """
    sorted_ = series.select("at", "value").repartitionByRange("at").sortWithinPartitions("at", "value")
    ranged = _stored(sorted_.mapInArrow(_within, ROW), f"{folder}/ranges")
    # One row per range, and there are at most as many as a shuffle has partitions.
    found = ranged.groupBy("range").agg(F.max("value").alias("most"), F.min("at").alias("first")).orderBy("range").collect()
    step = _completed([r.range for r in found], [r.most for r in found], [r.first for r in found])
    whole = _stored(ranged.mapInArrow(step, ROW + ", target int"), f"{folder}/completed")
    waits = F.col("greater").isNull() & F.col("target").isNotNull()
    salt = F.pmod(F.xxhash64("at", "value"), F.lit(SALTS)).cast("int")
    waiting = whole.where(waits).select("target", salt.alias("salt"), F.lit(False).alias("record"), "at", "value", "following")
    asked = waiting.select(F.col("target").alias("range")).distinct()
    records = whole.where("record").join(asked, "range", "left_semi").select(
        F.col("range").alias("target"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "record", "at", "value", "following"
    )
    both = records.unionByName(waiting).repartition("target", "salt").sortWithinPartitions("target", "salt", F.desc("record"), "at")
    answered = both.mapInArrow(_looked_up, "at bigint, value bigint, following bigint, greater bigint")
    return whole.where(~waits).select("at", "value", "following", "greater").unionByName(answered)
