"""The files of the faulty stream: parts in several files, taken one part at a time."""

from __future__ import annotations

from collections import Counter
from glob import glob
from pathlib import Path

from pyspark.sql import functions as F

from orderstream.sources import bindings as b
from orderstream.sources.streams import folder_stream

RECORD = "arrival BIGINT, value STRING, ingest_ts TIMESTAMP"


def _events(spark, tmp_path, ids) -> str:
    rows = spark.createDataFrame([(i,) for i in ids], "event_id BIGINT").select(
        "event_id",
        F.timestamp_seconds(F.coalesce("event_id", F.lit(0)) + 1_700_000_000).alias("ts"),
        F.lit(1).cast("bigint").alias("user_id"),
        F.lit("click").alias("event_type"),
        F.lit(2.5).alias("value"),
        F.lit("{}").alias("props"),
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def _brought(ids, parts=4):
    """(part, arrival) by hand; Spark's remainder keeps the sign."""
    rest = lambda i: None if i is None else abs(i) % parts * (1 if i >= 0 else -1)
    out = Counter()
    for i in ids:
        out[rest(i), i] += 1
        if i is not None and i % 5 == 2 and i >= 0:
            out[rest(i), i] += 1
            out[rest(i + 1), i] += 1
    return out


def test_a_part_is_several_files_of_bounded_rows_and_one_batch(spark, tmp_path):
    ids = [*range(400), *[8] * 40]
    pattern, files = b.redelivered_files(spark, _events(spark, tmp_path, ids), f"{tmp_path}/feed", file_rows=50)
    assert files == 4
    sizes = {f: spark.read.parquet(f).count() for folder in glob(pattern) for f in map(str, Path(folder).glob("*.parquet"))}
    assert len(sizes) == 4 * files
    assert max(sizes.values()) <= 60

    seen = Counter()

    def keep(batch, batch_id):
        seen.update((batch_id, r.arrival) for r in batch.select("arrival").collect())

    stream = folder_stream(spark, pattern, RECORD, files_per_batch=files)
    started = stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(keep).trigger(availableNow=True)
    started.start().awaitTermination()
    assert seen == _brought(ids)


def test_parts_of_missing_negative_and_single_ids(spark, tmp_path):
    ids = [None, None, -3, 2, 2, 7]
    pattern, files = b.redelivered_files(spark, _events(spark, tmp_path, ids), f"{tmp_path}/feed")
    assert files == 1
    found = Counter((Path(folder).name, r.arrival) for folder in glob(pattern) for r in spark.read.parquet(folder).collect())
    assert found == Counter({(f"part={p}", i): n for (p, i), n in _brought(ids).items()})


def test_rows_are_dealt_in_the_order_they_come(spark, tmp_path):
    """No task sorts its rows to deal them out: each file has every n-th row of a part, in the order of the table."""
    pattern, files = b.redelivered_files(spark, _events(spark, tmp_path, range(400)), f"{tmp_path}/feed", file_rows=50)
    assert files > 1
    for folder in glob(pattern):
        rows = [[r.arrival for r in spark.read.parquet(str(f)).collect()] for f in Path(folder).glob("*.parquet")]
        assert all(x == sorted(x) for x in rows)
        assert max(map(len, rows)) - min(map(len, rows)) <= 1
