"""The filters of the id index: the same bits as Spark's bitmap aggregate, without a sort of eight rows an id."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderstream.sinks import idindex
from orderstream.sinks.idindex import SEGMENT_BITS, IdIndex


def _bits(rows) -> dict:
    return {(r.bucket, r.segment): bytes(r.bits) for r in rows.collect()}


def test_bits_of_sparse_dense_and_repeated_positions(spark):
    last = SEGMENT_BITS - 1
    rows = [(0, 0, p) for p in (0, 0, 7, 8, 63, 64, last)]
    rows += [(0, 1, last), (1, 0, 0), (1, 1, 130), (15, 7, 56), (15, 7, 63)]
    rows += [(2, 3, p) for p in range(SEGMENT_BITS)] + [(3, 0, p * 7919 % SEGMENT_BITS) for p in range(5000)]
    bits = spark.createDataFrame(rows, "bucket int, segment int, position long").repartition(3)
    found = _bits(idindex.filters_of(bits))
    assert found == _bits(bits.groupBy("bucket", "segment").agg(F.bitmap_construct_agg("position").alias("bits")))
    assert {len(b) for b in found.values()} == {SEGMENT_BITS // 8}


def test_an_index_is_written_without_sorting_its_positions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idindex.F, "bitmap_construct_agg", lambda c: (_ for _ in ()).throw(AssertionError("sorts its rows")))
    ids = IdIndex.at(f"{tmp_path}/ids", buckets=4)
    orders = spark.range(3000).select(F.concat(F.lit("m"), "id").alias("message_id"))
    ids.add_ids(orders, 0)
    batch = spark.createDataFrame([("m17",), ("m2999",), ("m3000",), (None,)], "message_id string")
    assert sorted(r.message_id for r in ids.known(batch, 1).collect()) == ["m17", "m2999"]

    some = spark.range(10).select(F.lit(0).alias("bucket"), F.lit(0).alias("segment"), F.col("id").alias("position"))
    plan = idindex.filters_of(some)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and " HashAggregate" in plan
