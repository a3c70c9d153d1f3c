"""How many rows go to Python at once, and the chunks' keys that meet range by range."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa

from orderstream.llm import common, language, weighting


def test_stored_rows_go_to_python_in_small_batches(spark, tmp_path):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    before = spark.conf.get(common.ARROW_ROWS, None)
    rows = spark.range(0, 5000, 1, 1)
    for at_once in (7, common.AT_ONCE):
        found = common.stored(rows.mapInArrow(sizes, "n long"), f"{tmp_path}/{at_once}", at_once=at_once)
        assert [r.n for r in found.collect() if r.n] == [*[at_once] * (5000 // at_once), 5000 % at_once]
    assert spark.conf.get(common.ARROW_ROWS, None) == before


def test_language_takes_few_texts_at_once(spark):
    before = spark.conf.get(common.ARROW_ROWS, None)
    try:
        spark.conf.set(common.ARROW_ROWS, 10_000)
        language.predicted(spark.createDataFrame([(1, "a")], "doc_id long, text string"), {}, ["doc_id"])
        assert int(spark.conf.get(common.ARROW_ROWS)) <= common.AT_ONCE
    finally:
        spark.conf.unset(common.ARROW_ROWS) if before is None else spark.conf.set(common.ARROW_ROWS, before)


def test_blocks_meet_range_by_range(monkeypatch):
    monkeypatch.setattr(weighting, "SLICE", 16)
    rng, want, blocks, largest = np.random.default_rng(5), Counter(), [], []
    for n in (0, 1, 300, 40, 300):
        key = np.unique(rng.integers(0, 2**56, n) >> rng.integers(0, 40, n))
        count = rng.integers(0, 9, len(key)).astype(np.int32)
        for k, c in zip(key.tolist(), count.tolist(), strict=True):
            want[k] += c
        blocks.append((key, count))
    kept, join = list(blocks), weighting.joined
    monkeypatch.setattr(weighting, "joined", lambda parts: largest.append(sum(len(k) for k, _ in parts)) or join(parts))
    key, count = weighting.summed(blocks)
    assert not blocks
    assert key.tolist() == sorted({int(k) for part, _ in kept for k in part})
    assert [want[k] for k in key.tolist()] == count.tolist()
    assert len(largest) > 10
    places = [(b, i) for b, within in weighting.by_bucket(key, 64) for x in within for i in range(x.start, x.stop)]
    order = np.argsort(weighting.bucket_of(key, 64), kind="stable")
    assert [i for _, i in places] == order.tolist()
    assert [b for b, _ in places] == weighting.bucket_of(key, 64)[order].tolist()
