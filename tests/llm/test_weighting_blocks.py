"""Words and answers in blocks: what op8 shuffles is packed, and a chunk reads its answers one by one."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orderstream.llm import weighting as w


def _chunk_rows(rows, room):
    """(doc_id, held_out, text) rows as chunks, without a session."""
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.bool_(), pa.string()], strict=True)]
    return list(w.chunked(iter([pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "text"])]), room))


@pytest.fixture
def one_task(monkeypatch):
    class Context:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 0)

    monkeypatch.setattr(w, "TaskContext", Context)


def test_neither_words_nor_answers_are_single_rows(spark, monkeypatch):
    """Words used to be exploded, joined and collected again, the answers collected and joined to the chunks."""
    plans, write = [], w.stored

    def noted(df, folder, **more):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, folder, **more)

    monkeypatch.setattr(w, "stored", noted)
    docs = spark.createDataFrame([(i, f"red blue w{i} red") for i in range(20)], "doc_id long, text string")
    out = w.score(docs, F.col("doc_id") % 5 == 0, chunk=64).collect()
    assert len(plans) > 3
    for plan in plans:
        assert not any(x in plan for x in ("Generate", "Join", "collect_list")), plan
    # 16 texts train with 5 tokens each, the end counted in; a text's own word is known if it trains.
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in out} == {(5, 5, 80), (5, 4, 80)}
    assert {r.doc_id for r in out if r.n_known == 4} == {0, 5, 10, 15}


def test_counts_of_words_over_all_chunks(one_task):
    texts = ["a b a", "", None, "b c éé", "a", "d " * 40, "held only", "c"]
    rows = [(i, i == 6, t) for i, t in enumerate(texts)]
    want = Counter(x for _, held, t in rows if not held for x in [*w.words_of(t), w.END])
    for room in (4, 1000):
        chunks = _chunk_rows(rows, room)
        blocks = [dict(zip(b.schema.names, x, strict=True)) for b in w.told(5)(iter(chunks)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        blocks.sort(key=lambda x: x["bucket"])
        packed = pa.RecordBatch.from_pylist(blocks, pa.schema(list(zip(["bucket", "chunk", "words", "counts"], w.BLOCK_TYPES, strict=True))))
        found = [x for b in w.counted(iter([packed])) for x in b.to_pylist()]
        answers = {(x["chunk"], x["bucket"]): w.unpacked(x["counts"], "<i8").tolist() for x in found if x["chunk"] is not None}
        for batch in chunks:
            words = w.unpacked_words(batch.column("vocabulary")[0].as_py())
            for bucket, at in w.words_by_bucket(words, 5):
                assert answers.pop((batch.column("chunk")[0].as_py(), bucket)) == [want[words[i]] for i in at]
        assert not answers
        assert sum(x["total"] or 0 for x in found) == sum(want.values())
        assert sum(x["known"] or 0 for x in found) == sum(n > 0 for n in want.values())


def test_keys_are_the_bytes_before(one_task):
    rows = [(0, False, "one two one"), (1, True, None), (2, False, "x" * 50 + " y"), (3, False, "é " * 9)]
    want = []
    for i, (_, _, text) in enumerate(rows):
        stream = w.START + b"".join(x + w.CLOSE for x in w.words_of(text)) + w.STOP
        for p in range(w.DEPTH, len(stream)):
            before = stream[p - w.DEPTH : p][::-1]
            want.append((int.from_bytes(before + stream[p : p + 1], "big"), i))
    (batch,) = _chunk_rows(rows, 10_000)
    for piece in (1, 3, 16, 10_000):
        parts = list(w.Chunk(batch, 0).keys(piece))
        found = np.concatenate([k for k, _ in parts]).tolist(), np.concatenate([d for _, d in parts]).tolist()
        assert list(zip(*found, strict=True)) == want
