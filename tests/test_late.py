"""Late rows: the split stream with its ledger, and the durable count of dropped rows."""

import random
import time
from types import SimpleNamespace

import pytest
from conftest import ORDER_ROW, rows_of, utc
from pyspark.sql import functions as F
from test_streaming import HOURS, order_files, run

from orderstream.operators import metrics
from orderstream.streaming import job
from orderstream.streaming import late as late_module
from orderstream.streaming.dedup import deduplicated
from orderstream.streaming.late import DroppedRows, SplitHours, start_split_hours


def batches(seed, n):
    rng = random.Random(seed)
    return [[(f"{i}-{k}", f"2025-12-{9 + rng.randrange(3):02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00") for k in range(6)] for i in range(n)]


def truth(files, delay_hours):
    newest, late = None, []
    for n, rows in enumerate(files):
        if newest is not None:
            late += [(n, m) for m, t in rows if (newest - utc(t)).total_seconds() > delay_hours * 3600]
        newest = max([utc(t) for _, t in rows] + ([newest] if newest else []))
    return late


def test_late_rows_are_split_off_over_restarts(spark, tmp_path):
    """Every start sees two more files; one batch is ended before its ledger and repeated."""
    files, into, folder = batches(1, 6), SplitHours(str(tmp_path / "out")), str(tmp_path / "in")
    for at in range(0, 6, 2):
        for n in (at, at + 1):
            rows = [(n * 100 + i, n * 100 + i, m, "latte", "uptown", None, utc(t), "v3") for i, (m, t) in enumerate(files[n])]
            spark.createDataFrame(rows, ORDER_ROW).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(ORDER_ROW).option("maxFilesPerTrigger", 1).parquet(folder)
        if at == 2:
            with pytest.MonkeyPatch.context() as m:
                m.setattr(late_module, "write_batch", lambda *a: (_ for _ in ()).throw(RuntimeError("ended")))
                with pytest.raises(Exception, match="ended"):
                    run(start_split_hours(stream, into, str(tmp_path / "cp"), "20 hours"))
        run(start_split_hours(stream, into, str(tmp_path / "cp"), "20 hours"))
    late = truth(files, 20)
    assert late and rows_of(into.late(spark), "batch_id", "message_id") == sorted(late, key=str)
    counts = {r.batch_id: (r.seen, r.late) for r in into.ledger(spark).collect()}
    assert counts == {n: (6, sum(k == n for k, _ in late)) for n in range(6)}
    everything = spark.read.schema(ORDER_ROW).parquet(folder)
    assert rows_of(into.complete(spark), *HOURS) == rows_of(metrics.hour_items(everything), *HOURS)
    gone = [m for _, m in late]
    in_time = metrics.hour_items(everything.where(~F.col("message_id").isin(gone)))
    assert rows_of(into.hours().current(spark), *HOURS) == rows_of(in_time, *HOURS)


def test_empty_batches_and_rows_without_a_time(spark, tmp_path):
    into = SplitHours(str(tmp_path / "out"))
    rows = lambda *ts: spark.createDataFrame([(i, i, f"m{i}", "latte", "uptown", None, t and utc(t), "v3") for i, t in enumerate(ts)], ORDER_ROW)
    for n, batch in enumerate((rows(), rows("2025-12-09 10:00:00", None), rows(), rows(None), rows("2025-12-09 08:00:00", "2025-12-09 09:30:00"))):
        into.add(batch, n, "1 hour")
    assert rows_of(into.ledger(spark), "batch_id", "seen", "late") == [(0, 0, 0), (1, 2, 0), (2, 0, 0), (3, 1, 0), (4, 2, 1)]
    assert into.ledger(spark).where("batch_id = 4").first().newest_ts == into.ledger(spark).where("batch_id = 1").first().newest_ts


def test_dropped_rows_are_counted_beyond_the_progress_that_is_kept(spark, tmp_path):
    drops = DroppedRows(spark, str(tmp_path / "drops"))
    for n in [*range(500), 499, 3]:  # the last two come again
        state = [SimpleNamespace(numRowsDroppedByWatermark=n % 3), SimpleNamespace(numRowsDroppedByWatermark=1)]
        drops.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(id="q", batchId=n, stateOperators=state)))
        if n == 250:
            drops = DroppedRows(spark, str(tmp_path / "drops"))  # a new session
    assert drops.total("q") == sum(n % 3 + 1 for n in range(500)) and drops.total("other") == 0


def test_the_listener_hears_a_query(spark, tmp_path):
    stream = order_files(
        spark, str(tmp_path / "in"), [("a", "2025-12-09 10:00:00")], [("b", "2025-12-09 14:00:00")], [("c", "2025-12-09 14:30:00")], [("late", "2025-12-09 10:05:00")]
    )
    drops = DroppedRows(spark, str(tmp_path / "drops"))
    spark.streams.addListener(drops)
    try:
        query = job.start_hours(deduplicated(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
        run(query)
        for _ in range(50):
            if drops.total(query.id) == 1:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(drops)
    assert drops.total(query.id) == job.late_rows(query) == 1
