"""Periodic dashboard refresh next to a running ingest."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from orderstream.functions.times import AsOf
from orderstream.plans.dashboard import as_json, dashboard
from orderstream.plans.refresh import Documents
from orderstream.sinks.versions import read_version, write_version
from orderstream.streaming.changes import send_changes
from orderstream.streaming.common import start


def start_dashboard(
    trigger_stream: DataFrame,
    documents: Callable[[AsOf], Documents],
    clock: Callable[[], datetime],
    root: str,
    checkpoint: str,
    every: str | None = "10 seconds",
    keep: int = 3,
    changes_root: str | None = None,
) -> StreamingQuery:
    """Stores a version of the dashboard document per batch of `trigger_stream`, as JSON text.

    The stream only says when: `documents` reads the stored tables as of the moment `clock` gives.
    A version has its batch's number; `stored_dashboard` reads the newest whole one, and `keep` of
    them stay. With `changes_root` the parts that differ from the refresh before are stored there.
    """

    def on_batch(_: DataFrame, batch_id: int) -> None:
        now = clock()
        found = documents(now)
        write_version(as_json(dashboard(found, now)), root, batch_id, keep)
        if changes_root is not None:
            send_changes(found, changes_root, batch_id)

    return start(trigger_stream, on_batch, checkpoint, every)


def stored_dashboard(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The stored document as one row of JSON text: the newest, or a pinned version."""
    return read_version(spark, root, "json STRING", version)
