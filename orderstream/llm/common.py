"""What several text operators share: reading, words, the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What ends a word.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
# Rows in a batch for Python: texts, signatures and shingle sets are some KB each.
AT_ONCE = 1024


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the session names in spark.checkpoint.dir, which all executors reach.

    Only a local-mode session without that setting (tests) falls back to a temporary folder; a cluster is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="llm-")
    return f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, at_once: int = AT_ONCE) -> DataFrame:
    """Writes the rows below the shared folder and reads them back: lineage ends, lost executors cost nothing.

    at_once: rows that go to Python in one batch, which the JVM, the worker and the pipe between them each hold whole.
    """
    with batches_of(df.sparkSession, at_once):
        df.write.mode("errorifexists").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def few_at_once(spark: SparkSession, rows: int = AT_ONCE) -> str | None:
    """From now on rows go to Python in batches of at most so many; a session's smaller number holds. Returns the one before."""
    before = spark.conf.get(ARROW_ROWS, None)
    if before is None or not 0 < int(before) <= rows:
        spark.conf.set(ARROW_ROWS, rows)
    return before


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """The same for what is written meanwhile."""
    before = few_at_once(spark, rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ARROW_ROWS)
        else:
            spark.conf.set(ARROW_ROWS, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many: fewer texts are held as Python objects at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def spare(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lowered(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")
