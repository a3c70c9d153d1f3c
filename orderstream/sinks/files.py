"""Small text files beside the tables, through the file system of their path."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file beside its place and moves it there, so readers see all of it or nothing."""
    jvm, there, fs = _at(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(there.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, there):  # what is there already comes from an earlier attempt
        fs.delete(there, False)
        if not fs.rename(part, there):
            raise OSError(f"{path} could not be written")


def get_text(spark: SparkSession, path: str) -> str | None:
    jvm, there, fs = _at(spark, path)
    if not fs.exists(there):
        return None
    stream = fs.open(there)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder but the hidden ones; none if there is no such folder."""
    _, there, fs = _at(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(there)] if fs.exists(there) else []
    return sorted(n for n in found if not n.startswith(("_", ".")))


def remove(spark: SparkSession, path: str) -> None:
    _, there, fs = _at(spark, path)
    fs.delete(there, True)
