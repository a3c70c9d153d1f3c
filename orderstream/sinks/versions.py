"""Documents kept as versions, of which readers pin one.

A version is a folder of its own. A pointer beside the folders names the newest whole one; it moves
only after the version is written, in one step, and never back. A reader looks at the pointer once
and then reads that version, whatever is written meanwhile. Of older versions the last few stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderstream.sinks.files import get_text, names_in, put_text, remove

POINTER = "_newest"


def newest_version(spark: SparkSession, root: str) -> int | None:
    text = get_text(spark, f"{root}/{POINTER}")
    return None if text is None else int(text)


def write_version(df: DataFrame, root: str, version: int, keep: int = 3) -> None:
    """Writes a bounded document as one file and points to it; versions beyond the newest `keep` go.

    Writing a version again replaces it with the same rows. An older one than the newest is written,
    but not pointed to.
    """
    spark = df.sparkSession
    df.coalesce(1).write.mode("overwrite").parquet(f"{root}/version={version}")
    newest = newest_version(spark, root)
    if newest is None or version > newest:
        put_text(spark, f"{root}/{POINTER}", str(version))
        newest = version
    # What is beyond the newest is about to be pointed to. A half-written one counts for none of those kept.
    known = sorted((v for v in (int(n.partition("=")[2]) for n in names_in(spark, root)) if v <= newest), reverse=True)
    whole = [v for v in known if get_text(spark, f"{root}/version={v}/_SUCCESS") is not None]
    for old in known:
        if whole[keep:] and old <= whole[keep]:
            remove(spark, f"{root}/version={old}")


def read_version(spark: SparkSession, root: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of one version: a pinned one, or the newest; none if there is no whole version yet."""
    version = newest_version(spark, root) if version is None else version
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/version={version}")
