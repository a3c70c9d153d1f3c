"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# What a cluster session should run with. Sizes are targets per task, not tuned to a data set:
# AQE picks the number of reducers from the advisory size, splits skewed join partitions and
# turns a shuffle join into a broadcast join only once the real size of a side is known.
CLUSTER_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def use_utc(spark: SparkSession) -> SparkSession:
    """Hours and days are UTC everywhere; a plan fixes its zone when it is analysed."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run, below the shared folder the cluster names.

    Only a local-mode session without that setting falls back to a temporary folder: on a
    cluster such a folder would exist on one machine only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="orderstream-")
    return f"{root.rstrip('/')}/orderstream/{name}-{uuid.uuid4().hex[:12]}"
