"""Connected components of a distributed edge list: alternating large and small stars.

Every pass points nodes at the smallest neighbour they know; passes end when every node points at its component's
smallest node. Edges stay in Spark tables; a pass is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderstream.llm.common import shared_dir, stored


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.join(low, both["u"] == low["k"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    moved = edges.join(low, edges["u"] == low["k"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of links (a, b); component: the smallest node it reaches."""
    folder = shared_dir(links.sparkSession, name)
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = stored(edges, f"{folder}/0"), None
    check = (F.count("*"), F.bit_xor(F.xxhash64("u", "v")))
    for step in range(1, 1000):
        now = tuple(edges.agg(*check).first())
        if now == before or not now[0]:
            break
        before = now
        edges = stored(_small(_large(edges)), f"{folder}/{step}")
    low = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return low.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
