"""The corpus pipeline: five stages over documents, each on all that its predecessor kept.

Every stage is one text operator. Its result is written as Parquet below the shared folder and read again as the next
stage's documents; all stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderstream.llm import language, near, packing, private, repeats
from orderstream.llm.common import read, shared_dir, stored

ORACLE_SQL = None


def like_documents(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    chars = F.length("text").cast("long")
    return df.select(*[chars.alias(c) if c == "n_chars" else F.col(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters; those without any (or without text) are rejected, a null lang is set.

    The language model learns from the labelled documents of the stage's own input; without any, lang stays null.
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = language.predicted(docs, language.prototypes(docs), columns, letters_col="_letters")
    known = F.when(F.col("lang_pred") != language.UNDETERMINED, F.col("lang_pred"))
    return like_documents(found.filter("_letters").withColumn("lang", F.coalesce("lang", known)), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id. Shingles of five words, 0.8.

    Of a group's texts with the same smallest id the one with the smallest SHA-256 stays; an id's texts of different
    groups all stay. Repeated rows (same id, same text) are one. Rows with a null id all stay, repeated ones too.
    """
    hashed = docs.withColumn("_sha", F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("null")))
    found = near.near_duplicates(hashed, key_col="_sha").filter("kept and doc_id is not null")
    group = F.coalesce(F.hex("component"), F.concat(F.lit("text "), "_sha")).alias("_group")
    kept = found.groupBy(F.col("doc_id").alias("_id"), group).agg(F.min("_sha").alias("_first"))
    rows = hashed.join(kept, (F.col("doc_id") == F.col("_id")) & (F.col("_sha") == F.col("_first")), "left_semi")
    rows = rows.dropDuplicates(["doc_id", "_sha"]).unionByName(hashed.filter("doc_id is null"))
    return like_documents(rows, docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte runs of 100 and more that occur earlier; texts of which nothing is left go."""
    keep = [c for c in docs.columns if c != "text"]
    found = repeats.without_repeats(docs, keep=keep).filter("n_bytes = 0 or n_removed < n_bytes")
    return like_documents(found.withColumnRenamed("kept_text", "text"), docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data as pseudonyms."""
    return like_documents(private.pseudonymized(docs, counts="_private"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("private", hide_private),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    folder, docs = shared_dir(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
