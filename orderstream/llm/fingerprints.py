"""Document fingerprints: the k smallest distinct hashes of a text's five-word shingles.

A fingerprint is a sorted array of at most k 64-bit hashes. Fingerprints of parts merge into the fingerprint of the
whole (the k smallest of both); two of them estimate resemblance and containment, one the number of distinct
shingles. Everything is built-in array functions over the row's own words.

A text with one to four words is one shingle; null or wordless text has the empty fingerprint. Two empty fingerprints
are alike (1), an empty and a filled one are not (0). Equal texts have equal fingerprints, in repeated rows too.
An empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderstream.llm.common import read, words

K = 128
SHINGLE = 5
SPAN = 2.0**64
# Neighbouring documents meet in buckets of the id range: about this many in each, and at most so many buckets,
# which bounds the broadcast list of their first documents.
PER_BUCKET, MAX_BUCKETS = 256, 65_536


def hashes(ws: Column, size: int = SHINGLE) -> Column:
    """The shingle hashes of an array of words, in text order. The array must be a column, not an expression."""
    n = F.size(ws)
    many = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(size)]))
    return F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(F.array_join(ws, " ")))).otherwise(F.array().cast("array<bigint>"))


def smallest(values: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(values)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's smallest hashes that both have."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    rank = (F.element_at(a, F.lit(k)).cast("double") + F.lit(SPAN / 2)) / F.lit(SPAN)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / rank)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    r, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), r / (1 + r) * (na + nb) / na))


def as_text(a: Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, text, sketch) of every document; null text becomes empty."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_sketch(base, "text", "sketch", k)


def with_sketch(df: DataFrame, text_col: str, name: str, k: int = K) -> DataFrame:
    out = df.withColumn("_words", words(F.col(text_col)))
    out = out.withColumn("_hashes", hashes(F.col("_words")))
    return out.withColumn(name, smallest(F.col("_hashes"), k)).drop("_words", "_hashes")


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column>: the value in the row with the next smaller doc_id, and for the last row in the first.

    The id range is cut into buckets and each bucket sorted by itself. The first row of a bucket also visits the
    bucket above as a guest, as the successor of that one's last row. Rows of one id follow each other by text;
    null ids come last.
    """
    low, high, n = df.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = low or 0, high or 0
    wanted = max(1, min(MAX_BUCKETS, n // PER_BUCKET))
    width = max(1, -(-(high - low + 1) // wanted))
    rows = df.withColumn("_bucket", F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)), F.lit(-1)))
    heads = df.select("doc_id", F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)), F.lit(-1)).alias("_bucket"))
    heads = heads.groupBy("_bucket").agg(F.max("doc_id").alias("_first"))
    order = Window.orderBy("_bucket")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        "_first", F.coalesce(F.lead("_bucket").over(order), F.first("_bucket").over(everything)).alias("_visits")
    )
    guests = (
        df.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_first")))
        .select(*df.columns, F.col("_visits").alias("_bucket"), F.lit(True).alias("_guest"))
    )
    both = rows.select(*df.columns, "_bucket", F.lit(False).alias("_guest")).unionByName(guests)
    down = Window.partitionBy("_bucket").orderBy("_guest", F.desc_nulls_last("doc_id"), "text")
    found = both.select("*", F.lead(F.struct(*columns)).over(down).alias("_next")).filter(~F.col("_guest"))
    return found.select(*df.columns, *[F.col("_next")[c].alias(f"next_{c}") for c in columns])


def compared(docs: DataFrame, k: int = K) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how alike they and the next document's are.

    Edited: the last half of the code points (rounded down) gives way to the first as many of the next document,
    descending doc_id.
    """
    pairs = with_next(fingerprinted(docs, k=k), ["text", "sketch"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, _n - _half)"), F.expr("substring(next_text, 1, _half)"))
    pairs = pairs.withColumns({"_n": n, "_half": half})
    pairs = with_sketch(pairs.withColumn("edited", edited), "edited", "edited_sketch", k)
    return pairs.select(
        "doc_id",
        F.col("_n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"),
    )


def query(spark, folder: str) -> DataFrame:
    return compared(read(spark, folder, "documents"))
