"""Importance resampling towards a target distribution.

Features (runs of words) fall into hashed buckets. A bucket's gain is the logarithm of its share in the target texts over
its share in the documents; a document's weight is the sum of its features' gains, looked up in one array of as many
numbers as there are buckets. Gumbel noise from the document's id makes the highest scores a weighted draw without
replacement.

Scores are ranked by a distributed LSD radix sort of the composite key (falling score, rising id). Rows lie in parts, by
their place. A pass counts each part's digits, sums the counts in the order (digit, part) to the first place of every
digit of every part, and deals the rows out by these; equal digits keep their order. After the last pass the place is
the rank. Each pass writes its rows, so a lost executor costs one task of one pass.

Null and wordless texts have no features and weight 0. Documents with fewer than min_words words and rows with a null
id are not drawn; a null id has no score. Repeated rows each take part; rows of equal score and id come in any order.
Empty tables give an empty result; without target texts gains come from the documents alone. Only the named columns of
either table are read. Places are 64-bit; weights are exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderstream.llm.common import read, shared_dir, slices, stored

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
BITS = 11
LEAST_PART, MOST_PART = 1 << 12, 1 << 20
REMEMBERED = 1_000_000
# What is between words becomes a blank; A-Z become a-z; bytes of other characters stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Remembered(dict):
    """The bucket of each word, kept up to a number of words."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = crc32(feature) % self.buckets
        if len(feature) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[feature] = bucket
        return bucket


def features(text: str | None, known: Remembered, longest: int) -> tuple[int, np.ndarray]:
    """The number of words and the bucket of every feature."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()
    runs = [ws, *([b" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] for n in range(2, longest + 1))]
    return len(ws), np.concatenate([np.fromiter(map(known.__getitem__, run), np.int32, len(run)) for run in runs])


def counted(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Remembered(buckets), np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                total += np.bincount(features(text, known, longest)[1], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) over all texts; a task sends one row a bucket at most."""
    return texts.mapInArrow(counted(buckets, longest), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """The gain of each bucket: an array whose size is the parameter, not the data's."""
    both = bucket_counts(documents, buckets, longest).withColumnRenamed("n", "s")
    both = both.join(bucket_counts(target, buckets, longest).withColumnRenamed("n", "t"), "bucket", "full_outer")
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for row in both.na.fill(0).collect():
        s[row.bucket], t[row.bucket] = row.s, row.t
    share = (t + 1) * float(s.sum() + buckets) / ((s + 1) * float(t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in share.tolist()], np.int64)


def noise(doc_id, seed: int) -> int:
    h = int(sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def scored(gain: np.ndarray, longest: int, seed: int):
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(buckets)
        for batch in slices(batches):
            ids, n_words, n, weight = batch.column("doc_id").to_pylist(), [], [], []
            for text in batch.column("text").to_pylist():
                count, found = features(text, known, longest)
                n_words.append(count)
                n.append(len(found))
                weight.append(int(gain[found].sum()))
            score = [None if i is None else w + noise(i, seed) for i, w in zip(ids, weight, strict=True)]
            columns = [pa.array(x, pa.int64()) for x in (ids, n_words, n, weight, score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    return run


class Digits:
    """The digits of the composite key, least significant first: those of the id, then those of the falling score."""

    def __init__(self, low_id: int, high_id: int, low: int, high: int, bits: int = BITS) -> None:
        self.low_id, self.high, self.bits = low_id, high, bits
        self.of_id = -(-max(1, (high_id - low_id).bit_length()) // bits)
        self.of_score = -(-max(1, (high - low).bit_length()) // bits)

    def __len__(self) -> int:
        return self.of_id + self.of_score

    def at(self, k: int, doc_id: np.ndarray, score: np.ndarray) -> np.ndarray:
        u, mask = np.uint64, np.uint64((1 << self.bits) - 1)
        if k < self.of_id:  # differences of longs may pass a long's range; modulo 2**64 they are right
            key, k = doc_id.astype(np.int64).view(u) - np.array(self.low_id, np.int64).view(u), k
        else:
            key, k = np.array(self.high, np.int64).view(u) - score.astype(np.int64).view(u), k - self.of_id
        return ((key >> u(k * self.bits)) & mask).astype(np.int64)


ROW = "doc_id long, n_words long, n_features long, weight long, score long, part long, place long, digit long"


def first_digits(digits: Digits, parts: int):
    """Rows in any order, dealt over the parts, with their first digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, score = (batch.column(c).to_numpy() for c in ("doc_id", "score"))
            spread = (doc_id.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            part = (spread % np.uint64(parts)).astype(np.int64)
            yield with_columns(batch, part, doc_id, digits.at(0, doc_id, score))

    return run


def with_columns(batch: pa.RecordBatch, part: np.ndarray, place: np.ndarray, digit: np.ndarray) -> pa.RecordBatch:
    kept = ["doc_id", "n_words", "n_features", "weight", "score"]
    columns = [*(batch.column(c) for c in kept), *(pa.array(x, pa.int64()) for x in (part, place, digit))]
    return pa.RecordBatch.from_arrays(columns, [*kept, "part", "place", "digit"])


def dealt(digits: Digits, k: int, chunk: int):
    """Pass k: each part's first places come ahead of its rows; a row takes the next place of its digit.

    Gives the rows with their new part and place and, for the next pass, their next digit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, following = None, None
        for batch in batches:
            part = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                rows = batch.slice(a, b - a)
                if part[a] != now:
                    now, following = part[a], None
                if following is None:
                    first = rows.column("first")[0].as_py()
                    following, rows = np.zeros(1 << digits.bits, np.int64), rows.slice(1)
                    following[[x["digit"] for x in first]] = [x["start"] for x in first]
                if not len(rows):
                    continue
                digit = rows.column("digit").to_numpy()
                order = np.argsort(digit, kind="stable")
                sorted_ = digit[order]
                heads = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
                run_length = np.diff(np.append(heads, len(sorted_)))
                place = np.empty(len(rows), np.int64)
                place[order] = following[sorted_] + np.arange(len(sorted_)) - np.repeat(heads, run_length)
                following[sorted_[heads]] += run_length
                doc_id, score = (rows.column(c).to_numpy() for c in ("doc_id", "score"))
                more = digits.at(k + 1, doc_id, score) if k + 1 < len(digits) else np.zeros(len(rows), np.int64)
                yield with_columns(rows, place // chunk, place, more)

    return run


def first_places(rows: DataFrame) -> DataFrame:
    """(part, first): for each part, the first place of each digit that occurs in it.

    Places go by digit, and within a digit by part. Across digits only one row a digit (2**BITS at most) is summed.
    """
    counts = rows.groupBy("digit", "part").agg(F.count("*").alias("n"))
    before_part = Window.partitionBy("digit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before_digit = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("digit").agg(F.count("*").alias("n"))
    totals = totals.select("digit", F.coalesce(F.sum("n").over(before_digit), F.lit(0)).alias("base"))
    starts = counts.withColumn("inside", F.coalesce(F.sum("n").over(before_part), F.lit(0))).join(totals, "digit")
    start = F.struct("digit", (F.col("base") + F.col("inside")).alias("start"))
    return starts.groupBy("part").agg(F.collect_list(start).alias("first"))


def radix_sorted(rows: DataFrame, folder: str, bits: int = BITS, chunk: int | None = None) -> DataFrame:
    """The rows (doc_id, n_words, n_features, weight, score) with place: 0, 1, … by falling score, then rising id."""
    ends = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("doc_id", "score") for f in (F.min, F.max)]).first()
    if not ends.n:
        return rows.select("*", F.lit(None).cast("long").alias("place"))
    digits = Digits(ends.min_doc_id, ends.max_doc_id, ends.min_score, ends.max_score, bits)
    chunk = chunk or min(MOST_PART, max(LEAST_PART, ends.n // 1024))
    now = stored(rows.mapInArrow(first_digits(digits, -(-ends.n // chunk)), ROW), f"{folder}/pass-0")
    for k in range(len(digits)):
        heads = first_places(now).withColumn("place", F.lit(None).cast("long"))
        both = now.withColumn("first", F.lit(None).cast("array<struct<digit: long, start: long>>")).unionByName(heads, allowMissingColumns=True)
        both = both.repartition("part").sortWithinPartitions("part", F.col("first").isNull(), "place")
        now = stored(both.mapInArrow(dealt(digits, k, chunk), ROW), f"{folder}/pass-{k + 1}")
    return now.drop("part", "digit")


def resampled(
    documents: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS,
    longest: int = LONGEST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank counts the drawn percent of the rows that qualify."""
    folder = shared_dir(documents.sparkSession, "resample")
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(texts.select("text"), target.select(F.col(target_col).alias("text")), buckets, longest)
    rows = stored(texts.mapInArrow(scored(gain, longest, seed), SCORED), f"{folder}/scored")
    qualified = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    ranked = radix_sorted(rows.filter(qualified), folder)
    drawn = rows.filter(qualified).count() * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
    both = ranked.unionByName(rows.filter(~qualified), allowMissingColumns=True)
    return both.select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", rank)


def query(spark, folder: str) -> DataFrame:
    return resampled(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), dw AS (
  SELECT doc_id, unnest(w) AS word FROM d
), bw AS (
  SELECT unnest(w) AS word FROM b
), bytes AS (
  SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
    lambda acc, c: list_reduce(list_prepend(xor(acc, c), range(8)),
      lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295::BIGINT) % 10000 AS bucket FROM bytes
), s AS (
  SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket
), n AS (
  SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ns, (SELECT coalesce(sum(t), 0) FROM t) AS nt
), g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ns + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (nt + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), n
), weights AS (
  SELECT doc_id, sum(gain) AS weight FROM dw JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN r <= (SELECT 10 * count(*) // 100 FROM ranked) THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
