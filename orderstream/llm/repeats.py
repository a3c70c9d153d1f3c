"""Removal of repeated byte runs with a logarithmic family of suffix indexes.

A byte goes if a string of LENGTH bytes over it also starts earlier: in a smaller doc_id, or in the same document before.
Strings are judged on the input; matches never cross documents.

Suffixes are sampled: of the LENGTH-byte strings, each names its anchor, the GRAM-byte gram of the smallest hash in it
(the leftmost of equal ones), so equal strings name equal anchors at equal places. The suffixes at anchors, with the run
of strings that name them, are about a fortieth of all. A batch of documents becomes a suffix array: its rows sorted by
the gram's hash (key), then by the hash of the bytes the run spans, then by place. New batches are merge-scanned with
the levels there are: rows of an equal span but the first are repeats as they stand; keys met with several spans are
probed, string by string, on the documents' bytes. A batch's new spans become a level; two levels of equal size merge
into one of twice the size, so a suffix is rewritten at most log(batches) times. Levels are written tables.

Null text has no bytes. Rows with a null id take no part: nothing is removed from or because of them. A repeated row
(same id, same text) counts once and gets the same result as its twin. Different texts of one id are one document's
versions, in order of their SHA-256: a string of one that an earlier version has goes; matches do not cross them. Empty tables give empty tables. Very long texts are worked off in
overlapping pieces. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderstream.llm.common import read, shared_dir, slices, stored
from orderstream.llm.hashing import U, mix, prefix, ranges

LENGTH, GRAM = 100, 24
PIECE = 1 << 19
PLACE = U((1 << 22) - 1)
HOT = 20_000  # contexts of one key beyond which its strings are dealt out one by one
COVERED, PROBE, LEVEL = 0, 1, 2
SHIFT = 31  # a start is the place in the text with the version of the id above these bits
SUFFIX = "kind int, key long, span long, doc_id long, start long, runs int"
NAMES = ["kind", "key", "span", "doc_id", "start", "runs"]


def grams(data: np.ndarray) -> np.ndarray:
    """Mixed values of all 8-byte grams."""
    x = data.astype(U)
    x = x[:-1] | x[1:] << U(8)
    x = x[:-2] | x[2:] << U(16)
    return mix(x[:-4] | x[4:] << U(32))


def anchors(texts: list[bytes], origin: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, span, text, start, runs) of the anchors of the texts' strings; start counts from the text's origin."""
    size = np.array([len(x) for x in texts])
    end = np.cumsum(size)
    data = np.frombuffer(b"".join(texts) + bytes(2 * LENGTH), np.uint8)
    n = int(end[-1])
    g = grams(data)
    key = mix(g[:-16] ^ g[8:-8] * U(0xC2B2AE3D27D4EB4F) ^ g[16:] * U(0x165667B19E3779F9))
    low = (key[: n + LENGTH] & ~PLACE) | np.arange(n + LENGTH, dtype=U)
    width, step = LENGTH - GRAM + 1, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: n + 1], low[width - step :][: n + 1])[:n]
    text = np.repeat(np.arange(len(texts)), size)
    ok = np.flatnonzero(np.arange(n) + LENGTH <= end[text])
    at, text = (low[ok] & PLACE).astype(np.int64), text[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    i = np.flatnonzero(new)
    first, last = ok[i], ok[np.append(i[1:], len(ok)) - 1] if len(i) else ok[i]
    at, text = at[i], text[i]
    shape = mix((last - first).astype(U) << U(8) | (at - first).astype(U))
    span = mix(ranges(prefix(g[:n]), first, last + LENGTH - 7)) ^ shape
    return key[at].astype(np.int64), span.astype(np.int64), text, first - (end - size)[text] + origin[text], last - first + 1


def rows(kind, key, span, doc, start, runs) -> pa.RecordBatch:
    n = len(doc)
    full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x, t), n).copy())
    columns = [full(kind, np.int32), full(key, np.int64), full(span, np.int64), full(doc, np.int64), full(start, np.int64), full(runs, np.int32)]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def merged_runs(doc: np.ndarray, start: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring runs of strings as one."""
    order = np.lexsort((start, doc))
    doc, start, runs = doc[order], start[order], runs[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + runs[:-1])
    i = np.flatnonzero(new)
    return doc[i], start[i], np.add.reduceat(runs, i) if len(i) else runs[i]


def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix rows of documents; what repeats within a piece of text is settled here."""

    def flush(ids: list[int], texts: list[bytes], origin: list[int]) -> Iterator[pa.RecordBatch]:
        key, span, text, start, runs = anchors(texts, np.array(origin))
        doc = np.array(ids)[text]
        order = np.lexsort((start, doc, span, key))
        key, span, doc, start, runs = key[order], span[order], doc[order], start[order], runs[order]
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (span[1:] == span[:-1])
        yield rows(LEVEL, key[~again], span[~again], doc[~again], start[~again], runs[~again])
        d, s, r = merged_runs(doc[again], start[again], runs[again])
        yield rows(COVERED, mix(d.astype(U) + s.astype(U)).astype(np.int64), 0, d, s, r)

    ids, texts, origin, size = [], [], [], 0
    for batch in slices(batches):
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "_version"))
        for doc, text, version in zip(*columns, strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for at in range(0, max(0, len(data) - LENGTH + 1), PIECE):
                piece = data[at : at + PIECE + LENGTH - 1]
                ids.append(doc)
                texts.append(piece)
                origin.append((version << SHIFT) + at)
                size += len(piece)
                if size >= PIECE:
                    yield from flush(ids, texts, origin)
                    ids, texts, origin, size = [], [], [], 0
    if texts:
        yield from flush(ids, texts, origin)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The merge-scan over rows sorted by key, span and place. Rows of older levels come marked as PROBE."""
    last_key = last_span = None
    first: list[np.ndarray] | None = None  # the last key's first row, while no second span is seen
    for batch in batches:
        if not len(batch):
            continue
        kind, key, span, doc, start, runs = (batch.column(c).to_numpy() for c in NAMES)
        passed = kind == COVERED
        if passed.any():
            yield rows(COVERED, 0, 0, doc[passed], start[passed], runs[passed])
            kind, key, span, doc, start, runs = (x[~passed] for x in (kind, key, span, doc, start, runs))
        n = len(key)
        if not n:
            continue
        new_key, new_span = np.ones(n, bool), np.ones(n, bool)
        new_key[1:] = key[1:] != key[:-1]
        new_span[1:] = new_key[1:] | (span[1:] != span[:-1])
        new_key[0] = key[0] != last_key
        new_span[0] = new_key[0] or span[0] != last_span
        rest = ~new_span
        if rest.any():
            yield rows(COVERED, 0, 0, doc[rest], start[rest], runs[rest])
        fresh = new_span & (kind == LEVEL)
        if fresh.any():
            yield rows(LEVEL, key[fresh], span[fresh], doc[fresh], start[fresh], runs[fresh])
        # A key's first row is a probe once a second span follows; all later spans are probes.
        heads = np.flatnonzero(new_span)
        starts = new_key[heads]
        if len(heads):
            if not starts[0] and first is not None:
                yield rows(PROBE, *first)
                first = None
            probe = ~starts
            probe[:-1] |= starts[:-1] & ~starts[1:]
            h = heads[probe]
            if len(h):
                yield rows(PROBE, key[h], 0, doc[h], start[h], runs[h])
            if starts[-1]:
                x = heads[-1:]
                first = [key[x], np.zeros(1, np.int64), doc[x], start[x], runs[x]]
            else:
                first = None
        last_key, last_span = key[-1], span[-1]


class SuffixIndex:
    """Levels of suffix tables. add() takes documents with larger ids than all before."""

    def __init__(self, spark: SparkSession, name: str = "repeats"):
        self.spark, self.folder, self.batches = spark, shared_dir(spark, name), 0
        self.levels: list[tuple[int, DataFrame]] = []  # (batches in it, its rows)

    def add(self, docs: DataFrame, last: bool = False) -> None:
        """Scans (doc_id, text) rows against all levels and makes them a level; after the last batch none is needed.

        No row comes twice; different texts of one id are told apart by a _version.
        """
        version = F.col("_version") if "_version" in docs.columns else F.lit(0).alias("_version")
        new = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", version).mapInArrow(suffixes, SUFFIX)
        for _, level in self.levels:
            new = new.unionByName(level.withColumn("kind", F.lit(PROBE)))
        sorted_ = new.repartition("key").sortWithinPartitions("key", "span", "doc_id", "start")
        result = sorted_.mapInArrow(scan, SUFFIX)
        if last:
            result = result.filter(F.col("kind") != LEVEL)
        number, self.batches = self.batches, self.batches + 1
        result.withColumn("part", F.col("kind")).write.partitionBy("part").parquet(f"{self.folder}/found/batch={number}")
        if last:
            return
        self.levels.append((1, self.rows(LEVEL).filter(F.col("batch") == number).select(*NAMES)))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            path = f"{self.folder}/level/{number}-{n + m}"
            b.unionByName(a).write.parquet(path)
            self.levels.append((n + m, self.spark.read.schema(SUFFIX).parquet(path)))

    def rows(self, kind: int) -> DataFrame:
        """What the scans have found so far: COVERED runs, PROBE runs, or LEVEL rows."""
        found = self.spark.read.schema(f"{SUFFIX}, batch int, part int").parquet(f"{self.folder}/found")
        return found.filter(F.col("part") == kind)


def compressed(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches):
            data = [zip_((x or "").encode("utf-8", "surrogatepass")) for x in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(data, pa.binary())], [*keep, "_data"])

    return run


CONTEXT = "key long, doc_id long, start long, runs int, bytes binary"


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes under each probe; those of hot keys string by string, keyed by content."""
    unzip = zstandard.ZstdDecompressor().decompress
    done: set[tuple[int, int]] = set()
    for batch in slices(batches):
        out = [[], [], [], [], []]
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "_version", "_data", "probes"))
        for doc, version, z, probes in zip(*columns, strict=True):
            data = unzip(z)
            if not data or (doc, version) in done:
                continue
            done.add((doc, version))
            for p in probes:
                s, n = p["start"], p["runs"]
                for at, runs in [(s + i, 1) for i in range(n)] if p["hot"] else [(s, n)]:
                    place = at - (version << SHIFT)
                    piece = data[place : place + runs - 1 + LENGTH]
                    if len(piece) != runs - 1 + LENGTH:
                        continue
                    key = p["key"] if not p["hot"] else int.from_bytes(sha256(piece).digest()[:8], "little", signed=True)
                    for column, value in zip(out, (key, doc, at, runs, piece), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
            ["key", "doc_id", "start", "runs", "bytes"],
        )


def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of a key that are not its first of their content; rows sorted by key and place."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        where = np.stack([table.column(c).to_numpy() for c in ("key", "doc_id", "start", "runs")], 1)
        new = np.ones(len(where), bool)
        new[1:] = (where[1:] != where[:-1]).any(1)  # a repeated row's strings may come twice
        table = table if new.all() else table.filter(pa.array(new))
        key, doc, start, runs = (table.column(c).to_numpy() for c in ("key", "doc_id", "start", "runs"))
        data = b"".join(table.column("bytes").to_pylist())
        g = grams(np.frombuffer(data + bytes(8), np.uint8))
        size = runs.astype(np.int64) - 1 + LENGTH
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(runs)), runs)
        o = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
        at = begin[row] + o
        value = mix(ranges(prefix(g), at, at + LENGTH - 7)) ^ mix(key[row].astype(U))
        again = np.ones(len(row), bool)
        again[np.unique(value, return_index=True)[1]] = False
        d, s, r = merged_runs(doc[row][again], (start[row] + o)[again], np.ones(int(again.sum()), np.int64))
        return rows(COVERED, 0, 0, d, s, r)

    held: list[pa.Table] = []
    count = 0
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.flatnonzero(key == key[-1])[0])
        table = pa.Table.from_batches([batch])
        if held and held[-1].column("key")[-1].as_py() != key[-1] or cut:
            done = pa.concat_tables([*held, table.slice(0, cut)])
            held, count = [table.slice(cut)], 0
            if len(done):
                yield settle(done)
        else:
            held.append(table)
            count += len(table)
    if held:
        yield settle(pa.concat_tables(held))


def finished(keep: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches):
            n_bytes, n_removed, n_spans, sha, texts = [], [], [], [], []
            for z, found in zip(batch.column("_data").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                data = unzip(z)
                parts, at, spans = [], 0, 0
                for s, e in sorted((x["start"], min(x["end"], len(data))) for x in found or [] if x["start"] < len(data)):
                    if s > at or not spans:
                        parts.append(data[at:s])
                        spans += 1
                    at = max(at, e)
                parts.append(data[at:])
                left = b"".join(parts)
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(left))
                n_spans.append(spans)
                sha.append(sha256(left).hexdigest())
                if with_text:
                    texts.append(left.decode("utf-8", "ignore"))
            columns = [*[batch.column(c) for c in keep], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
            names = [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def versions(source: DataFrame, folder: str) -> DataFrame | None:
    """(_id, _sha, _version) of the texts of ids that several rows have; none if every id is a row's own."""
    present = source.filter("doc_id is not null and text is not null")
    several = present.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_id"))
    several = stored(several, f"{folder}/several")
    if several.isEmpty():
        return None
    texts = present.join(several, F.col("doc_id") == F.col("_id")).select("_id", sha_of("text").alias("_sha")).distinct()
    number = F.row_number().over(Window.partitionBy("_id").orderBy("_sha")) - 1
    return stored(texts.withColumn("_version", number.cast("int")), f"{folder}/versions")


def sha_of(text: str) -> Column:
    return F.sha2(F.col(text).cast("binary"), 256)


def versioned(rows: DataFrame, known: DataFrame | None, text: str) -> DataFrame:
    """The rows with their text's _version: null where the id is a row's own."""
    if known is None:
        return rows.withColumn("_version", F.lit(None).cast("int"))
    same = (F.col("doc_id") == F.col("_id")) & (sha_of(text) == F.col("_sha"))
    return rows.join(known, same, "left").drop("_id", "_sha")


def without_repeats(
    docs: DataFrame, keep: list[str] | None = None, batches: int = 2, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The kept columns (the id among them) with n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept_text."""
    spark, keep = docs.sparkSession, keep or [id_col]
    ids = F.col(id_col).cast("long").alias("doc_id")
    source = docs.select(ids, F.col(text_col).alias("text"))
    cuts = source.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    index = SuffixIndex(spark)
    known = versions(source, shared_dir(spark, "versions"))
    source = versioned(source, known, "text")
    if known is not None:
        source = source.filter("_version is null").unionByName(source.filter("_version is not null").dropDuplicates(["doc_id", "_version"]))
    source = source.withColumn("_version", F.coalesce("_version", F.lit(0)))
    for i in range(len(cuts) + 1):
        part = source
        if i > 0:
            part = part.filter(F.col("doc_id") > cuts[i - 1])
        if i < len(cuts):
            part = part.filter(F.col("doc_id") <= cuts[i])
        index.add(part, last=i == len(cuts))

    # Every document's bytes, dealt by id once; both joins below use that exchange.
    names = [c for c in keep if c != "doc_id"]
    carried = docs.select(ids.alias("doc_id"), *[F.col(c) for c in names], F.col(text_col).alias("_text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[:-1])
    carried = versioned(carried, known, "_text").withColumn("_version", F.coalesce("_version", F.lit(0)))
    n, by = int(spark.conf.get("spark.sql.shuffle.partitions")), ["doc_id", "_version"]
    dealt = carried.mapInArrow(compressed(["doc_id", *names, "_version"]), f"{shape}, _version int, _data binary").repartition(n, *by)
    version = F.shiftright("start", SHIFT).cast("int").alias("_version")
    place = F.col("start").bitwiseAND(F.lit((1 << SHIFT) - 1))

    probes = index.rows(PROBE).select("key", "doc_id", "start", "runs").distinct()
    hot = probes.groupBy("key").count().filter(F.col("count") > HOT).select("key", F.lit(True).alias("hot"))
    probes = probes.join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    by_doc = probes.groupBy("doc_id", version).agg(F.collect_list(F.struct("key", "start", "runs", "hot")).alias("probes"))
    under = dealt.join(by_doc, by).select("doc_id", "_version", "_data", "probes").mapInArrow(contexts, CONTEXT)
    found = under.repartition("key").sortWithinPartitions("key", "doc_id", "start").mapInArrow(resolved, SUFFIX)
    gone = index.rows(COVERED).select("doc_id", "start", "runs").unionByName(found.select("doc_id", "start", "runs"))
    gone = gone.groupBy("doc_id", version).agg(F.collect_list(F.struct(place.alias("start"), (place + F.col("runs") - 1 + LENGTH).alias("end"))).alias("gone"))
    out = dealt.join(gone, by, "left").select("doc_id", *names, "_data", "gone")
    more = ", kept_text string" if with_text else ""
    stats = f"n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}"
    return out.mapInArrow(finished(["doc_id", *names], with_text), f"{shape}, {stats}")


def query(spark, folder: str) -> DataFrame:
    return without_repeats(read(spark, folder, "documents"), with_text=False)
