"""Near-duplicate documents with an LSH forest over MinHash signatures.

Texts of equal words are one class first. Every class has a signature of HASHES minima; tree t of the forest orders
the classes by the minima from position DEPTH * t on (around the end), LABEL of them. Classes that share their first
SHARED minima in a tree form a region; a region of more than CROWD classes is cut at the next minimum, as deep as the
label goes. Candidates are neighbours in the order (longest common prefixes meet) and the region's medoid, the class
that agrees most with the region's commonest minima. A class keeps its two most alike candidates; full shingle sets
confirm them, and confirmed links make components.

A second pass takes the regions in which classes of several components still meet. One of more than HUGE classes is dealt
into tiles of two blocks each, so that every pair of classes not both in its largest component meets in one tile.
Signatures tell, tile by tile, which classes may have a link into another component (SLACK below the threshold, five
standard errors); these bring their full sets, and an inverted index per tile finds every link that still joins two
components. Pairs are compared inside the task and never become rows.

A pair at similarity 0.8 shares no first two minima in any of the 16 trees with a probability of 8e-8, if minima are
independent; every other pair is judged, whatever the size of its region.

Null or wordless text has no shingles and links with nothing. Rows with a null id are their own documents (component
null, kept). Repeated rows each get the same result. An empty table gives an empty table. Of the documents only the
named id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderstream.llm.common import read, shared_dir, slices, stored
from orderstream.llm.components import components
from orderstream.llm.hashing import U, mix, shingle_set, word_hashes

TREES, DEPTH, LABEL, SHARED = 16, 4, 8, 2
HASHES = TREES * DEPTH
CROWD, HUGE = 64, 4096
SLACK = 0.27
BLOCK = 256
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_A = mix(np.arange(1, HASHES + 1, dtype=U)) | U(1)
_B = mix(np.arange(1001, HASHES + 1001, dtype=U))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        low = np.minimum(low, ((shingles[at : at + 1024, None] * _A + _B) >> U(32)).min(0))
    return low.astype(np.uint32)


def profiles(size: int, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            count, node, sig = [], [], []
            for text in batch.column("text").to_pylist():
                ws = words_of(text)
                found = shingle_set(word_hashes(ws), size)
                count.append(len(found))
                node.append(blake2b(b" ".join(ws), digest_size=16).digest() if ws else None)
                sig.append(signature(found).tobytes() if ws else None)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", *carry)], pa.array(count, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", *carry, "n_shingles", "node", "sig"],
            )

    return run


def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and tree: the key of its region."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, HASHES).astype(U)
        nodes, trees, keys = [], [], []
        for t in range(TREES):
            key = np.full(n, U(t), U)
            for j in range(SHARED):
                key = mix(key + sig[:, (t * DEPTH + j) % HASHES])
            nodes.append(batch.column("node"))
            trees.append(np.full(n, t, np.int32))
            keys.append(key.astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays(nodes), pa.array(np.concatenate(trees)), pa.array(np.concatenate(keys))], ["node", "tree", "region"]
        )


REGION = ["tree", "region"]
TILE = [*REGION, "i", "j"]


def regions_of(batches: Iterator[pa.RecordBatch], by: list[str] = REGION) -> Iterator[tuple[int, pa.Table]]:
    """(tree, rows) of each region or tile; rows come sorted by its columns."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        key = np.stack([batch.column(c).to_numpy() for c in by], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(key[a].tolist())
            if last is not None and now != last:
                yield last[0], pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = now
    if held:
        yield last[0], pa.concat_tables(held)


def parts(sig: np.ndarray, rows: np.ndarray, order: list[int], depth: int, crowd: int) -> Iterator[np.ndarray]:
    """A region's rows in label order, cut deeper where it is crowded."""
    if len(rows) <= crowd or depth >= LABEL:
        yield rows
        return
    value = sig[rows, order[depth]]
    for v in np.unique(value):
        yield from parts(sig, rows[value == v], order, depth + 1, crowd)


def medoid(sig: np.ndarray) -> int:
    """The row that agrees with most of the columns' commonest values."""
    score = np.zeros(len(sig), np.int64)
    for j in range(HASHES):
        value, count = np.unique(sig[:, j], return_counts=True)
        score += sig[:, j] == value[count.argmax()]
    return int(score.argmax())


PAIRS = "a binary, b binary, likeness double"


def emitted(table: list[bytes], a: np.ndarray, b: np.ndarray, like: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([table[i] for i in a], pa.binary()), pa.array([table[i] for i in b], pa.binary()), pa.array(like, pa.float64())],
        ["a", "b", "likeness"],
    )


def neighbours(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, rows in regions_of(batches):
            nodes = rows.column("node").to_pylist()
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(len(nodes), HASHES)
            order = [(tree * DEPTH + j) % HASHES for j in range(LABEL)]
            ranked = np.lexsort([sig[:, j] for j in reversed(order)])
            a, b = [ranked[:-1]], [ranked[1:]]
            for part in [ranked, *parts(sig, ranked, order, SHARED, CROWD)] if len(ranked) > CROWD else [ranked]:
                if len(part) > 2:
                    a.append(part)
                    b.append(np.full(len(part), part[medoid(sig[part])]))
            x, y = np.concatenate(a), np.concatenate(b)
            like = np.concatenate([(sig[x[i : i + 4096]] == sig[y[i : i + 4096]]).mean(1) for i in range(0, len(x), 4096)])
            ok = (x != y) & (like >= threshold - SLACK)
            yield emitted(nodes, x[ok], y[ok], like[ok])

    return run


def tiled(rows: DataFrame) -> DataFrame:
    """The rows of regions with block, i and j, once for each tile they are in.

    A region's rows outside its largest component and those inside are dealt into blocks of about HUGE each; tile (i, j)
    holds two blocks, the first of them of outside rows. A region of at most HUGE rows is one tile.
    """
    each = rows.groupBy(*REGION, "component").agg(F.count("*").alias("n"))
    size = each.groupBy(*REGION).agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"))
    blocks = lambda n: F.ceil(n / HUGE).cast("int")
    small = F.col("n") <= HUGE
    outer = F.when(small, 1).otherwise(blocks(F.col("n") - F.col("top.n")))
    inner = F.when(small, 0).otherwise(blocks(F.col("top.n")))
    size = size.select(*REGION, F.col("top.component").alias("main"), outer.alias("outer"), inner.alias("inner"))
    dealt, inside = F.xxhash64("node"), (F.col("component") == F.col("main")) & (F.col("inner") > 0)
    block = F.when(inside, F.col("outer") + F.pmod(dealt, F.col("inner"))).otherwise(F.pmod(dealt, F.col("outer"))).cast("int")
    out = rows.join(size, REGION).withColumn("block", block)
    others = F.sequence(F.lit(0), F.when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)
    out = out.withColumn("_other", F.explode(others))
    ends = [F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j")]
    return out.select("node", *REGION, "component", "block", *ends)


def unmet(threshold: float):
    """The rows of a tile that may have a link into another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in regions_of(batches, TILE):
            n = len(rows)
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(n, HASHES)
            group = np.unique(np.array([x.hex() for x in rows.column("component").to_pylist()]), return_inverse=True)[1]
            block, i, j = (rows.column(c).to_numpy() for c in ("block", "i", "j"))
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if i[0] == j[0]:
                left = left[group[left] != np.bincount(group).argmax()]
            marked = np.zeros(n, bool)
            for at in range(0, len(left), BLOCK):
                x = left[at : at + BLOCK]
                for to in range(0, len(right), BLOCK):
                    y = right[to : to + BLOCK]
                    like = np.zeros((len(x), len(y)), np.int16)
                    for h in range(HASHES):
                        like += sig[x, h][:, None] == sig[y, h][None, :]
                    ok = (like >= (threshold - SLACK) * HASHES) & (group[x][:, None] != group[y][None, :])
                    marked[x[ok.any(1)]] = True
                    marked[y[ok.any(0)]] = True
            found = np.flatnonzero(marked)
            if len(found):
                yield from rows.take(pa.array(found)).select(["node", *TILE, "component"]).combine_chunks().to_batches()

    return run


def linked(percent: int):
    """Links that join the components of a tile, found on full shingle sets: at most one fewer than there are rows.

    An inverted index of the tile's shingles gives a row's overlap with all others at once. Rows outside the largest
    component are taken in turn; a link counts unless it joins what is joined already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in regions_of(batches, TILE):
            yield from within(rows, percent)

    return run


def within(rows: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    nodes = rows.column("node").to_pylist()
    sets = [np.frombuffer(x, U) for x in rows.column("shingles").to_pylist()]
    size = np.array([len(x) for x in sets])
    group = np.unique(np.array([x.hex() for x in rows.column("component").to_pylist()]), return_inverse=True)[1]
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    number = np.unique(every, return_inverse=True)[1]
    owner = owner[np.argsort(number, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(number))])
    at = np.concatenate([[0], np.cumsum(size)])
    a, b = [], []
    for x in np.flatnonzero(group != np.bincount(group).argmax()):
        mine = number[at[x] : at[x + 1]]
        both = np.zeros(len(sets), np.int64)
        for i in range(0, len(mine), 4096):
            lists = [owner[first[k] : first[k + 1]] for k in mine[i : i + 4096]]
            both += np.bincount(np.concatenate(lists), minlength=len(sets))
        ok = (both * 100 >= (size + size[x] - both) * percent) & (group != group[x])
        while ok.any():
            y = int(ok.argmax())
            a.append(x)
            b.append(y)
            group[group == group[x]] = group[y]
            ok &= group != group[x]
    if a:
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in a], pa.binary()), pa.array([nodes[i] for i in b], pa.binary())], ["a", "b"])


def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        both, total = [], []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            s, t = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            common = len(np.intersect1d(s, t, assume_unique=True))
            both.append(common)
            total.append(len(s) + len(t) - common)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(total, pa.int64())],
            ["a", "b", "both", "total"],
        )


def sets_of(wanted: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the wanted classes, from one document each; others of the same id are told apart by class."""
    ids = wanted.distinct().join(classes.select("node", F.col("doc_id").alias("_id")), "node")
    texts = docs.join(ids, docs["doc_id"] == F.col("_id")).select("node", "text")
    return texts.mapInArrow(checked(size), "node binary, shingles binary").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, folder: str) -> DataFrame:
    """The pairs whose full shingle sets overlap enough."""
    pairs = stored(pairs, f"{folder}-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    sets = stored(sets_of(wanted, docs, classes, size), f"{folder}-sets")
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    found = joined.select("a", "b", "x", "y").mapInArrow(overlaps, "a binary, b binary, both long, total long")
    return found.filter(F.col("both") * 100 >= F.col("total") * percent).select("a", "b")


def checked(size: int):
    """Shingle sets of texts that are of the class they are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, sets = [], []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ws = words_of(text)
                if blake2b(b" ".join(ws), digest_size=16).digest() == node:
                    nodes.append(node)
                    sets.append(shingle_set(word_hashes(ws), size).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: linked where 100 * both >= percent * total.

    With a key_col, rows also have that column and component, which tells the components of one id apart (null: no words).
    """
    spark, threshold = docs.sparkSession, percent / 100
    folder = shared_dir(spark, "near")
    key = [] if key_col is None else [F.col(key_col).alias("_key")]
    docs = docs.select(F.col(id_col).alias("doc_id"), *key, F.col(text_col).alias("text"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    shape = f"{shape}, n_shingles long, node binary, sig binary"
    rows = stored(docs.mapInArrow(profiles(size, ["_key"] if key else []), shape), f"{folder}/rows")
    classes = rows.filter("node is not null and doc_id is not null").groupBy("node")
    classes = classes.agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    classes = stored(classes, f"{folder}/classes")

    keyed = stored(classes.select("node", "sig").mapInArrow(labels, "node binary, tree int, region long"), f"{folder}/trees")
    shared = keyed.groupBy(*REGION).count().filter("count > 1").select(*REGION)
    met = stored(keyed.join(shared, REGION), f"{folder}/met")
    sorted_ = met.join(classes.select("node", "sig"), "node").repartition(*REGION).sortWithinPartitions(*REGION)
    found = sorted_.select("node", "sig", "tree", "region").mapInArrow(neighbours(threshold), PAIRS)
    ends = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = found.select(ends.alias("_p"), "likeness").select("_p.a", "_p.b", "likeness")
    best = both.groupBy("a").agg(F.max(F.struct("likeness", "b")).alias("first"), F.min(F.struct(-F.col("likeness"), "b")).alias("other"))
    best = best.select("a", F.explode(F.array("first.b", "other.b")).alias("b"))
    pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(confirmed(pairs, docs, classes, size, percent, f"{folder}/first"), f"{folder}/links")
    reached = stored(components(links, "near-first"), f"{folder}/reached")

    named = met.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy(*REGION).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    open_ = tiled(stored(named.join(mixed.select(*REGION), REGION), f"{folder}/mixed"))
    open_ = open_.join(classes.select("node", "sig"), "node").repartition(*TILE).sortWithinPartitions(*TILE)
    shape = "node binary, tree int, region long, i int, j int, component binary"
    rest = open_.select("node", "sig", "component", "block", *TILE).mapInArrow(unmet(threshold), shape)
    rest = stored(rest, f"{folder}/open")
    sets = stored(sets_of(rest.select("node"), docs, classes, size), f"{folder}/open-sets")
    rest = rest.join(sets, "node").repartition(*TILE).sortWithinPartitions(*TILE)
    more = stored(rest.mapInArrow(linked(percent), "a binary, b binary"), f"{folder}/more")
    reached = stored(components(links.union(more), "near-second"), f"{folder}/all")

    of_node = classes.join(reached, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "doc_id")
    low = of_node.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    more = ["component"] if key else []
    of_node = of_node.select("node", "component").join(low, "component").select("node", "component_id", *more)
    out = rows.select("doc_id", *(["_key"] if key else []), "n_shingles", "node").join(of_node, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    more = [F.col("_key").alias(key_col), "component"] if key else []
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", kept, *more)


def query(spark, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents"), size=4)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM d
), n AS (
  SELECT doc_id, count(g) AS n_shingles FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)
), c AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a
), r AS (
  SELECT a, min(b) AS m FROM c GROUP BY a
)
SELECT doc_id, n_shingles, m AS component_id, m = doc_id AS kept FROM n JOIN r ON a = doc_id
"""
