"""Jaccard similarity join of shingle sets as points of a metric space.

The Jaccard distance d = 1 - both / total is a metric; documents link within radius r. Documents of one set are one class.
Unrelated classes all lie at distance 1 of each other, where no pivot can tell them apart, so families come first, exactly:
the shingles are dealt into more parts by their hash than two linked sets can differ in, so linked sets agree in a whole
part that is not empty. Classes that share the content of a part are in one family; a class without a family has no link.
Sets of different size may differ in more, so the number of parts goes by classes of size, and a set also takes the parts
of the next class when it can meet a set of that.

A family is a region, joined recursively:

- A region of at most LEAF classes is joined in a task, by an inverted index of its sets.
- A larger one gets PIVOTS pivots, dealt to as many tasks as it needs. A class is at home with its nearest pivot, or in
  the region of far classes if none is within FAR. By the triangle inequality a class can link into pivot q's region only
  if its distance from q is within 2r of that from its own pivot (and within FAR + r), and into the far region only if it
  is beyond FAR - r of all pivots; there it is a guest. Every link then has both ends in one of the new regions.
- Classes within r of a pivot are linked to it, and are not compared among themselves again (they are anchored).
- A region that pivots do not split well (dense families, in which all windows overlap) is dealt into tiles of two blocks,
  so that every pair not anchored alike meets in one tile. Tiles, like all else, cut down nothing.

Links join into components. The number of links inside a component does not matter, so a task stops at those that join.

Null or wordless text has no shingles and links with nothing. Rows with a null id are their own documents (component
null). Repeated rows each get the same result; an id with several texts links by each. An empty table gives an empty
table. Only the named id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderstream.llm.common import read, shared_dir, slices, stored
from orderstream.llm.components import components
from orderstream.llm.hashing import U, mix, shingle_set, word_hashes

LEAF, WEIGHT = 256, 1 << 21
PIVOTS, FAR = 12, 0.6
LEVELS = 8
KEYS_AT_ONCE = 1 << 21
WANTED_BITS, MARKED = 1 << 26, 32768  # MARKED: the bits of one value of Spark's bitmap aggregate
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles_of(text: str | None, size: int) -> np.ndarray:
    ws = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return shingle_set(word_hashes(ws), size)


def class_of(shingles: np.ndarray) -> bytes | None:
    return blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def arrow(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


# Families


class Sizes:
    """Classes of set sizes: linked sets are of one class or of neighbouring ones."""

    def __init__(self, percent: int) -> None:
        self.percent, self.low = percent, [1]

    def number(self, n: int) -> int:
        while self.low[-1] <= n:
            here = self.low[-1]
            self.low.append(max(here + 1, -(-here * 10_000 // (self.percent * self.percent))))
        return int(np.searchsorted(self.low, n, "right")) - 1

    def parts(self, k: int) -> tuple[int, int]:
        """How much two linked sets, of which the larger is of class k, may differ, and the number of parts for it."""
        most = self.low[k + 1] - 1
        differ = 2 * most * (100 - self.percent) // (100 + self.percent)
        return differ, differ + 2 + differ // 64

    def taken(self, n: int) -> list[int]:
        k = self.number(n)
        larger = n * 100 // self.percent
        return [k, k + 1] if self.number(larger) > k else [k]


def part_keys(shingles: np.ndarray, sizes: Sizes) -> np.ndarray:
    """The content of each part, as a hash, under each class of size it is taken for.

    There are some more parts than linked sets can differ in, so some parts of theirs are equal. Empty parts say nothing
    and are left out, unless a set has as many of them as parts are sure to be equal.
    """
    out = []
    mixed, dealt = mix(shingles + U(1)), mix(shingles ^ U(0x5BD1E995A5A5A5A5)) >> U(31)
    for k in sizes.taken(len(shingles)):
        differ, parts = sizes.parts(k)
        if not differ:
            continue  # only equal sets link, and those are one class
        at = (dealt % U(parts)).astype(np.int64)
        content, count = np.zeros(parts, U), np.bincount(at, minlength=parts)
        np.add.at(content, at, mixed)
        key = mix(mix(content + count.astype(U)) + mix(np.arange(parts, dtype=U) + (U(k + 1) << U(32))))
        out.append(key if (count == 0).sum() >= parts - differ else key[count > 0])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def profiles(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(percent)
        for batch in slices(batches):
            count, node, keys = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles_of(text, size)
                count.append(len(found))
                node.append(class_of(found))
                keys.append(part_keys(found, sizes) if len(found) else np.zeros(0, np.int64))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))
            columns = [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(node, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "node", "keys"])

    return run


def runs_of(key: np.ndarray) -> np.ndarray:
    """Where a new key begins, in sorted keys."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """The distinct pairs of different ends."""
    pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def lows(paired: bool):
    """A task's classes by the content of their parts: (key, id) of the lowest of each, or the pairs of the others with it.

    So a part that very many classes have leaves a task as one row for some millions of its keys.
    """

    def flushed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        heads = runs_of(key)
        if paired:
            return pairs_batch(ids, np.repeat(ids[heads], np.diff(np.append(heads, len(key)))))
        return pa.RecordBatch.from_arrays([pa.array(key[heads]), pa.array(ids[heads])], ["key", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys = batch.column("keys")
            size = keys.value_lengths().to_numpy()
            held.append((keys.flatten().to_numpy(), np.repeat(batch.column("id").to_numpy(), size)))
            if sum(len(k) for k, _ in held) >= KEYS_AT_ONCE:
                yield flushed(held)
                held = []
        if any(len(k) for k, _ in held):
            yield flushed(held)

    return run


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each id with the lowest of its key; rows come sorted by key and id."""
    last, low = None, None
    for batch in batches:
        if not len(batch):
            continue
        key, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        heads = runs_of(key)
        first = ids[heads].copy()
        if last is not None and key[0] == last:
            first[0] = low
        yield pairs_batch(ids, np.repeat(first, np.diff(np.append(heads, len(key)))))
        last, low = key[-1], first[-1]


def families(classes: DataFrame, folder: str) -> DataFrame:
    """(id, family) of the classes that share a part with another; id is a hash of the node, so a family may be too large."""
    routes = classes.select("keys", F.xxhash64("node").alias("id")).filter(F.size("keys") > 0)
    lowest = routes.mapInArrow(lows(False), "key long, id long").repartition("key").sortWithinPartitions("key", "id")
    pairs = routes.mapInArrow(lows(True), "a long, b long").unionByName(lowest.mapInArrow(met, "a long, b long")).distinct()
    reached = components(stored(pairs, f"{folder}/routes"), "metric-families")
    return reached.select(F.col("node").alias("id"), F.col("component").alias("family"))


STATE = ["region", "node", "anchor", "n", "shingles", "rows", "weight"]
STATE_TYPES = "region long, node binary, anchor long, n long, shingles binary, rows long, weight long"


def sets_of(wanted: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The wanted classes (node, doc_id, family, rows, weight) with their sets, from one document each: the columns STATE.

    Texts meet the ids in a shuffle; before it, a bitmap of a fixed size drops most texts that are not wanted. However
    full the bitmap is, the join decides.
    """
    ids = wanted.select("family", "node", "rows", "weight", F.col("doc_id").alias("_id"))
    bit = F.pmod(F.xxhash64("_id"), F.lit(WANTED_BITS))
    marks = ids.groupBy((bit / MARKED).cast("int").alias("n")).agg(F.bitmap_construct_agg(bit % MARKED).alias("bits"))
    bitmap = {r.n: bytes(r.bits) for r in marks.collect()}  # WANTED_BITS / 8 bytes at most
    texts = docs.select(F.xxhash64("doc_id").alias("hash"), "doc_id", "text").mapInArrow(marked(bitmap), docs.schema)
    texts = texts.join(ids, texts["doc_id"] == F.col("_id")).select("family", "node", "rows", "weight", "text")
    return texts.mapInArrow(checked(size), STATE_TYPES)


def marked(bitmap: dict[int, bytes]):
    """The rows (hash, doc_id, text) whose hash has its bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(WANTED_BITS // 8, np.uint8)
        for n, held in bitmap.items():
            bits[n * MARKED // 8 : (n + 1) * MARKED // 8] = np.frombuffer(held, np.uint8)
        for batch in batches:
            bit = batch.column("hash").to_numpy() % WANTED_BITS
            wanted = bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
            yield batch.select(["doc_id", "text"]).filter(pa.array(wanted.astype(bool)))

    return run


def checked(size: int):
    """Sets of texts that are of the class they are asked for; others of the same id are not.

    Repeated rows of an id come to one task, which takes the first; where Spark has split it, a class may come again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches):
            out = []
            for family, node, rows, weight, text in zip(*(batch.column(c).to_pylist() for c in ("family", "node", "rows", "weight", "text")), strict=True):
                if node in seen:
                    continue
                found = shingles_of(text, size)
                if class_of(found) == node:
                    seen.add(node)
                    out.append((family, node, None, len(found), found.tobytes(), rows, weight))
            yield arrow(out, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), STATE)

    return run


# Joining inside a task


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each key; rows come sorted by it."""
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
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = now
    if held:
        yield pa.concat_tables(held)


LINKS = "a binary, b binary"


def joined(percent: int, by: list[str]):
    """Links that join what is not joined yet in each region or tile, from full sets: fewer than it has rows.

    An inverted index gives a set's overlap with all others at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, by):
            yield from within(rows, percent)

    return run


def within(rows: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    nodes, anchors = rows.column("node").to_pylist(), rows.column("anchor").to_pylist()
    sets = [np.frombuffer(x, U) for x in rows.column("shingles").to_pylist()]
    first: dict[int, int] = {}
    group = np.array([i if x is None else first.setdefault(x, i) for i, x in enumerate(anchors)])
    size = np.array([len(x) for x in sets])
    owner, number = np.repeat(np.arange(len(sets)), size), np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = owner[np.argsort(number, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(number))])
    at = np.concatenate([[0], np.cumsum(size)])
    main = np.bincount(group).argmax()
    links = []
    for x in np.flatnonzero(group != main).tolist():
        mine = number[at[x] : at[x + 1]]
        both = np.zeros(len(sets), np.int64)
        for i in range(0, len(mine), 1024):
            both += np.bincount(np.concatenate([owner[start[k] : start[k + 1]] for k in mine[i : i + 1024]]), minlength=len(sets))
        ok = (both * 100 >= (size + size[x] - both) * percent) & (group != group[x])
        while ok.any():
            y = int(ok.argmax())
            links.append((nodes[x], nodes[y]))
            group[group == group[x]] = group[y]
            ok &= group != group[x]
    if links:
        yield arrow(links, (pa.binary(), pa.binary()), ["a", "b"])


# Pivots

SETTLED = "region long, child int, node binary, anchor long, n long, link binary"


def overlaps(shingles: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    out = []
    for p in pivots:
        at = np.searchsorted(p, shingles)
        at[at == len(p)] = 0
        out.append(int((p[at] == shingles).sum()))
    return np.array(out, np.int64)


def settled(percent: int):
    """For each (region, salt), whose pivots come first: the new regions of its classes, and a linked pivot if there is one.

    child: the pivot's number, that of the pivots for the far region. A guest's row has no link, so a link counts once.
    """
    radius = 1 - percent / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["region", "salt"]):
            rank = rows.column("rank").to_pylist()
            n_pivots = sum(x is not None for x in rank)
            nodes, anchors = rows.column("node").to_pylist(), rows.column("anchor").to_pylist()
            region = rows.column("region")[0].as_py()
            sets = [np.frombuffer(x, U) for x in rows.column("shingles").to_pylist()]
            pivots, names = sets[:n_pivots], nodes[:n_pivots]
            size = np.array([len(x) for x in pivots])

            def measured(s: np.ndarray, pivots=pivots, size=size) -> tuple[np.ndarray, np.ndarray]:
                both = overlaps(s, pivots)
                total = size + len(s) - both
                return 1 - both / total, both * 100 >= total * percent

            group = list(range(n_pivots))
            for i in range(n_pivots):
                for j in np.flatnonzero(measured(pivots[i])[1]).tolist():
                    low, high = sorted((group[i], group[j]))
                    group = [low if g == high else g for g in group]
            anchor_of = [int.from_bytes(names[g][:8], "little", signed=True) for g in group]
            out: list[tuple] = []
            for i in range(n_pivots, len(nodes)):
                distance, linked = measured(sets[i])
                home = int(distance.argmin())
                near = np.flatnonzero(linked)
                anchor = anchor_of[near[0]] if len(near) else anchors[i]
                link = next((names[p] for p in near.tolist() if names[p] != nodes[i]), None)
                if distance[home] > FAR:
                    children = [n_pivots]
                else:
                    window = (distance <= distance[home] + 2 * radius) & (distance <= FAR + radius)
                    window[home] = False
                    children = [home, *np.flatnonzero(window).tolist(), *([n_pivots] if distance[home] > FAR - radius else [])]
                n = len(sets[i])
                out += [(region, child, nodes[i], anchor, n, link if child == children[0] else None) for child in children]
                # a class that links to several pivots joins them: one link each
                out += [(region, None, nodes[i], None, n, names[p]) for p in near.tolist() if names[p] not in (nodes[i], link)]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield arrow(out, kinds, ["region", "child", "node", "anchor", "n", "link"])

    return run


def needed(weight: Column, rows: Column) -> Column:
    """The number of tasks or blocks for so many shingles and classes."""
    return F.greatest(F.lit(1), F.ceil(weight / WEIGHT), F.ceil(rows / (4 * LEAF))).cast("int")


def around_pivots(large: DataFrame, level: int, percent: int) -> DataFrame:
    """What settled() says of every class of the large regions."""
    first = Window.partitionBy("region").orderBy(F.col("anchor").isNotNull(), F.xxhash64("node", F.lit(level)), "node")
    salts = needed(F.col("weight"), F.col("rows"))
    columns = ["region", "node", "anchor", "shingles", "salt", "rank"]
    # A task hands on PIVOTS rows a region at most.
    pivots = large.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= PIVOTS)
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    classes = large.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).withColumn("rank", F.lit(None).cast("int"))
    dealt = pivots.select(columns).unionByName(classes.select(columns)).repartition("region", "salt")
    return dealt.sortWithinPartitions("region", "salt", F.col("rank").asc_nulls_last()).mapInArrow(settled(percent), SETTLED)


TILE = ["region", "i", "j"]


def tiled(rows: DataFrame) -> DataFrame:
    """The rows (region, node, anchor, n, shingles) once for each tile they are in.

    A region's most common anchor is its inside, all else its outside; both are dealt into blocks. A tile holds two
    blocks of which one is outside, so all pairs but those of the inside meet.
    """
    each = rows.groupBy("region", "anchor").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    top = F.max(F.when(F.col("anchor").isNotNull(), F.struct("rows", "anchor", "weight"))).alias("top")
    size = each.groupBy("region").agg(top, F.sum("rows").alias("rows"), F.sum("weight").alias("weight"))
    of_top = lambda c: F.coalesce(F.col(f"top.{c}"), F.lit(0))
    outer = needed(F.col("weight") - of_top("weight"), F.col("rows") - of_top("rows")).alias("outer")
    inner = F.when(F.col("top").isNull(), 0).otherwise(needed(of_top("weight"), of_top("rows"))).alias("inner")
    size = size.select("region", F.col("top.anchor").alias("main"), outer, inner)
    inside = F.coalesce(F.col("anchor") == F.col("main"), F.lit(False))
    dealt = F.xxhash64("node", F.lit(7))
    block = F.when(inside, F.col("outer") + F.pmod(dealt, F.greatest("inner", F.lit(1)))).otherwise(F.pmod(dealt, F.col("outer")))
    others = F.sequence(F.lit(0), F.when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)
    out = rows.join(size, "region").withColumn("block", block.cast("int")).withColumn("other", F.explode(others))
    ends = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    return out.select("region", *ends, "node", "anchor", "shingles")


def in_tasks(rows: DataFrame, by: list[str], percent: int) -> DataFrame:
    dealt = rows.select(*by, "node", "anchor", "shingles").repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(joined(percent, by), LINKS)


def region_join(state: DataFrame, percent: int, folder: str, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) that connect all classes of the regions that a chain of links connects.

    state has the columns STATE, of which rows and weight are the classes and shingles of the whole region.
    """
    small = (F.col("rows") <= leaf) & (F.col("weight") <= WEIGHT)
    sets = state.filter(~small).select("node", "n", "shingles")
    links = []
    for level in range(LEVELS):
        links.append(stored(in_tasks(state.filter(small), ["region"], percent), f"{folder}/{level}-leaves"))
        large = state.filter(~small)
        if large.isEmpty():
            break
        around = stored(around_pivots(large, level, percent), f"{folder}/{level}-around")
        links.append(around.filter("link is not null").select(F.col("node").alias("a"), F.col("link").alias("b")))
        homes = around.filter("child is not null").select("region", "child", "node", "anchor", "n")
        children = homes.groupBy("region", "child").agg(F.count("*").alias("child_rows"))
        split = children.groupBy("region").agg(F.sum("child_rows").alias("all"), F.max("child_rows").alias("most"))
        split = split.join(large.select("region", "rows").distinct(), "region")
        good = (F.col("most") <= 0.7 * F.col("rows")) & (F.col("all") <= 3 * F.col("rows")) & F.lit(level + 1 < LEVELS)
        homes = homes.join(stored(split.select("region", good.alias("good")), f"{folder}/{level}-split"), "region")
        # a class's anchor is the same in all its rows of a region
        dense = homes.filter("not good").select("region", "node", "anchor").distinct().join(sets, "node")
        links.append(stored(in_tasks(tiled(dense), TILE, percent), f"{folder}/{level}-tiles"))
        homes = homes.filter("good").withColumn("region", F.xxhash64("region", "child", F.lit(level)))
        sums = homes.groupBy("region").agg(
            F.count("*").alias("rows"), F.sum("n").alias("weight"), F.count("anchor").alias("anchored"), F.min("anchor").alias("lo"), F.max("anchor").alias("hi")
        )
        joined_already = (F.col("rows") == 1) | ((F.col("anchored") == F.col("rows")) & (F.col("lo") == F.col("hi")))
        homes = homes.join(sums.filter(~joined_already).select("region", "rows", "weight"), "region")
        state = stored(homes.drop("n").join(sets, "node").select(STATE), f"{folder}/{level}-state")
    return reduce(DataFrame.unionByName, links)


def jaccard_join(
    docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: linked where 100 * both >= percent * total."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "metric")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.mapInArrow(profiles(size, percent), f"doc_id {kind}, n_shingles long, node binary, keys array<long>"), f"{folder}/rows")
    classes = rows.filter("node is not null and doc_id is not null").groupBy("node")
    classes = classes.agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = stored(classes, f"{folder}/classes")

    of_family = families(classes, folder)
    related = classes.select("node", "doc_id", "n", F.xxhash64("node").alias("id")).join(of_family, "id")
    sums = related.groupBy("family").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    related = stored(related.join(sums, "family").select("node", "doc_id", "family", "rows", "weight"), f"{folder}/related")
    state = stored(sets_of(related, docs, size), f"{folder}/sets")
    links = stored(region_join(state, percent, folder, leaf).distinct(), f"{folder}/links")

    reached = components(links, "metric-links")
    of_node = classes.select("node", "doc_id").join(reached, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "doc_id")
    low = of_node.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = of_node.select("node", "component").join(low, "component").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", component_id)


def query(spark, folder: str) -> DataFrame:
    return jaccard_join(read(spark, folder, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d
), n AS (
  SELECT doc_id, count(g) AS n_shingles FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n_shingles + y.n_shingles - common)
), c AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a
), r AS (
  SELECT a, min(b) AS m FROM c GROUP BY a
)
SELECT doc_id, n_shingles, m AS component_id FROM n JOIN r ON a = doc_id
"""
