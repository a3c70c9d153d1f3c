"""Language-model scoring by context-tree weighting over bytes.

A text is one stream of bytes: each word and a closing blank, then the end. Every byte is eight binary decisions, and each
decision has a context tree over the DEPTH bytes before it, across words; before the text lie ends. A node's
Krichevsky-Trofimov estimate is mixed half and half with what its children say, at all depths. A decision's probability
mixes the estimates along its path with the weights the training text has given them, down to the deepest context seen. All
of it is one distribution over texts, so score is log10 of a probability, and -score / log10(2) bits over the bytes is the
code length per byte.

Documents become chunks of word numbers with their vocabulary (a stored table). For the base, the vocabularies leave in blocks,
one for each bucket of the words' hashes, whose task adds up the counts and answers the blocks. A chunk's distinct keys (context and byte, the latest byte first) leave it in blocks, one for each
bucket of the last three context bytes, with their training counts. A bucket's blocks add up to its part of the trees: all
below depth 2. The nodes of depth 2 (pairs of bytes that follow each other in UTF-8, times 255 decisions: fewer than 2^24
at any size) are summed by Spark and go to every task. Each bucket then prices its keys and answers the chunks' blocks. All
answers meet their chunk in one shuffle, where they are read one by one, and the chunk adds up its documents. The number of
buckets follows the bytes.

Null and wordless texts have the end alone. Rows with a null id train (unless held out is true) and are scored each.
Repeated rows count as often as they come. An empty table gives an empty table; without training rows every decision is
even. Very long texts are spread over several chunks, whose contexts go on. Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderstream.llm.common import read, shared_dir, stored
from orderstream.llm.near import words_of

DEPTH = 6
TOP = 2  # nodes down to this depth are known to every task
CHUNK = 24 << 20  # bytes in a chunk
SLICE = 1 << 19  # bytes worked on at a time
PER_BUCKET = 8 << 20  # bytes of text for each bucket of contexts
END = b""  # the end token among the words; no word is empty
CLOSE, STOP = b" ", b"\n"
START = STOP * DEPTH
EARLIER = np.uint64((1 << 8 * DEPTH) - 1 << 8)
AT_ONCE = 20_000
ANSWERS = 16  # answers that go to Python in one batch
HALF = math.log(0.5)


def spelled(word: bytes) -> bytes:
    return word + CLOSE if word else STOP


def parts_of(ws: list[bytes], room: int) -> Iterator[tuple[bytes, list[bytes]]]:
    """A text's words in parts of about room bytes, each with the DEPTH bytes before it."""
    if ws and sum(map(len, ws)) + len(ws) <= room:
        yield START, ws
        return
    at, lead = 0, START
    while at < len(ws):
        end, size = at, 0
        while end < len(ws) and (end == at or size + len(ws[end]) < room):
            size += len(ws[end]) + 1
            end += 1
        part = ws[at:end]
        yield lead, part
        lead = (lead + b"".join(map(spelled, part[-DEPTH:])))[-DEPTH:]
        at = end


def chunks(room: int):
    """Chunks of documents: row numbers, tokens as places in the chunk's vocabulary, the vocabulary's training counts."""
    return lambda batches: chunked(batches, room)


def chunked(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.RecordBatch]:
    number = row = TaskContext.get().partitionId() << 36
    place: dict[bytes, int] = {}
    info: list[tuple[int, object, bool, int, bytes]] = []
    tokens: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal place, info, tokens, held, number
        every = np.concatenate(tokens)
        trains = np.repeat(np.array([not x[2] for x in info]), [x[3] for x in info])
        counts = np.bincount(every[trains], minlength=len(place))
        batch = pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array([number], pa.int64()),
                "bytes": pa.array([held], pa.int64()),
                "docs": pa.array([[{"row": r, "doc_id": d, "held_out": h, "n": n, "lead": x} for r, d, h, n, x in info]], kind),
                "tokens": pa.array([packed(every.astype("<i4"))], pa.binary()),
                "vocabulary": pa.array([packed_words(place)], pa.binary()),
                "counts": pa.array([packed(counts)], pa.binary()),
            }
        )
        place, info, tokens, held, number = {}, [], [], 0, number + 1
        return batch

    for batch in batches:
        kind = pa.list_(
            pa.struct([("row", pa.int64()), ("doc_id", batch.schema.field("doc_id").type), ("held_out", pa.bool_()), ("n", pa.int32()), ("lead", pa.binary())])
        )
        for doc, out, text in zip(*(batch.column(c) for c in ("doc_id", "held_out", "text")), strict=True):
            for lead, part in parts_of([*words_of(text.as_py()), END], room):
                tokens.append(np.fromiter((place.setdefault(w, len(place)) for w in part), np.int32, len(part)))
                info.append((row, doc.as_py(), out.as_py(), len(part), lead))
                held += sum(map(len, part)) + len(part)
                if held >= room:
                    yield flush()
            row += 1
    if tokens:
        yield flush()


class Chunk:
    """A chunk's byte stream, from its vocabulary and tokens."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.docs = batch.column("docs")[i].values
        self.tokens = unpacked(batch.column("tokens")[i].as_py(), "<i4")
        self.n = self.docs.field("n").to_numpy()
        self.first = np.cumsum(self.n) - self.n
        self.words = batch.column("vocabulary")[i].as_py()

    def keys(self, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(key, document's place) of all bytes, a slice at a time. A key: the byte before highest, the one before that
        next, ..., the byte itself lowest."""
        leads = self.docs.field("lead").to_pylist()
        distinct = {x: k for k, x in enumerate(dict.fromkeys(leads))}
        words = unpacked_words(self.words)
        known = len(words)
        spelling = pa.array([*map(spelled, words), *distinct], pa.binary())
        size = pc.binary_length(spelling).to_numpy()
        lead = np.array([known + distinct[x] for x in leads], np.int32)
        del words, leads, distinct
        tokens = np.insert(self.tokens, self.first, lead)
        doc = np.repeat(np.arange(len(lead), dtype=np.int32), self.n + 1)
        ends = np.cumsum(size[tokens], dtype=np.int64)
        reach = DEPTH + 1
        for a in range(0, int(ends[-1]) if len(ends) else 0, piece):
            low, high = max(0, a - reach), min(int(ends[-1]), a + piece)
            t = slice(int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high - 1, "right")) + 1)
            part, begin = tokens[t], ends[t] - size[tokens[t]]
            # Every byte with the reach bytes before it is one number, the byte itself highest.
            data = np.zeros(reach + high - low, np.uint8)
            data[reach:] = np.frombuffer(spelling.take(pa.array(part)).buffers()[2], np.uint8)[low - begin[0] : high - begin[0]]
            run = np.ndarray(high - a, "<u8", data, a - low, (1,))
            key = (run & EARLIER | run >> np.uint64(8 * reach)).view(np.int64)
            each = np.maximum(np.minimum(ends[t], high) - np.maximum(begin, a), 0)
            keep = np.repeat(part < known, each)
            yield key[keep], np.repeat(doc[t], each)[keep]

    def distinct(self, piece: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, sorted, with their training counts."""
        trains = ~self.docs.field("held_out").to_numpy(zero_copy_only=False)
        held, waiting = [], 0
        for key, doc in self.keys(piece):
            marked = np.sort(key << 1 | trains[doc])
            key = marked >> 1
            first = np.flatnonzero(np.diff(key, prepend=-1))
            if len(first):
                held.append((key[first], np.add.reduceat(marked & 1, first).astype(np.int32)))
                waiting += len(first)
            if waiting > 2 * SLICE:
                held, waiting = [summed(held)], 0
        return summed(held)


def packed(values: np.ndarray) -> bytes:
    """Numbers as bytes, byte by byte of all of them."""
    flat = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_words(words) -> bytes:
    """Words, none of which has a blank."""
    return zstandard.ZstdCompressor(level=1).compress(CLOSE.join(words))


def unpacked_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(CLOSE)


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=0))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<i8"))


def summed(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts, from sorted blocks; the list is emptied.

    The blocks meet range by range of their keys, so that what a sort needs is held for one range at a time.
    """
    if len(blocks) == 1:
        return blocks.pop()
    longest = max((key for key, _ in blocks), key=len)
    edges = np.unique(longest[SLICE // 2 :: SLICE // 2])
    cuts = [[0, *np.searchsorted(key, edges), len(key)] for key, _ in blocks]
    out = [joined([(key[c[i] : c[i + 1]], count[c[i] : c[i + 1]]) for (key, count), c in zip(blocks, cuts, strict=True)]) for i in range(len(edges) + 1)]
    del longest
    blocks.clear()
    keys, counts = (list(x) for x in zip(*out, strict=True))
    del out
    key = np.concatenate(keys)
    del keys
    return key, np.concatenate(counts)


def joined(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, count = (np.concatenate(x) for x in zip(*blocks, strict=True))
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(count, first, dtype=count.dtype)


def words_by_bucket(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets of words in turn, each with the places of the words that are in it."""
    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) * buckets >> 32
    order = np.argsort(bucket, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(bucket[order[a]]), order[a:b]


def told(buckets: int):
    """Blocks of a chunk's words with their training counts, one for each bucket of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, vocabulary, counts in zip(*(batch.column(c) for c in ("chunk", "vocabulary", "counts")), strict=True):
                words, count = unpacked_words(vocabulary.as_py()), unpacked(counts.as_py(), "<i8")
                blocks = [(b, number.as_py(), packed_words([words[i] for i in at.tolist()]), packed(count[at])) for b, at in words_by_bucket(words, buckets)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), BLOCK_TYPES, strict=True)], ["bucket", "chunk", "words", "counts"]
                )

    return run


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words' counts over all chunks for every chunk's block, and a row of the bucket's sums; rows are sorted by bucket."""
    place: dict[bytes, int] = {}
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    now = None

    def flush() -> pa.RecordBatch:
        total = np.zeros(len(place), np.int64)
        for _, at, count in held:
            total[at] += count  # a block has a word once
        rows = [(now, None, None, int(total.sum()), int(np.count_nonzero(total)))]
        rows += [(now, number, packed(total[at]), None, None) for number, at, _ in held]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), COUNT_TYPES, strict=True)], list(COUNT_NAMES))

    for batch in batches:
        for bucket, number, words, counts in zip(*(batch.column(c) for c in ("bucket", "chunk", "words", "counts")), strict=True):
            if held and bucket.as_py() != now:
                yield flush()
                place, held = {}, []
            now, ws = bucket.as_py(), unpacked_words(words.as_py())
            at = np.fromiter((place.setdefault(w, len(place)) for w in ws), np.int32, len(ws))
            held.append((number.as_py(), at, unpacked(counts.as_py(), "<i8")))
    if held:
        yield flush()


COUNT_NAMES = ("bucket", "chunk", "counts", "total", "known")
COUNT_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]


def by_bucket(key: np.ndarray, buckets: int) -> Iterator[tuple[int, list[slice]]]:
    """The buckets of sorted keys in turn, each with the stretches of keys that are in it."""
    cuts = np.append(np.flatnonzero(np.diff(key >> 8 * (DEPTH - TOP), prepend=-1)), len(key))
    bucket = bucket_of(key[cuts[:-1]], buckets)
    for b in np.unique(bucket):
        yield int(b), [slice(cuts[i], cuts[i + 1]) for i in np.flatnonzero(bucket == b)]


def asked(buckets: int, piece: int):
    """Blocks of a chunk's distinct keys with their training counts, one for each bucket of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                key, count = Chunk(batch, i).distinct(piece)
                number = batch.column("chunk")[i].as_py()
                blocks = [
                    (b, number, packed_keys(np.concatenate([key[x] for x in within])), packed(np.concatenate([count[x] for x in within])))
                    for b, within in by_bucket(key, buckets)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), BLOCK_TYPES, strict=True)], ["bucket", "chunk", "keys", "counts"]
                )

    return run


BLOCK_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    root = key >> 8 * (DEPTH - TOP)
    return ((root * 0x9E3779B1 & 0xFFFFFFFF) * buckets) >> 32


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's blocks as one; rows are sorted by bucket."""
    held, waiting, now = [], 0, None

    def flush() -> pa.RecordBatch:
        key, count = summed(held)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([packed_keys(key)]), pa.array([packed(count)])], ["bucket", "keys", "counts"])

    for batch in batches:
        for bucket, keys, counts in zip(*(batch.column(c) for c in ("bucket", "keys", "counts")), strict=True):
            if held and bucket.as_py() != now:
                yield flush()
                held, waiting = [], 0
            now = bucket.as_py()
            held.append((unpacked_keys(keys.as_py()), unpacked(counts.as_py(), "<i4").astype(np.int64)))
            waiting += len(held[-1][0])
            if waiting > 4 * SLICE:
                held, waiting = [summed(held)], 0
    if held:
        yield flush()


def log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The Krichevsky-Trofimov probability of all zeros and ones of a node, as a natural logarithm."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class Level:
    """Nodes of one depth: counts, the weighted probability and the share of their own estimate in it."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.n0, self.n1 = n0, n1
        own = log_estimate(n0, n1)
        self.weighted = own if below is None else np.logaddexp(HALF + own, HALF + below)
        self.share = np.ones(len(n0)) if below is None else np.exp(HALF + own - self.weighted)

    def added(self, up: np.ndarray, n: int) -> list[np.ndarray]:
        """Counts and weighted probabilities summed into the n nodes above."""
        return [np.bincount(up, weights=x, minlength=n) for x in (self.n0, self.n1, self.weighted)]

    def mixed(self, at: np.ndarray, bit: np.ndarray, deeper: np.ndarray | None, seen: np.ndarray | None):
        n0, n1 = self.n0[at], self.n1[at]
        own = (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1.0)
        out = own if deeper is None else np.where(seen, self.share[at] * own + (1 - self.share[at]) * deeper, own)
        return out, n0 + n1 > 0


def decisions(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The node (of the byte's eight) and the bit of every key's eight decisions."""
    byte, k = key & 255, np.arange(8)
    return ((1 << k)[None, :] | byte[:, None] >> (8 - k)[None, :]).ravel(), (byte[:, None] >> (7 - k)[None, :] & 1).ravel()


def above(ids: np.ndarray) -> np.ndarray:
    """The nodes one depth up: without the earliest context byte."""
    return ids >> 16 << 8 | ids & 255


def subtree(key: np.ndarray, count: np.ndarray):
    """Decisions of all keys and the levels DEPTH to below TOP over them, with each decision's place in every level."""
    node, bit = decisions(key)
    weight = np.repeat(count, 8).astype(float)
    ids, at = np.unique(np.repeat(key >> 8 << 8, 8) | node, return_inverse=True)
    n1 = np.bincount(at, weights=weight * bit, minlength=len(ids))
    levels = [(Level(np.bincount(at, weights=weight, minlength=len(ids)) - n1, n1, None), at)]
    for _ in range(DEPTH - 1, TOP, -1):
        level = levels[-1][0]
        ids, up = np.unique(above(ids), return_inverse=True)
        at = up[at]
        levels.append((Level(*level.added(up, len(ids))), at))
    return node, bit, levels, ids


def pieces(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole subtrees below TOP + 1 context bytes, many at once."""
    root = keys >> 8 * (DEPTH - TOP)
    cuts = [*np.flatnonzero(np.diff(root, prepend=-1)), len(keys)]
    a = 0
    for b, c in zip(cuts[1:], [*cuts[2:], math.inf], strict=True):
        if c - a > AT_ONCE:
            yield keys[a:b], counts[a:b]
            a = b


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for bucket, keys, counts in chain.from_iterable(zip(*(b.column(c) for c in ("bucket", "keys", "counts")), strict=True) for b in batches):
        yield bucket.as_py(), unpacked_keys(keys.as_py()), unpacked(counts.as_py(), "<i8")


def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For nodes of depth TOP, sums over their children in this bucket."""
    for _, keys, counts in blocks_of(batches):
        for key, count in pieces(keys, counts):
            _, _, levels, ids = subtree(key, count)
            found, up = np.unique(above(ids), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, levels[-1][0].added(up, len(found)))], ["id", "n0", "n1", "weighted"])


class Top:
    """The nodes of depth TOP and above."""

    def __init__(self, ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, weighted: np.ndarray):
        self.ids, self.levels = ids, [(Level(n0, n1, weighted), None)]
        for _ in range(TOP):
            level = self.levels[-1][0]
            ids, up = np.unique(above(ids), return_inverse=True)
            self.levels.append((Level(*level.added(up, len(ids))), up))
        for level, _ in self.levels:
            del level.weighted

    def mixed(self, key: np.ndarray, node: np.ndarray, bit: np.ndarray, value: np.ndarray, seen: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ids, np.repeat(key >> 8 * (DEPTH + 1 - TOP), 8) << 8 | node)
        for level, up in self.levels:
            at = at if up is None else up[at]
            value, seen = level.mixed(at, bit, value, seen)
        return value


def priced(top):
    """log10 of the probability of every key's byte in its context. top: the broadcast upper nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, keys, counts in blocks_of(batches):
            prices = []
            for key, count in pieces(keys, counts):
                node, bit, levels, _ = subtree(key, count)
                value = seen = None
                for level, at in levels:
                    value, seen = level.mixed(at, bit, value, seen)
                value = top.value.mixed(key, node, bit, value, seen)
                prices.append(np.log10(value).reshape(-1, 8).sum(1).astype(np.float32))
            arrays = [pa.array([bucket], pa.int32()), pa.array([packed_keys(keys)]), pa.array([packed(np.concatenate(prices))])]
            yield pa.RecordBatch.from_arrays(arrays, ["bucket", "keys", "prices"])

    return run


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prices of the chunks' blocks; rows are sorted by bucket, the one with its prices (no chunk) first."""
    known = price = None
    for batch in batches:
        out = []
        for bucket, chunk, keys, prices in zip(*(batch.column(c) for c in ("bucket", "chunk", "keys", "prices")), strict=True):
            if not chunk.is_valid:
                known, price = unpacked_keys(keys.as_py()), unpacked(prices.as_py(), "<f4")
            else:
                out.append((bucket.as_py(), chunk.as_py(), keys.as_py(), packed(price[np.searchsorted(known, unpacked_keys(keys.as_py()))])))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(BLOCK_TYPES)], ["bucket", "chunk", "keys", "prices"])


def scored(total: int, distinct: int, piece: int, buckets: int):
    """Sums over every document's tokens and bytes. Rows are sorted by chunk: the chunk, then the answers to its blocks."""

    def sums(chunk: Chunk, c: np.ndarray, asked: list[np.ndarray], prices: list[np.ndarray]) -> pa.RecordBatch:
        base = np.log10((c + 1) / (total + distinct + 1))
        sums = [np.add.reduceat(x[chunk.tokens], chunk.first) for x in ((c > 0).astype(np.int64), base)]
        del c, base
        known = np.concatenate(asked)
        asked.clear()
        order = np.argsort(known)
        known, price = known[order], np.concatenate(prices)[order]
        prices.clear()
        del order
        score = np.zeros(len(chunk.n))
        for key, doc in chunk.keys(piece):
            if len(key):
                order = np.argsort(key)
                at = np.searchsorted(known, key[order])
                sub = np.bincount(doc[order] - doc[0], weights=price[at])
                score[doc[0] : doc[0] + len(sub)] += sub
        docs = chunk.docs
        return pa.RecordBatch.from_arrays(
            [docs.field("row"), docs.field("doc_id"), docs.field("held_out"), pa.array(chunk.n.astype(np.int64)), *map(pa.array, [*sums, score])],
            ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, asked, prices = None, [], []
        for batch in batches:
            for i in range(len(batch)):
                if batch.column("tokens")[i].is_valid:
                    if chunk is not None:
                        yield sums(chunk, c, asked, prices)
                    chunk = Chunk(batch, i)
                    words = unpacked_words(chunk.words)
                    c, place = np.zeros(len(words), np.int64), dict(words_by_bucket(words, buckets))
                    del words
                elif batch.column("counts")[i].is_valid:
                    c[place.pop(batch.column("bucket")[i].as_py())] = unpacked(batch.column("counts")[i].as_py(), "<i8")
                else:
                    asked.append(unpacked_keys(batch.column("keys")[i].as_py()))
                    prices.append(unpacked(batch.column("prices")[i].as_py(), "<f4"))
        if chunk is not None:
            yield sums(chunk, c, asked, prices)

    return run


def word_counts(held: DataFrame, folder: str, buckets: int) -> DataFrame:
    """(bucket, chunk, counts): the counts of each chunk's words over all, in blocks; without a chunk, a bucket's sums."""
    blocks = held.select("chunk", "vocabulary", "counts").mapInArrow(told(buckets), "bucket int, chunk long, words binary, counts binary")
    dealt = blocks.repartition("bucket").sortWithinPartitions("bucket")
    return stored(dealt.mapInArrow(counted, "bucket int, chunk long, counts binary, total long, known long"), f"{folder}/words", at_once=ANSWERS)


def key_prices(held: DataFrame, folder: str, piece: int, buckets: int) -> DataFrame:
    """(bucket, chunk, keys, prices): what the keys of each chunk cost, in blocks."""
    spark = held.sparkSession
    blocks = stored(held.select("chunk", "docs", "tokens", "vocabulary").mapInArrow(asked(buckets, piece), BLOCKS), f"{folder}/blocks", at_once=1)
    dealt = blocks.select("bucket", "keys", "counts").repartition("bucket").sortWithinPartitions("bucket")
    trees = stored(dealt.mapInArrow(totals, "bucket int, keys binary, counts binary"), f"{folder}/trees")
    sums = trees.mapInArrow(tops, "id long, n0 double, n1 double, weighted double")
    sums = sums.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "weighted")]).toArrow().sort_by("id")
    top = spark.sparkContext.broadcast(Top(*(sums[c].to_numpy() for c in ("id", "n0", "n1", "weighted"))))
    prices = trees.mapInArrow(priced(top), "bucket int, keys binary, prices binary").withColumn("chunk", F.lit(None).cast("long"))
    meeting = prices.unionByName(blocks.select("bucket", "chunk", "keys", F.lit(None).cast("binary").alias("prices")))
    meeting = meeting.repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_first("chunk")).select("bucket", "chunk", "keys", "prices")
    return meeting.mapInArrow(answered, "bucket int, chunk long, keys binary, prices binary")


BLOCKS = "bucket int, chunk long, keys binary, counts binary"


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Base and context-tree scores of every document.

    held_out: a boolean column, true where a row does not train. chunk: bytes in a chunk; scores do not depend on it.
    """
    piece = min(chunk, SLICE)
    folder = shared_dir(docs.sparkSession, "weighting")
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = (
        f"chunk long, bytes long, docs array<struct<row:bigint,doc_id:{kind},held_out:boolean,n:int,lead:binary>>, tokens binary,"
        " vocabulary binary, counts binary"
    )
    held = stored(rows.mapInArrow(chunks(chunk), shape), f"{folder}/chunks")
    buckets = max(64, (held.agg(F.sum("bytes")).first()[0] or 0) // PER_BUCKET)
    counts = word_counts(held, folder, buckets)
    total, distinct = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "known")]).first()
    ready = held.select("chunk", F.lit(0).alias("turn"), "docs", "tokens", "vocabulary")
    for answers in (counts.where("chunk is not null").select("chunk", "bucket", "counts"), key_prices(held, folder, piece, buckets)):
        ready = ready.unionByName(answers.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    ready = ready.repartition("chunk").sortWithinPartitions("chunk", "turn")
    stats = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    parts = stored(ready.mapInArrow(scored(int(total), int(distinct), piece, buckets), stats), f"{folder}/parts", at_once=ANSWERS)
    out = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"),
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")],
    )
    return out.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score"
    )


def query(spark, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score(read(spark, folder, "documents"), held_out)
