"""Unigram encoding and decoding with the pieces of a SentencePiece file.

A text gets a leading space, spaces become the marker U+2581, and the segmentation with the largest sum of piece scores
is found by Viterbi over a double-array trie of the pieces' bytes. A character that no piece covers costs BELOW less than
the worst piece and is written as its bytes' pieces; so is a marker that the text itself holds, which keeps decoding
exact. Of equal sums the one with the longer last piece wins. Decoding joins the pieces, turns byte pieces into bytes,
markers into spaces, and drops the leading space: encode and decode are each other's inverse for every text.

No piece spans the border before a marker, so a text is cut there and each distinct part is solved once per worker, as long
as it is among the CACHED ones. The new parts of some texts are solved side by side: all starts walk the trie at once, then
the best sums grow place by place. The trie is built on the driver and broadcast; its size is bounded by the vocabulary's. No
shuffle.

Null and empty texts have no ids; null decodes to null. Repeated rows are encoded each. An empty table gives an empty
table. Other columns pass through. A text without spaces is one part, worked off in time linear in its length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderstream.llm.common import read

MARK = "▁"
BELOW = 10.0
CACHED = 250_000
# Shorter parts are kept and solved side by side, so many bytes of them at a time, if there are so many at least.
SHORT = 64
TOGETHER = 1 << 20
FEW = 32
# Characters of texts that are cut into parts at a time.
CHARS = 1 << 20
PART = re.compile(f" +[^ {MARK}]*|[^ {MARK}]+|{MARK}+")


class DoubleArray:
    """A trie in two arrays: the child of state s by byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, entries: list[tuple[bytes, int]]):
        tree: dict = {}
        for text, value in entries:
            node = tree
            for c in text:
                node = node.setdefault(c, {})
            node[None] = value
        self.base, self.check, self.value = [0], [-1], [-1]
        low, queue = 0, [(0, tree)]
        for state, node in queue:
            self.value[state] = node.get(None, -1)
            codes = sorted(c for c in node if c is not None)
            if not codes:
                continue
            at, tries = max(0, low - codes[0]), 0
            while any(self._taken(at + c + 1) for c in codes):
                at, tries = at + 1, tries + 1
            if tries > 32:  # full enough below: never searched again
                low = at + codes[0]
            self._grow(at + 257)
            self.base[state] = at
            for c in codes:
                self.check[at + c + 1] = state
                queue.append((at + c + 1, node[c]))
        self._grow(max(self.base) + 258)

    def _taken(self, i: int) -> bool:
        return i == 0 or i < len(self.check) and self.check[i] != -1

    def _grow(self, n: int) -> None:
        more = n - len(self.check)
        if more > 0:
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more


class Model:
    """Pieces, scores and the trie of a SentencePiece file; small enough to broadcast."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        plain = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = {i: sp.id_to_piece(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in pieces.values()):
            raise ValueError("a piece holds a marker after its start")
        self.scores = [sp.get_score(i) for i in every]
        self.bytes_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        self.unknown = min(self.scores[i] for i in plain) - BELOW
        self.trie = DoubleArray([(p.encode(), i) for i, p in pieces.items()])
        self.texts = [b""] * len(self.scores)
        for i, p in pieces.items():
            self.texts[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes_ids.items():
            self.texts[i] = bytes([b])
        self.known: dict[str, bytes] = {}
        trie = self.trie
        self.arrays = tuple(np.array(x, np.int32) for x in (trie.base, trie.check, trie.value))
        self.byte_ids = np.array([self.bytes_ids[b] for b in range(256)], "<u4")

    def solve(self, part: str) -> bytes:
        """The ids of a part, as little-endian 32-bit numbers. Spaces stand for markers."""
        if part[0] == MARK:
            return np.array([self.bytes_ids[b] for b in part.encode()], "<u4").tobytes()
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        scores, data = self.scores, part.replace(" ", MARK).encode("utf-8", "surrogatepass")
        n = len(data)
        best, back, by = [-1e300] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            c = data[i]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            here, state, j, single = best[i], 0, i, False
            while j < n:
                nxt = base[state] + data[j] + 1
                if check[nxt] != state:
                    break
                state = nxt
                j += 1
                piece = value[state]
                if piece >= 0:
                    single = single or j == i + width
                    if here + scores[piece] > best[j]:
                        best[j], back[j], by[j] = here + scores[piece], i, piece
            if not single and here + self.unknown > best[i + width]:
                best[i + width], back[i + width], by[i + width] = here + self.unknown, i, -1
            i += width
        ids, j = [], n
        while j:
            i = back[j]
            if by[j] >= 0:
                ids.append(by[j])
            else:
                ids.extend(self.bytes_ids[b] for b in reversed(data[i:j]))
            j = i
        return np.array(ids[::-1], "<u4").tobytes()

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of every piece in the bytes, and of unknown characters, whose piece is -1; 0xFF is in none."""
        base, check, value = self.arrays
        at = np.flatnonzero((data & 0xC0 != 0x80) & (data != 0xFF)).astype(np.int32)
        first = data[at]
        width = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))).astype(np.int32)
        single = np.zeros(len(data), bool)
        found, length, begin, state = [], 0, at, np.zeros(len(at), np.int32)
        widths = width
        while len(begin):
            # The last byte is 0xFF, so a walk ends before it leaves the bytes.
            nxt = base[state] + data[begin + length] + 1
            goes = check[nxt] == state
            begin, state, widths, length = begin[goes], nxt[goes], widths[goes], length + 1
            piece = value[state]
            ends = piece >= 0
            found.append((begin[ends], np.full(np.count_nonzero(ends), length, np.int32), piece[ends]))
            single[begin[ends & (widths == length)]] = True
        alone = ~single[at]
        found.append((at[alone], width[alone], np.full(np.count_nonzero(alone), -1, np.int32)))
        start, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        return start, length, piece

    def solve_all(self, parts: list[str]) -> list[bytes]:
        """What `solve` gives for each part, worked off side by side; no part may hold a marker."""
        joined = b"\xff".join([p.encode("utf-8", "surrogatepass") for p in parts]) + b"\xff"
        data = np.frombuffer(joined.replace(b" ", MARK.encode()), np.uint8)
        ends = np.flatnonzero(data == 0xFF)
        begins = np.concatenate([[0], ends[:-1] + 1])
        start, length, piece = self.edges(data)
        place = (start - np.repeat(begins, ends - begins + 1)[start]).astype(np.int32)
        order = np.argsort(place, kind="stable")
        start, length, piece, place = start[order], length[order], piece[order], place[order]
        score = np.where(piece < 0, self.unknown, np.array(self.scores)[piece])
        best, back, by = np.full(len(data), -1e300), np.zeros(len(data), np.int32), np.full(len(data), -1, np.int32)
        best[begins] = 0.0
        bounds = np.searchsorted(place, np.arange(place[-1] + 2))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            # All edges from one place of their parts: no two of them end at the same byte. Earlier starts win ties.
            i = start[low:high]
            j, total = i + length[low:high], best[i] + score[low:high]
            better = total > best[j]
            j = j[better]
            best[j], back[j], by[j] = total[better], i[better], piece[low:high][better]
        ids, kept, j = np.zeros(len(data), "<u4"), np.zeros(len(data), bool), ends
        first = begins
        while len(j):
            i, last = back[j], by[j]
            known = last >= 0
            ids[i[known]], kept[i[known]] = last[known], True
            spelt, stop = i[~known], j[~known]
            while len(spelt):
                ids[spelt], kept[spelt] = self.byte_ids[data[spelt]], True
                spelt, stop = spelt[spelt + 1 < stop] + 1, stop[spelt + 1 < stop]
            more = i > first
            j, first = i[more], first[more]
        out = ids[kept].tobytes()
        sizes = np.cumsum(np.concatenate([[0], np.add.reduceat(kept, begins, dtype=np.int64)])) * 4
        return [out[a:b] for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]

    def learn(self, parts: set[str]) -> list[str]:
        """Solves what is not known yet; returns the parts that are not to be kept."""
        new = parts - self.known.keys()
        alone = new if len(new) < FEW else [p for p in new if len(p) >= SHORT or p[0] == MARK]
        together = [] if len(new) < FEW else [p for p in new if len(p) < SHORT and p[0] != MARK]
        for part in alone:
            self.known[part] = self.solve(part)
        step = TOGETHER // SHORT
        for at in range(0, len(together), step):
            some = together[at : at + step]
            self.known.update(zip(some, self.solve_all(some), strict=True))
        return [p for p in alone if len(p) >= SHORT]

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        at = 0
        while at < len(texts):
            cut, chars = [], 0
            while at < len(texts) and (not cut or chars + len(texts[at] or "") <= CHARS):
                text = texts[at] or ""
                cut.append(parts_of(text))
                chars, at = chars + len(text), at + 1
            if len(self.known) > CACHED:
                self.known.clear()
            passing = self.learn(set().union(*cut))
            yield from [b"".join(map(self.known.__getitem__, parts)) for parts in cut]
            for part in passing:
                del self.known[part]

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray) -> str:
        texts = self.texts
        return b"".join([texts[i] for i in ids.tolist()])[1:].decode("utf-8", "surrogatepass")


def parts_of(text: str) -> list[str]:
    """The text with a leading space, cut before markers; an empty one has no part."""
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
        return PART.findall(f" {text}")
    return [f" {w}" for w in text.split(" ")]


def shape_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encoded(docs: DataFrame, path: str, text_col: str = "text", name: str = "ids") -> DataFrame:
    """The documents with an array of piece ids; null text has a null array."""
    held = docs.sparkSession.sparkContext.broadcast(Model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            data = list(model.encode_all(texts))
            sizes = np.array([0, *(len(x) // 4 for x in data)])
            ends = pa.array(np.cumsum(sizes).astype(np.int32))
            ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(data), "<i4")))
            ids = pa.compute.if_else(batch.column(text_col).is_valid(), ids, pa.scalar(None, ids.type))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, name])

    return docs.mapInArrow(run, f"{shape_of(docs)}, `{name}` array<int>")


def decoded(docs: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """The documents with the text of their ids."""
    held = docs.sparkSession.sparkContext.broadcast(Model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = [None if x is None else model.decode(np.array(x, np.int64)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return docs.mapInArrow(run, f"{shape_of(docs)}, `{name}` string")


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of ids and of byte pieces, the ids' CRC-32, and whether decoding gives the text back."""
    held = docs.sparkSession.sparkContext.broadcast(Model(path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        is_byte = np.zeros(len(model.scores), bool)
        is_byte[list(model.bytes_ids.values())] = True
        for batch in batches:
            out = []
            texts = batch.column("text").to_pylist()
            for text, data in zip(texts, model.encode_all(texts), strict=True):
                ids = np.frombuffer(data, "<u4")
                out.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(data), model.decode(ids) == (text or "")))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "round_trip"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean")


def query(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return digest(read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
