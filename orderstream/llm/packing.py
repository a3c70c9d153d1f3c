"""Cost-balanced packing of tokenized documents into sequences of a fixed length.

A task works off its documents in shards of about SHARD tokens. A document costs its length plus a quadratic share for
attention. Parts as long as a sequence get one of their own; the rest, longest first, go to the sequence of the lowest
cost so far that has room. What fits nowhere is cut over the room that is left, cheapest sequences first. The last
tokens of a shard fill sequences of powers of two, which need no padding, so nothing is padded at all.

Tokens come from a word cache where the tokenizer's own description says that it normalizes and splits like SPLITTING:
then no token crosses white space or the end of a run of letters, each distinct run between ASCII spaces is tokenized
once, and a text's ids are its words' ids joined. Runs of letters go to the vocabulary's model itself. Any other
tokenizer is given whole texts. No shuffle; sequence numbers carry the partition's.

Null and empty texts have the end token alone. Rows are taken as they come; repeated rows and ids are packed each.
An empty table gives an empty table. Only the named columns are read. A text longer than a shard makes its own.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderstream.llm.common import read

LENGTH = 2048
END = 1
SHARD = 1 << 20
CACHED = 1_500_000
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

# The description of a tokenizer that lower-cases and splits at white space, letters, digits and other signs.
SPLITTING = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
TAIL = string.punctuation
LONGEST_KEPT = 64
# The model's spelling of a byte: itself where it can be printed, otherwise the next free character from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLING = dict.fromkeys(range(256)) | {c: c for c in _PRINTED}
SPELLING |= {c: 256 + i for i, c in enumerate(c for c in range(256) if SPELLING[c] is None)}

_tokenizers: dict[str, Words] = {}


class Words:
    """A tokenizer with the ids of the words it has met, as little-endian 32-bit numbers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.letters: dict[str, bytes] = {}
        described = json.loads(self.tokenizer.to_str())
        self.by_word = all(described[k] == v for k, v in SPLITTING.items()) and not described["model"]["dropout"]
        self.special = [t["content"] for t in described["added_tokens"]]

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def run_of_letters(self, run: str) -> bytes | None:
        """The ids of a run of letters and nothing else; None if normalizing makes something else of it."""
        run = run.lower() if run.isascii() else self.tokenizer.normalizer.normalize_str(run)
        found = self.letters.get(run)
        if found is None and run.isalpha():
            spelled = run if run.isascii() else run.encode().decode("latin-1").translate(SPELLING)
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
            if len(run) <= LONGEST_KEPT:
                self.letters[run] = found
        return found

    def run_of_signs(self, run: str) -> bytes:
        found = self.known.get(run)
        if found is None:
            found = self.whole([run])[0]
            if len(run) <= LONGEST_KEPT:
                self.known[run] = found
        return found

    def learn(self, words: set[str]) -> None:
        """Adds the ids of words that are not known."""
        rest = []
        for word in words:
            core = word.rstrip(TAIL)
            ids = self.run_of_letters(core) if core.isalpha() else None
            if ids is None:
                rest.append(word)
            else:
                self.known[word] = ids + self.run_of_signs(word[len(core) :]) if len(core) < len(word) else ids
        for at in range(0, len(rest), 8192):
            part = rest[at : at + 8192]
            self.known.update(zip(part, self.whole(part), strict=True))

    def forget(self, words: set[str]) -> None:
        """Very long ones among the words, and everything once too much is kept."""
        for word in words:
            if len(word) > LONGEST_KEPT:
                del self.known[word]
        if len(self.known) + len(self.letters) > CACHED:
            self.known, self.letters = {"": b""}, {}


def tokenizer(path: str):
    return Words.of(path).tokenizer


def spaced(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return text.split(" ")


def encoded(texts: list[str | None], path: str) -> list[bytes]:
    """Each text's ids and the end token, as little-endian 32-bit numbers."""
    words = Words.of(path)
    end = np.array([END], "<u4").tobytes()
    if not words.by_word:
        return [ids + end for ids in words.whole([x or "" for x in texts])]
    # A special token's own text may hold white space or touch a word.
    special = {i for i, x in enumerate(texts) if x and any(t in x for t in words.special)}
    split = [spaced(x) if x and i not in special else [] for i, x in enumerate(texts)]
    new = set(chain.from_iterable(split)).difference(words.known)
    words.learn(new)
    out = [b"".join(map(words.known.__getitem__, ws)) + end for ws in split]
    words.forget(new)
    for i in special:
        out[i] = words.whole([texts[i]])[0] + end
    return out


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def packed(sizes: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of these token counts."""
    total = int(sizes.sum())
    full, rest = divmod(total, length)
    room = np.array([length] * full + [1 << b for b in range(length.bit_length(), -1, -1) if rest >> b & 1], np.int64)
    spent, used, out = np.zeros(len(room)), np.zeros(len(room), np.int64), []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        out.append((doc, start, n, seq, int(used[seq])))
        used[seq] += n
        room[seq] -= n
        spent[seq] += cost(n)

    items, taken = [], 0
    for doc, size in enumerate(sizes.tolist()):
        whole = size // length
        for i in range(whole):
            put(doc, i * length, length, taken)
            taken += 1
        if size > whole * length:
            items.append((size - whole * length, doc, whole * length))
    items.sort(key=lambda x: (-x[0], x[1]))
    left = []
    for n, doc, start in items:
        price = np.where(room >= n, spent, np.inf)
        seq = int(price.argmin()) if len(price) else 0
        if len(price) and np.isfinite(price[seq]):
            put(doc, start, n, seq)
        else:
            left.append((n, doc, start))
    open_ = [s for s in np.argsort(spent, kind="stable").tolist() if room[s]]
    at = 0
    for n, doc, start in left:
        while n:
            seq = open_[at]
            m = min(n, int(room[seq]))
            put(doc, start, m, seq)
            start, n = start + m, n - m
            at += not room[seq]
    return out


def sequences(path: str, length: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        ids: list = []
        tokens: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, ids, tokens, held
            sizes = np.array([len(x) // 4 for x in tokens], np.int64)
            rows = packed(sizes, length)
            doc, start, n, seq, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            crc = [zlib.crc32(memoryview(tokens[d])[4 * s : 4 * (s + m)]) for d, s, m, _, _ in rows]
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, batches_type).take(pa.array(doc)), pa.array(start), pa.array(n), pa.array(crc, pa.int64()),
                    pa.array(sizes[doc]), pa.array(seq + first), pa.array(offset),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            first += int(seq.max()) + 1
            ids, tokens, held = [], [], 0
            return batch

        for batch in batches:
            batches_type = batch.schema.field("doc_id").type
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                for name, piece in zip(names[at : at + 256], encoded(texts[at : at + 256], path), strict=True):
                    ids.append(name)
                    tokens.append(piece)
                    held += len(piece) // 4
                    if held >= shard:
                        yield flush()
        if tokens:
            yield flush()

    return run


def pack(
    docs: DataFrame, path: str, length: int = LENGTH, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each piece. path: a tokenizer file that every executor can open; length: a power of two."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(sequences(path, length, shard), shape)


def query(spark, folder: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
