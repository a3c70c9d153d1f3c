"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram binds its letters: the first
rotated by two, the second by one, the third as it is, multiplied. A text bundles (adds) its trigrams; a language's
prototype bundles all its training texts. A document gets the language of the prototype with the largest cosine.
Word edges count as a letter of their own; case does not matter.

Training sums prototypes over all labelled texts, one partial vector a task; only languages x DIM numbers reach the
driver. Prediction sees text alone.

Null text and text without a letter: `und`, score 0. Rows with a null language do not train. Ties go to the language
that sorts first. Repeated rows are each predicted (and each train). Without any training row all documents are `und`.
Texts are worked off in pieces that overlap by two characters, and trigrams in blocks, so neither very long texts nor large
alphabets need more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderstream.llm.common import few_at_once, read, slices

DIM = 1024
PIECE = 1 << 19
CELLS = 1 << 23  # counts (document x trigram) held at a time
DENSE = 96  # an alphabet up to this size is counted by position, a larger one by sorting
UNDETERMINED = "und"


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@cache
def letter_vector(code: int) -> np.ndarray:
    return (np.random.default_rng([77, code]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.int8)


def trigram_vectors(a: np.ndarray, b: np.ndarray, c: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """One row for each trigram of alphabet positions (a, b, c)."""
    base = np.stack([letter_vector(int(x)) for x in codes])
    return np.roll(base, 2, 1)[a] * np.roll(base, 1, 1)[b] * base[c]


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (row, piece of text) of about PIECE characters."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        text = f" {text.lower()} "
        for at in range(0, len(text), PIECE):
            part = text[max(0, at - 2) : at + PIECE]
            rows.append(row)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def counted(parts: list[str], groups: np.ndarray, n_groups: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Trigram counts of each group (group x trigram), and the trigrams' vectors, in blocks of trigrams.

    groups: of each piece.
    """
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letters()[code], code, 0)
    where = np.repeat(groups, [len(x) for x in parts])
    whole = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (whole[1:] != whole[:-1])
    code, where, whole = code[keep], where[keep], whole[keep]
    seen = np.zeros(0x110000, bool)
    seen[code] = True
    seen[0] = True
    codes = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.int64)
    number[codes] = np.arange(len(codes))
    x, size = number[code], len(codes)
    ok = (whole[2:] == whole[:-2]) & (x[1:-1] != 0)
    tri, at = ((x[:-2] * size + x[1:-1]) * size + x[2:])[ok], where[2:][ok]
    if size <= DENSE:
        used = np.flatnonzero(np.bincount(tri, minlength=1))
        place = np.zeros(size**3, np.int64)
        place[used] = np.arange(len(used))
        index = place[tri]
    else:
        used, index = np.unique(tri, return_inverse=True)
    width = max(64, min(1 << 14, CELLS // n_groups))
    vectors = lambda t: trigram_vectors(t // size**2, t // size % size, t % size, codes)
    if len(used) > width:
        order = np.argsort(index, kind="stable")
        index, at = index[order], at[order]
    for low in range(0, len(used), width):
        n = min(width, len(used) - low)
        block = slice(*np.searchsorted(index, (low, low + n))) if len(used) > width else slice(None)
        counts = np.bincount(at[block] * n + index[block] - low, minlength=n_groups * n)
        yield counts.reshape(n_groups, n).astype(np.float32), vectors(used[low : low + n])


def profiles(texts: list[str | None], keys: np.ndarray, n_keys: int) -> np.ndarray:
    """The bundled vector of each key; keys: of each text."""
    out = np.zeros((n_keys, DIM))
    for rows, parts in pieces(texts):
        groups = keys[np.array(rows)]
        present, local = np.unique(groups, return_inverse=True)
        for counts, vectors in counted(parts, local, len(present)):
            out[present] += counts @ vectors.astype(np.float32)
    return out


def partial_prototypes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        keys = np.array([names.index(x) for x in langs], np.int64)
        for name, vector in zip(names, profiles(batch.column("text").to_pylist(), keys, len(names)), strict=True):
            sums[name] = sums.get(name, 0) + vector
    if sums:
        yield pa.RecordBatch.from_pydict(
            {"lang": list(sums), "vector": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))}
        )


def prototypes(training: DataFrame) -> dict[str, np.ndarray]:
    """A unit vector for each language in (text, lang) rows."""
    rows = training.filter("text is not null and lang is not null").select("text", "lang")
    parts = rows.mapInArrow(partial_prototypes, "lang string, vector array<double>")
    summed = (
        parts.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    )
    found = {r["lang"]: np.array([x["x"] for x in r["v"]]) for r in summed.collect()}
    return {k: v / n for k, v in sorted(found.items()) if (n := np.linalg.norm(v))}


def predicted(docs: DataFrame, known: dict[str, np.ndarray], keep: list[str], text_col: str = "text", letters_col: str | None = None) -> DataFrame:
    """The kept columns with lang_pred and score: the best prototype's cosine, from 0 to 1.

    With a letters_col, that column tells whether the text has a letter, also where no language is known.
    """
    more = [] if letters_col is None else [letters_col]
    names = list(known)
    matrix = np.stack([known[x] for x in names]) if names else np.zeros((0, DIM))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("_text").to_pylist()
            best, score, lettered = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            for at in range(0, len(texts), 512):
                part = texts[at : at + 512]
                vectors = profiles(part, np.arange(len(part)), len(part))
                norm = np.linalg.norm(vectors, axis=1)
                lettered[at : at + len(part)] = norm > 0
                if not names:
                    continue
                cosine = np.round(vectors @ matrix.T / np.where(norm > 0, norm, 1)[:, None], 9)
                for i in np.flatnonzero(norm > 0):
                    best[at + i] = names[int(cosine[i].argmax())]
                    score[at + i] = min(1.0, max(0.0, cosine[i].max()))
            columns = [*[batch.column(c) for c in keep], pa.array(best, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(lettered) for _ in more]], [*keep, "lang_pred", "score", *more])

    few_at_once(docs.sparkSession)  # whole texts go there and back
    chosen = docs.select(*keep, F.col(text_col).alias("_text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    shape = f"{shape}, lang_pred string, score double"
    return chosen.mapInArrow(run, ", ".join([shape, *[f"`{c}` boolean" for c in more]]))


def query(spark, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    known = prototypes(docs.filter(~F.col("held_out")))
    return predicted(docs, known, ["doc_id", "held_out"])
