"""Whitening, the Jaccard join and importance resampling: brute force, awkward rows, hot groups."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orderstream.llm import metric, packing, private, resampling, whitening

VECTORS = "vec_id long, embedding array<float>, label int, vec string, component string, n string, whitened string"
TEXTS = "doc_id long, text string, node string, region int, keys string, score int, rank string, part int, place int, first int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", "c", "n", "w") for r in rows], VECTORS)


def docs(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, "k", 2, "r", 3, 4, 5) for r in rows], TEXTS)


# Whitening


def spread(n: int, dim: int, seed: int = 1) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * 0.3).astype(np.float32).tolist()


def compared(rows: list, found: list, most: int) -> None:
    x = np.floor(64 * np.array([v for _, v in rows], np.float64)) + 1_000_000
    n, ids = len(x), [i for i, _ in rows]
    covariance = np.atleast_2d(np.cov(x.T, bias=True))
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    whole = [[int(c) for c in row] for row in x]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    wanted = {i: sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for i, row in zip(ids, whole, strict=True)}
    z = {i: row for i, row in zip(ids, (x - x.mean(0)) @ v / np.sqrt(e), strict=True)}
    signs = {}
    for r in found:
        k = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, wanted[r["vec_id"]])
        assert math.isclose(r["explained"], e[k] / np.trace(covariance), rel_tol=1e-6)
        sign = signs.setdefault(k, 1 if r["whitened"] * z[r["vec_id"]][k] > 0 else -1)
        assert abs(r["whitened"] - sign * z[r["vec_id"]][k]) < 1e-6
        assert r["identity_error"] < 1e-9
    assert len(found) == n * min(most, x.shape[1])


@pytest.mark.parametrize("dim", [1, 3, 40])
def test_whitening_equals_plain_eigenvectors(spark, dim):
    rows = list(enumerate(spread(200, dim)))
    compared(rows, whitening.whitened(vectors(spark, rows)).collect(), min(32, dim))


def test_whitening_leaves_unusable_vectors_out(spark):
    rows = list(enumerate(spread(60, 4)))
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0]), (92, [1.0, math.nan, 2.0, 3.0]), (93, [math.inf, 0.0, 0.0, 0.0]), (94, []), (95, [1.0, 2.0])]
    compared(rows, whitening.whitened(vectors(spark, rows + bad)).collect(), 4)


def test_whitening_counts_repeated_rows_and_null_ids(spark):
    rows = [(i, v) for i, v in enumerate(spread(50, 3))]
    again = [*rows, rows[0], (None, rows[1][1])]
    out = whitening.whitened(vectors(spark, again)).collect()
    assert Counter(r["vec_id"] for r in out) == {**{i: 3 for i in range(1, 50)}, 0: 6, None: 3}
    assert {r["n"] for r in out} == {52}


def test_whitening_without_variance(spark):
    out = whitening.whitened(vectors(spark, [(i, [1.0, 2.0, 0.5]) for i in range(5)])).collect()
    assert len(out) == 15 and {(r["explained"], r["whitened"], r["deviation"], r["identity_error"]) for r in out} == {(0.0, None, 0, 0.0)}
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, None), (2, [])])).collect() == []


def test_whitening_of_lower_rank_and_equal_roots(spark):
    """Equal variances in a plane, a copied entry, a constant one: two roots, equal, and two zero ones."""
    rows = [(i, [x, y, x, 3.0]) for i, (x, y) in enumerate([(1.0, 0.0), (-1.0, 0.0), (0.0, math.sqrt(2)), (0.0, -math.sqrt(2))])]
    out = whitening.whitened(vectors(spark, rows)).collect()
    by = {k: [r for r in out if r["component"] == k] for k in (1, 2, 3, 4)}
    assert all(r["whitened"] is None and r["explained"] == 0 for k in (3, 4) for r in by[k])
    assert math.isclose(sum(by[k][0]["explained"] for k in (1, 2)), 1, rel_tol=1e-12)
    for k in (1, 2):
        assert math.isclose(sum(r["whitened"] ** 2 for r in by[k]) / 4, 1, rel_tol=1e-9)
    assert abs(sum(a["whitened"] * b["whitened"] for a, b in zip(*(sorted(by[k], key=lambda r: r["vec_id"]) for k in (1, 2)), strict=True))) < 1e-9


def test_whitening_of_huge_entries(spark):
    """Exact sums beyond a long; a deviation that no long holds is null."""
    rows = [(0, [1e9, 1.0]), (1, [-1e9, 2.0]), (2, [1e30, 4.0])]
    out = whitening.whitened(vectors(spark, rows)).collect()
    assert {r["deviation"] for r in out} == {None} and out[0]["identity_error"] < 1e-4


def test_equal_roots_are_counted_and_their_components_orthogonal(spark):
    diagonal = [9, 9, 9, 4, 4, 1, 0, 0]
    scatter = [[10**9 * d if i == j else 0 for j in range(8)] for i, d in enumerate(diagonal)]
    found = whitening.components(spark, whitening.Fit(1000, [0] * 8, scatter), 8)
    assert np.allclose(found.values, [1000 * d for d in diagonal], rtol=1e-14)
    assert np.allclose(found.vectors.T @ found.vectors, np.diag([1.0] * 6 + [0.0] * 2), atol=1e-14)


def test_characteristic_polynomial_is_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-9, 9, (6, 4))
    a = (x.T @ x).tolist()
    assert [float(c) for c in whitening.coefficients(spark, a)] == np.round(np.poly(np.array(a, float))[::-1]).tolist()


# Jaccard join


def sets(text: str | None) -> set:
    ws = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))} if ws else set()


def brute_components(rows: list, percent: int) -> dict:
    found = [(i, sets(t)) for i, t in rows]
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, s) in enumerate(found):
        for j in range(i):
            t = found[j][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                root[top(i)] = top(j)
    low: dict = {}
    for i in range(len(rows)):
        low[top(i)] = min(low.get(top(i), found[i][0]), found[i][0])
    return {(doc, len(s)): low[top(i)] for i, (doc, s) in enumerate(found)}


def families(seed: int, n: int, edits: tuple[int, int], words: int = 120) -> list[tuple[int, str]]:
    """Families of one text with a few words changed, some chained, some short, some alone."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    bases = [[word() for _ in range(rng.choice([4, 9, 14, 30, words, 3 * words]))] for _ in range(6)]
    rows = []
    for i in range(n):
        ws = list(rng.choice(bases)) if rng.random() < 0.9 else [word() for _ in range(words)]
        for _ in range(rng.randint(*edits)):
            ws[rng.randrange(len(ws))] = word()
        if rng.random() < 0.2:
            ws = ws[: int(0.95 * len(ws))]
        rows.append((i, " ".join(ws)))
    return rows


@pytest.mark.parametrize(("leaf", "edits", "percent"), [(256, (0, 4), 90), (6, (0, 4), 90), (6, (1, 9), 90), (6, (0, 6), 80)])
def test_join_equals_brute_force(spark, monkeypatch, leaf, edits, percent):
    monkeypatch.setattr(metric, "LEAF", leaf)
    rows = families(leaf + edits[1], 150, edits)
    found = metric.jaccard_join(docs(spark, rows), percent=percent, leaf=leaf).collect()
    assert {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in found} == brute_components(rows, percent)


def test_join_in_tiles_equals_brute_force(spark, monkeypatch):
    """No region counts as split well, so all large ones are dealt into tiles of small blocks."""
    monkeypatch.setattr(metric, "LEVELS", 1)
    monkeypatch.setattr(metric, "LEAF", 4)
    rows = families(3, 150, (0, 6))
    found = metric.jaccard_join(docs(spark, rows), leaf=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: c for (i, _), c in brute_components(rows, 90).items()}


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(8)
    for percent in (50, 80, 90, 97):
        sizes = metric.Sizes(percent)
        for _ in range(200):
            n = int(rng.integers(2, 900))
            s = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            added = int(rng.integers(0, max(1, (len(s) - gone) * 100 // percent - len(s) + 1)))
            t = np.unique(np.concatenate([s[gone:], rng.integers(0, 1 << 62, added).astype(np.uint64)]))
            both, total = len(np.intersect1d(s, t)), len(np.union1d(s, t))
            if both and 100 * both >= percent * total and both < total:
                assert len(np.intersect1d(metric.part_keys(s, sizes), metric.part_keys(t, sizes)))


def test_join_handles_awkward_rows(spark):
    long = "lorem ipsum dolor sit amet " * 4000
    rows = [
        (4, None), (5, ""), (6, " \n\t "), (None, "a text without an id in some length"), (None, None), (7, "one"), (3, "One"), (8, "two words"),
        (9, "the same row twice over and over"), (9, "the same row twice over and over"), (2, "THE same row twice over and over"), (10, long),
        (1, long + "lorem"), (11, "ünïcödé 漢字 \U0001f600 \u0000 end"), (12, "one text of two"), (12, "another text of the two"),
    ]
    out = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in metric.jaccard_join(docs(spark, rows)).collect())
    n = {i: len(sets(t)) for i, t in rows if i is not None}
    assert out == Counter(
        [(4, 0, 4), (5, 0, 5), (6, 0, 6), (None, 6, None), (None, 0, None), (7, 1, 3), (3, 1, 3), (8, 1, 8), (9, 5, 2), (9, 5, 2), (2, 5, 2)]
        + [(10, n[10], 1), (1, n[1], 1), (11, n[11], 11), (12, 2, 12), (12, 3, 12)]
    )
    assert metric.jaccard_join(docs(spark, [])).collect() == []


# Importance resampling


def brute_resampled(rows: list, target: list) -> dict:
    def buckets(text):
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return [zlib.crc32(w.encode()) % 10000 for w in ws]

    s, t = Counter(b for _, x in rows for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    ns, nt = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        found = buckets(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in found)
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(found), weight, score))
    able = sorted((r for r in out if r[1] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    drawn = able[: 10 * len(able) // 100]
    return Counter((*r, None) for r in out) - Counter((*r, None) for r in drawn) + Counter((*r, k) for k, r in enumerate(drawn, 1))


def test_resampling_equals_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("alpha beta Gamma delta 7 x9 été 漢字 zeta-eta don't".split())
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "!?"), (403, "word " * 50_000), (None, "alpha " * 30), (-5, "beta " * 40), (-5, "beta " * 40)]
    target = ["Gamma delta été", None, "", "7 7 7"]
    found = resampling.resampled(docs(spark, rows), spark.createDataFrame([(x,) for x in target], "text string")).collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found) == brute_resampled(rows, target)


def test_resampling_of_empty_tables(spark):
    none = docs(spark, [])
    assert resampling.resampled(none, none).collect() == []
    some = resampling.resampled(docs(spark, [(1, "a b " * 20), (2, None)]), none).collect()
    assert sorted((r["doc_id"], r["n_features"], r["rank"]) for r in some) == [(1, 40, None), (2, 0, None)]


@pytest.mark.parametrize(("bits", "chunk"), [(3, 7), (11, 64), (16, 1 << 20)])
def test_radix_sort_orders_any_longs(spark, tmp_path, bits, chunk):
    rng = random.Random(bits)
    ids = rng.sample(range(-(1 << 63), 1 << 63, 1 << 40), 400) + [-(1 << 63), (1 << 63) - 1, 0, 1, -1]
    rows = [(i, 1, 2, 3, rng.choice([-(1 << 40), 5, 5, 6, rng.getrandbits(30)])) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(3)
    found = {r["place"]: (r["doc_id"], r["score"]) for r in resampling.radix_sorted(df, str(tmp_path), bits, chunk).collect()}
    assert [found[k] for k in range(len(rows))] == [(r[0], r[4]) for r in sorted(rows, key=lambda r: (-r[4], r[0]))]


def test_longer_features_count_every_run(spark):
    n, found = resampling.features("a b c", resampling.Remembered(10_000), 2)
    assert (n, sorted(found.tolist())) == (3, sorted(zlib.crc32(x) % 10_000 for x in (b"a", b"b", b"c", b"a b", b"b c")))
    rows = resampling.bucket_counts(spark.createDataFrame([("a b c",), (None,)], "text string"), 10_000, 2).agg(F.sum("n")).first()
    assert rows[0] == 5


# Tokens of the packing operator


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_equal_the_tokenizer_on_any_text(file):
    """Runs of letters go to the model itself where the tokenizer's description allows it; other tokenizers see whole texts."""
    rng, path = random.Random(1), public_tokenizers.path(file)
    signs = [*"aAbBéÉßİıſΣσςñÑçœÆ漢字ーｱ'’.,;:!?-_ \t\n  ̧́‍<|>09٣½Ⅷ\U0001f600\x00\x1c\x85", "<|endoftext|>", "'ll", "'s ", " "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [None, "", "x" * 5000, "é" * 300 + ".", "don't. we'll, I'D", "a" * 100 + " " + "a" * 100, "&&&" * 50, "a &&& b&&&", "&&&"]
    words = packing.Words.of(path)
    assert words.by_word == (file == "word_bpe_49k.json")
    found = [x for at in range(0, len(texts), 100) for x in packing.encoded(texts[at : at + 100], path)]
    plain = words.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)
    assert found == [np.array([*e.ids, 1], "<u4").tobytes() for e in plain]
    assert all(len(w) <= packing.LONGEST_KEPT for w in (*words.known, *words.letters))


# Private data


def test_private_values_without_two_digits_in_a_row_and_clashing_columns(spark):
    rows = [(1, "host 1.2.3.4 is up", "x", 7), (2, "card 4 5 3 9 5 7 8 7 6 3 6 2 1 4 8 6", "y", 8), (3, "none 1.2 here", "z", 9), (4, None, "w", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _found string, _NEW int")
    df = df.select("*", *[F.lit(c).alias(c) for c in ("_parts", "_pieces", "_between")])
    out = private.pseudonymized(df).orderBy("doc_id").collect()
    assert "1.2.3.4" not in out[0]["text"] and re.fullmatch(r"host \d+\.\d+\.\d+\.\d+ is up", out[0]["text"])
    assert out[1]["text"] != rows[1][1] and out[1]["private"]["card"] == 1
    assert (out[2]["text"], out[3]["text"]) == (rows[2][1], None)
    assert [(r["_found"], r["_NEW"], r["_parts"], r["_pieces"], r["_between"]) for r in out] == [(x, n, "_parts", "_pieces", "_between") for _, _, x, n in rows]
    assert out[0].__fields__ == [*df.columns, "private"]
