"""Parts of texts that are solved side by side: the same ids as one by one."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest

from orderstream.llm import pieces

SIGNS = "abcdeeiinorst" * 3 + "éßж漢😀\u0000\n\t~"


@pytest.fixture(scope="module")
def model():
    return pieces.Model(public_tokenizers.path("piece_bpe_32k.model"))


def _words(n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_parts_side_by_side_equal_parts_alone(model):
    parts = [*(f" {w}" for w in _words(3000)), *_words(200, 8), " ", "    ", "   a", " 漢漢漢", " \U0010ffff", "a" * 63]
    assert model.solve_all(parts) == [model.solve(p) for p in parts]


def test_new_words_are_not_solved_one_by_one(model, monkeypatch):
    texts = [" ".join(_words(500, seed)) for seed in range(4)]
    expected = [b"".join(model.solve(p) for p in pieces.parts_of(t)) for t in texts]
    alone = []
    one = type(model).solve
    monkeypatch.setattr(type(model), "solve", lambda self, part: alone.append(part) or one(self, part))
    model.known.clear()
    assert list(model.encode_all(texts)) == expected
    assert alone == []


def test_long_parts_and_markers_between_others(model, monkeypatch):
    monkeypatch.setattr(pieces, "CHARS", 2000)
    monkeypatch.setattr(pieces, "TOGETHER", 64 * pieces.SHORT)
    texts = [None, "", " ", *_words(300), "漢字" * 500, "▁▁ a▁b  c ", " ".join(_words(400, 9)), "x" * 5000]
    model.known.clear()
    out = list(model.encode_all(texts))
    assert [model.decode(np.frombuffer(x, "<u4")) for x in out] == [t or "" for t in texts]
    assert out == [b"".join(model.solve(p) for p in pieces.parts_of(t or "")) for t in texts]
    assert all(len(p) < pieces.SHORT for p in model.known)
