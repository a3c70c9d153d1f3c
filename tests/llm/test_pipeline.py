"""The registered text queries against their SQL, and the pipeline stage by stage against brute force."""

from __future__ import annotations

import pytest
from check import database, differences
from test_operators import brute_repeats

import corpus_pipeline
from orderstream.llm import near
from orderstream.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert differences(got, con.sql(ORACLES[name]).df()) == []


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What goes into every stage and what the last one returns, over all documents."""
    root = tmp_path_factory.mktemp("pipeline")
    found = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, found[-1], FOLDER).write.parquet(str(root / name))
        found.append(spark.read.parquet(str(root / name)))
    return found


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_language_rejects_only_what_has_no_letter(steps):
    before, after = texts_of(steps[0]), texts_of(steps[1])
    assert after == {i: t for i, t in before.items() if any(c.isalpha() for c in t or "")}
    assert steps[1].filter("lang is null").count() == 0


def test_near_duplicates_keep_the_first_of_each_component(steps):
    before = texts_of(steps[1])
    sets, lead = {}, {i: i for i in before}
    for i, t in before.items():
        ws = near.words_of(t)
        k = min(5, len(ws))
        sets[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if ws else set()

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    ids = sorted(before)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((root(i), root(j)))
                lead[high] = low
    assert texts_of(steps[2]) == {i: t for i, t in before.items() if root(i) == i}


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCUMENT)


def test_language_keeps_lettered_texts_when_no_row_is_labelled(spark):
    rows = [(1, "some words", None), (2, "ünïcödé", None), (3, "12 34 !", None), (4, "", None), (5, None, None)]
    out = corpus_pipeline.identify_language(spark, documents(spark, rows), FOLDER).collect()
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in out) == [(1, "some words", None), (2, "ünïcödé", None)]


def test_near_duplicates_keep_rows_without_an_id_and_texts_that_share_one(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a, "en"), (None, b, "en"), (None, b, "en"), (1, c, "en"), (2, c + " more", "en"), (2, d, "en"), (2, d, "en"), (3, None, "en"), (3, " ", "en"), (3, " ", "en")]
    out = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), FOLDER).collect()
    got = sorted((r["doc_id"] or 0, r["text"] or "null") for r in out)
    assert got == sorted([(0, a), (0, b), (0, b), (1, c), (2, d), (3, "null"), (3, " ")])


def test_repeats_leave_what_was_not_there_before(steps):
    before, after = texts_of(steps[2]), texts_of(steps[3])
    ids = sorted(before)
    for i, gone in zip(ids, brute_repeats([(before[i] or "").encode() for i in ids]), strict=True):
        left = bytes(b for b, g in zip((before[i] or "").encode(), gone, strict=True) if not g)
        if not left and gone:
            assert i not in after
        else:
            assert (after[i] or "").encode() == left, i


def test_private_data_changes_no_document_without_it(steps):
    before, after = texts_of(steps[3]), texts_of(steps[4])
    assert set(before) == set(after)
    assert all(after[i] == t for i, t in before.items() if not any(c.isdigit() or c == "@" for c in t or ""))


def test_packing_holds_every_document_once(steps):
    rows = steps[5].collect()
    assert {r["doc_id"] for r in rows} == set(texts_of(steps[4]))
    whole, wanted = {}, {}
    for r in rows:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["length"]
        wanted[r["doc_id"]] = r["doc_tokens"]
    assert whole == wanted
