"""Removal of repeated passages against a plain version."""

import hashlib

import pytest

from tablesync.llm import phrase_dedup
from tests.llm.cases import WORD, documents, nothing, rows_of, without_repeats

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SMALL).filter("doc_id is null or doc_id <> 900005").filter("doc_id is not null or text is not null")


@pytest.fixture(scope="module")
def expected(docs):
    return without_repeats(rows_of(docs))


@pytest.mark.parametrize("share", [1000, 2])
def test_digests_equal_a_plain_scan(docs, expected, share, monkeypatch):
    """With a small share every frequent seed is dealt over several tasks."""
    monkeypatch.setattr(phrase_dedup, "SHARE", share)
    found = {r["doc_id"]: r for r in phrase_dedup.digests(docs).collect()}
    assert found.keys() == expected.keys()
    for doc_id, text in rows_of(docs):
        kept, row = expected[doc_id], found[doc_id]
        assert (row["n_words"], row["n_removed"]) == (len(WORD.findall(text)), len(WORD.findall(text)) - len(kept))
        assert row["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_cut_keeps_rows_columns_and_spacing(docs, expected):
    cut = phrase_dedup.cut(docs)
    assert cut.columns == docs.columns
    before = dict(rows_of(docs))
    for r in cut.collect():
        assert WORD.findall(r["text"] or "") == expected[r["doc_id"]]
        if len(WORD.findall(before[r["doc_id"]])) == len(expected[r["doc_id"]]):
            assert (r["text"] or "") == before[r["doc_id"]]


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in phrase_dedup.digests(rows).collect()) == [(1, 0), (1, 0), (2, 30)]


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_with_one_id_have_lists_of_their_own(spark, doc_id):
    """A row meets the recurring seeds of its text, not those of all rows with the same or no id."""
    texts = [" ".join(f"t{n // 2}w{i}" for i in range(30)) + f" end{n}" for n in range(80)]
    rows = spark.createDataFrame([(doc_id, text) for text in texts], "doc_id long, text string")
    triaged = phrase_dedup._triaged(rows, "doc_id", "text").collect()
    assert len(triaged) == 80 and all(0 < len(r["seeds"]) <= 31 for r in triaged)
    removed = sorted(r["n_removed"] for r in phrase_dedup.digests(rows).collect())
    assert removed == [0] * 40 + [30] * 40


def test_empty_table(spark, docs):
    assert phrase_dedup.digests(nothing(spark, docs)).collect() == []
    assert phrase_dedup.cut(nothing(spark, docs)).collect() == []
