"""Periodic runs and token counts against plain versions."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablesync.llm import periodic_runs, queries, token_counts
from tests.llm.cases import WORD, documents, nothing, rows_of
from tests.llm.test_tokens import texts

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_runs(words):
    """Every run, from the definition: all lags, all streaks."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                part = words[i : i + length]
                if not any(all(part[t] == part[t + p] for t in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(words):
    found = plain_runs(words)
    gone = {w for s, n, q in found for w in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = digest("".join(f"{s},{n},{q}\n" for s, n, q in found))
    kept = digest(" ".join(w for i, w in enumerate(words) if i not in gone))
    return (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), listed, kept)


def planted(doc_id, words):
    code, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or code % 10 or not n:
        return words
    g = code // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_random_words_have_all_their_runs():
    rng = random.Random(3)
    for _ in range(1500):
        some = []
        for _ in range(rng.randrange(1, 4)):
            k, mode = rng.choice([1, 2, 3, 5]), rng.randrange(3)
            if mode == 0:
                some.append([rng.randrange(k) for _ in range(rng.randrange(60))])
            elif mode == 1:
                parts = [[rng.randrange(k) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 8) for _ in range(4)]
                some.append([w for part in parts for w in part])
            else:
                some.append([7] * rng.randrange(3) + fibonacci(rng.choice([3, 5, 8, 13, 21])) * 5 + [0] * rng.randrange(9))
        first = np.cumsum([0, *map(len, some)])
        doc, start, length, period = periodic_runs.runs(np.array(sum(some, []), np.int64), first)
        found = [[] for _ in some]
        for d, s, n, q in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
            found[d].append((s - int(first[d]), n, q))
        assert found == [plain_runs(words) for words in some]


@pytest.mark.parametrize(
    ("words", "n"), [(np.zeros(300_000, np.int64), 1), (np.arange(300_000) % 3333, 1), (np.array(fibonacci(300_000)), 0)]
)
def test_pairs_stay_linear_in_a_long_text(words, n):
    doc = np.zeros(len(words), np.int64)
    pairs = sum(len(at) for at, _ in periodic_runs._seeds(words, doc, np.full(len(words), len(words))))
    assert pairs <= 2 * len(words) * 20
    assert len(periodic_runs.runs(words, np.array([0, len(words)]))[0]) == n


def test_planted_documents(spark):
    docs = documents(spark, SMALL)
    found = sorted((tuple(r) for r in periodic_runs.digests(queries._with_planted_runs(docs)).collect()), key=repr)
    expected = [(doc_id, *plain_row(planted(doc_id, WORD.findall(text)))) for doc_id, text in rows_of(docs)]
    assert found == sorted(expected, key=repr)
    assert sum(r[1] > 0 for r in found) > len(found) / 15
    assert periodic_runs.digests(nothing(spark, docs)).collect() == []


def test_texts_keep_one_period_of_each_run(spark):
    rows = [(1, "a start " + "round and " * 5 + "é end"), (2, "x " * 6 + "漢字 " * 7), (3, "no run here")]
    found = {r["doc_id"]: r for r in periodic_runs.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["collapsed"] == "a start round and é end" and found[1]["best"] == (2, 10, 2)
    assert found[2]["collapsed"] == "x 漢字" and [tuple(r) for r in found[2]["runs"]] == [(0, 6, 1), (6, 7, 1)]
    assert found[3]["collapsed"] == "no run here" and found[3]["best"] is None and found[3]["runs"] == []


def test_batches_and_blocks_do_not_matter(spark, monkeypatch):
    docs = documents(spark, SMALL, limit=80)
    whole = sorted(map(repr, periodic_runs.digests(docs).collect()))
    assert sorted(map(repr, periodic_runs.digests(docs.repartition(7)).collect())) == whole
    monkeypatch.setattr(periodic_runs, "STEP", 1)
    monkeypatch.setattr(periodic_runs, "blocks", lambda column: iter(list(_blocks(column, 100))))
    assert sorted(map(repr, periodic_runs.digests(docs).collect())) == whole


_blocks = periodic_runs.blocks


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as file:
        return token_counts.Counter(token_counts.Merges(file.read()))


def test_counts_equal_the_library(counter, library):
    for text in texts(11, 3000, 60):
        assert counter.text(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_counts_of_long_pieces(counter, library):
    rng = random.Random(9)
    for parts in (["q"], ["the", "in", "er", "tion", "a", "é", "漢"], ["!", "#", "é", "'", "$"]):
        text = "".join(rng.choice(parts) for _ in range(20_000))
        assert counter.text(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_merges_pop_the_lowest_pair_first():
    with open(PATH, encoding="utf-8") as file:
        merges = token_counts.Merges(file.read())
    at = {b: merges.inner[b] for b in range(256)}
    a, b, c = at[97], at[98], at[99]
    merges.rank = {b << 32 | c: 0, a << 32 | b: 1, a << 32 | 9001: 2, 9002 << 32 | 9002: 3}
    merges.joined = [9001, 9002, 9003, 9004]
    # bc goes ahead of ab; abab becomes one symbol; of aab only ab joins.
    for text, n in ((b"abc", 2), (b"ababc", 3), (b"abab", 3), (b"bcbc", 2), (b"aab", 1), (b"a", 0), (b"aaa", 0)):
        assert merges.merge([at[x] for x in text]) == n


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 3)
    monkeypatch.setattr(token_counts, "SLICE", 5)
    with open(PATH, encoding="utf-8") as file:
        small = token_counts.Counter(token_counts.Merges(file.read()))
    for text in texts(12, 300, 60):
        assert small.text(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
        assert len(small.words) <= 3 and len(small.pieces) <= 3


def test_counts_of_documents(spark, library):
    docs = documents(spark, SMALL)
    found = sorted((tuple(r) for r in token_counts.counts(docs, PATH).collect()), key=repr)
    ids = library.encode_batch([text for _, text in rows_of(docs)], add_special_tokens=False)
    expected = [(d, len(t.encode()), len(e.ids), len(e.ids) > 2048) for (d, t), e in zip(rows_of(docs), ids)]
    assert found == sorted(expected, key=repr)
    assert {r[3] for r in found} == {True, False}
    assert token_counts.counts(nothing(spark, docs), PATH).collect() == []


def test_other_names_and_types(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, None)], "id string, body string")
    found = {r["doc_id"]: r for r in token_counts.counts(docs, PATH, "id", "body", limit=1).collect()}
    assert found["a"]["n_tokens"] == 2 and found["a"]["over_limit"] and found[None]["n_tokens"] == 0
    assert periodic_runs.find(docs, "id", "body").filter(F.col("doc_id") == "a").first()["collapsed"] == "one two"
