"""Quality rules, weak labels and toxicity: base counts against plain versions, accuracy on labels."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesync.llm import quality_rules, toxic_terms, weak_quality
from tests.llm.cases import WORD, documents, nothing, rows_of

SMALL, LABELLED = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def plain_counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SMALL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def test_rules_count_as_said(docs, labels):
    expected = Counter()
    for doc_id, text in rows_of(docs):
        counts = plain_counts(text)
        expected[doc_id, *counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0]] += 1
    found = quality_rules.judge(docs, labels).collect()
    assert Counter((r["doc_id"], *[r[c] for c in quality_rules.COUNTS], r["base_failed"]) for r in found) == expected
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_kept_rows_are_those_judged_so(docs, labels):
    kept = quality_rules.keep(docs, labels)
    assert kept.columns == docs.columns
    judged = quality_rules.judge(docs, labels).filter("kept")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in judged.collect())


def test_rules_without_trusted_documents_or_rows(spark, docs, labels):
    none = nothing(spark, labels)
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.judge(docs, none).collect())
    assert quality_rules.judge(nothing(spark, docs), none).collect() == []


def test_rules_separate_labelled_documents(spark):
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet")
    judged = quality_rules.judge(spark.read.parquet(f"{LABELLED}/documents.parquet"), labels)
    share = {
        r["quality"]: r["kept"]
        for r in judged.filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    }
    assert share[1] > 0.99 and share[0] < 0.1


def test_every_trusted_document_counts(spark):
    """More trusted documents than were once used: if all are trusted, they are the corpus."""
    words = F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), "id") for i in range(25)])
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), words.alias("text"))
    judged = quality_rules.judge(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    assert judged.filter("llr = 0 and kept").count() == 21_000


def test_ratios_equal_a_plain_count(spark, docs, labels):
    """Without shared buckets a score is that of the n-grams themselves."""
    trusted = {r["doc_id"] for r in labels.filter("quality = 1 and doc_id is not null").collect()}
    token = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0d]+")
    found, n = [], [Counter(), Counter()]
    for doc_id, text in rows_of(docs):
        one = token.findall(text)
        found.append((doc_id, [*one, *zip(one, one[1:])]))
        for counts in n[: 1 + (doc_id in trusted)]:
            counts.update(found[-1][1])
    share = n[1].total() / n[0].total()
    ratio = {g: np.log((n[1][g] + quality_rules.PRIOR) / (c * share + quality_rules.PRIOR)) for g, c in n[0].items()}
    expected = sorted((doc_id or 0, float(np.mean([ratio[g] for g in grams])) if grams else 0.0) for doc_id, grams in found)
    judged = sorted((r["doc_id"] or 0, r["llr"]) for r in quality_rules.judge(docs, labels).collect())
    assert [d for d, _ in judged] == [d for d, _ in expected]
    # Some n-grams share a bucket.
    assert np.abs(np.array([x for _, x in judged]) - np.array([x for _, x in expected])).mean() < 0.02


def test_buckets_follow_the_ngrams():
    counts = np.zeros(quality_rules.MOST_BUCKETS, np.int64)
    for n, buckets in ((0, 1 << 14), (100_000, 1 << 18), (1_000_000, 1 << 21), (4_000_000, 1 << 22)):
        counts[: int(len(counts) * (1 - np.exp(-n / len(counts))))] = 1
        assert quality_rules.buckets_for(counts) == buckets
    assert len(quality_rules.log_ratios(counts * 0, counts)) == 1 << 22


def test_weak_labels_agree_with_labels(spark):
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet")
    scored = weak_quality.score(spark.read.parquet(f"{LABELLED}/documents.parquet"))
    share = {r["quality"]: r["good"] for r in scored.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("good").cast("int")).alias("good")).collect()}
    assert share[1] > 0.97 and share[0] < 0.3


def test_weak_labels_of_odd_rows(spark, docs):
    found = weak_quality.score(docs).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert weak_quality.score(nothing(spark, docs)).collect() == []


def test_em_recovers_the_rates():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    votes = np.zeros((len(good), len(weak_quality.LABELERS)), np.int8)
    for k in range(votes.shape[1]):
        votes[:, k] = np.where(rng.random(len(good)) < np.where(good, 0.05, 0.7), -1, np.where(rng.random(len(good)) < np.where(good, 0.6, 0.1), 1, 0))
    share, rates, _ = weak_quality.expectation_maximisation(Counter(weak_quality._codes(votes).tolist()))
    assert abs(share - good.mean()) < 0.02 and np.abs(rates[:, 1, 0] - 0.7).max() < 0.05


def test_toxicity_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet")
    rows = toxic_terms.score(spark.read.parquet(f"{LABELLED}/documents.parquet"), labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    hit = sum(r["predicted"] and r["toxic"] for r in held)
    assert hit >= 0.8 * sum(r["toxic"] for r in held) and hit >= 0.9 * sum(r["predicted"] for r in held)


def test_toxicity_of_odd_rows(spark, docs, labels):
    found = toxic_terms.score(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    none = toxic_terms.score(docs, nothing(spark, labels)).collect()
    assert all(r["score"] < 1e-6 and not r["predicted"] for r in none)
    assert toxic_terms.score(nothing(spark, docs), labels).collect() == []


def test_misspellings_of_every_learned_term_are_found(spark):
    docs, labels = (spark.read.parquet(f"{LABELLED}/{t}.parquet") for t in ("documents", "labels"))
    words, stems = toxic_terms.learn_lexicon(toxic_terms._sample(docs.select("doc_id", "text"), labels).filter("first_half"))
    lexicon = toxic_terms.FuzzyLexicon(words, stems)
    assert "loser" in words and "lose" not in stems and stems
    for word in words:
        for at in range(len(word)):
            for near in (word[:at] + "0" + word[at + 1 :], word[:at] + word[at:at + 1] + word[at:], word[:at] + word[at + 1 :]):
                assert lexicon.match(near), (word, near)
    for stem in stems:
        assert lexicon.kind_of(stem + "0123") == 3
        if len(stem) > 4:
            assert all(lexicon.kind_of(stem[:at] + "0" + stem[at + 1 :] + "0123") == 4 for at in range(1, len(stem)))
    assert [lexicon.match(w) for w in ("loser", "looser", "l0ser", "lozer", "losesartaga")] == [1, 2, 2, 2, 0]


def test_words_from_a_stem_are_told_from_terms():
    lexicon = toxic_terms.FuzzyLexicon(["loser", "scum"], ["lose", "bomente"])
    found = [lexicon.kind_of(w) for w in ("loser", "losexyzr", "looser", "scvm", "bomentera", "bomfntera", "lise")]
    assert found == [1, 3, 2, 4, 3, 4, 0]
    full, weak = (toxic_terms.features([f"a {w} b"], lexicon)[0] for w in ("looser", "scvm"))
    assert 0 < weak[1] < full[1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    words, stems = ["idiot", "scum", "worthless", "abcde"], ["lowe"]
    lexicon, rng = toxic_terms.FuzzyLexicon(words, stems), np.random.default_rng(6)
    for _ in range(4000):
        word = list(rng.choice([*words, "lowell", "clown"]))
        for _ in range(rng.integers(0, 4)):
            at = int(rng.integers(0, len(word) + 1))
            word[at : at + int(rng.integers(0, 2))] = list("abcdeiostw")[int(rng.integers(0, 10))] * int(rng.integers(0, 2))
        word = "".join(word)
        near = [edits(word, w) for w in words]
        expected = 1 if word in words else 2 if any(d <= toxic_terms.edits_allowed(w) for d, w in zip(near, words)) else 0
        assert lexicon.match(word) == (3 if word.startswith("lowe") else expected), word


def test_quotation_is_told_from_abuse():
    lexicon = toxic_terms.FuzzyLexicon(["idiot"], [])
    open_, quoted = toxic_terms.features(["you are an idiot here", 'they said "idiot" to us'], lexicon)
    assert open_[0] > 0 and open_[3] == 0 and open_[6] > 0
    assert quoted[3] > 0 and quoted[0] == 0 and quoted[7] > 0


def test_the_lexicon_has_terms_of_any_length_and_number(spark):
    """Short, long and very many toxic words; a repeated id counts once."""
    many = [f"bad{n:04d}word" for n in range(2_500)]
    rows = [(i, " ".join(["zz", "q" * 45, *many, f"say{i}"]), 1) for i in range(0, 40)]
    rows += [(i, f"a calm text about zebras {i}", 0) for i in range(100, 400)]
    rows += [(7, rows[7][1], 1)] * 30
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = sample.select("doc_id", "toxic").distinct()
    words, _ = toxic_terms.learn_lexicon(sample.select("text", "toxic"))
    assert {"zz", "q" * 45, *many} <= set(words)
    assert toxic_terms._sample(sample.select("doc_id", "text"), labels).count() <= labels.count()
    lexicon = toxic_terms.FuzzyLexicon(["zz", "q" * 45], [])
    assert [lexicon.kind_of(w) for w in ("zz", "zy", "z", "q" * 45, "q" * 44)] == [1, 0, 0, 1, 2]
