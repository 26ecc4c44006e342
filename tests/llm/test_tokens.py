"""Encoding, decoding and packing against the tokenizers library."""

import gc
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablesync.llm import bpe_stream, packing, textblocks
from tests.llm.cases import documents, nothing, rows_of

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = [*"abcdehinorst'  \n\t.,!?0189é́Σσᅡᄀ한İßﬁ½\x1c\xa0\u0085漢क्षि😀<|>ſ\x00�", "<|endoftext|>", "'re", "'LL"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, encoding="utf-8") as file:
        return bpe_stream.Bpe(file.read())


def texts(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_words_equal_the_library(bpe, library):
    words = bpe_stream.Words(bpe, lambda _, ids: ids)
    some = texts(1, 1500, 40)
    for text, found in zip(some, words.of(some)):
        ids = [i for w in found for i in w]
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert bpe_stream.Decoder(bpe).feed(ids) == library.decode(ids, skip_special_tokens=False)


def test_chunks_do_not_matter(bpe, library):
    rng = random.Random(2)
    for text in texts(3, 800, 40):
        if "<|" in text:
            continue
        stream, out, at = bpe_stream.Transducer(bpe), [], 0
        while at < len(text):
            size = rng.choice([1, 2, 7])
            out += stream.feed(text[at : at + size])
            at += size
        assert out + stream.finish() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("parts", ["the in er tion a é 漢", "! # é ' $", "a"])
def test_endless_pieces_in_bounded_memory(bpe, library, parts):
    rng = random.Random(4)
    text = "".join(rng.choice(parts.split()) for _ in range(9000))
    stream, out = bpe_stream.Transducer(bpe), []
    for at in range(0, len(text), 500):
        out += stream.feed(text[at : at + 500])
        held = len(stream.raw) + len(stream.text) + (len(stream.open.raw) if stream.open else 0)
        assert held <= 4 * (bpe.lookahead + 2 * bpe_stream.STEP)
    assert out + stream.finish() == library.encode(text, add_special_tokens=False).ids


def test_text_comes_back_byte_by_byte(bpe):
    stream = bpe_stream.Decoder(bpe, as_text=True)
    ids = [i for w in next(bpe_stream.Words(bpe, lambda _, i: i).of(["grüße 漢字 at 7"])) for i in w]
    assert "".join(stream.feed([i]) for i in ids) + stream.finish() == "grüße 漢字 at 7 "


def test_round_trip_of_documents(spark, library):
    docs = documents(spark, SMALL, limit=60)
    found = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in bpe_stream.round_trip(docs, PATH).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc_id, text in rows_of(docs):
        ids = library.encode(text, add_special_tokens=False).ids
        assert (doc_id, sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), len(ids)) in found
    assert bpe_stream.round_trip(nothing(spark, docs), PATH).collect() == []


def test_pieces_join_to_the_documents(spark, library):
    docs = documents(spark, SMALL, limit=60)
    pieces = packing.sequences(docs, PATH)
    rows = pieces.collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    joined = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] or -1, r["sequence_id"])):
        assert r["length"] == 1 << r["bucket"] <= packing.LONGEST and len(r["ids"]) == 4 * r["length"]
        joined.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for doc_id, text in rows_of(docs):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
        if doc_id not in (None, 900_005):
            assert b"".join(x for _, x in sorted(joined[doc_id])) == ids
            assert zlib.crc32(ids) == zlib.crc32(b"".join(x for _, x in sorted(joined[doc_id])))
    assert packing.sequences(nothing(spark, docs), PATH).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000])
def test_lengths_are_binary(n):
    assert sum(packing.lengths(n)) == n
    assert all(x & (x - 1) == 0 and x <= 2048 for x in packing.lengths(n))


def test_pieces_are_remembered_across_texts(monkeypatch):
    import public_tokenizers

    from tablesync.llm import bpe_stream as B

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        bpe = B.Bpe(file.read())
    texts = ["a dog, it's", "dog. it' dog' x", "Dog! é. don't' 's' a1 1. _ dogs", "dog; dogs?"]
    words = B.Words(bpe, lambda _, ids: list(ids))
    asked = []
    monkeypatch.setattr(B, "TEXTS", 1)
    pieces = bpe.pieces
    monkeypatch.setattr(bpe, "pieces", lambda new: asked.extend(new) or pieces(new))
    found = [[i for word in text for i in word] for text in words.of(texts)]
    assert found == [B.encode_long(bpe, text) for text in texts]
    assert len(asked) == len(set(asked)) and "dog" in asked


def test_ids_are_kept_packed_and_untracked(bpe, library):
    """Lists of ids are visited by every garbage collection; bytes are not. Many marks need no pattern."""
    some = [*texts(5, 300, 40), "été,&&& Dog.*** dog' dogs'!' ñ$$$ it's... ÉTÉ!? 1*** <|endoftext|> " + "q" * 300]
    words = bpe_stream.Words(bpe)
    for text, found in zip(some, words.of(some)):
        assert list(bpe_stream.unpacked(b"".join(found))) == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert words and not any(gc.is_tracked(kept) for kept in [*words.values(), *words.tokens.values()])


def test_a_worker_that_turns_to_other_work_forgets_its_words():
    """Kept words would otherwise stay beside what later stages hold, in every worker."""
    with open(PATH, encoding="utf-8") as file:
        spec = file.read()
    words = bpe_stream.kept("some use", spec)
    next(words.of(["two words"]))
    assert bpe_stream.kept("some use", spec) is words
    assert [block.n for block in textblocks.blocks(pa.array(["other", "work"]))] == [2]
    assert not bpe_stream.kept("some use", spec)


def test_batches_come_in_slices():
    batch = pa.RecordBatch.from_pydict({"n": list(range(1200))})
    cut = list(textblocks.parts([batch, batch.slice(0, 0)], bpe_stream.TEXTS))
    assert [part.num_rows for part in cut] == [500, 500, 200] and pa.Table.from_batches(cut).column("n").to_pylist() == list(range(1200))


def test_packed_columns_equal_the_library(bpe, library):
    """Texts are normalised as a whole; a second time would change some, and special tokens stay as they are."""
    odd = ["", None, " ", "\t\x0b\x0c\r\n", "J\u030c H\u0331x T\u0308", "S49407 s49407 <|ENDOFTEXT|> <|endoftext|>", "a<|startoftext|>\u0301b<|end", "İΣ ΑΣ",
           "J\u030c" * 300, "a\u2028b\x85c\x1cd\xa0" * 200, "q" * 5000 + "'s", "x<|endoftext|>" * 90, "it's, '&'s 's'' don't'."]
    some = [*texts(6, 1500, 40), *odd]
    words = bpe_stream.PackedWords(bpe)
    for at in range(0, len(some), 400):
        column = pa.array(["other", *some[at : at + 400]], pa.string()).slice(1)
        for text, found in zip(some[at : at + 400], words.of(column), strict=True):
            assert list(bpe_stream.unpacked(found)) == library.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert list(words.of(pa.array([], pa.string()))) == []


def test_a_slice_looks_each_word_up_once(bpe, monkeypatch):
    words, asked = bpe_stream.PackedWords(bpe), []
    values = words._values
    monkeypatch.setattr(words, "_values", lambda new: asked.extend(new) or values(new))
    found = list(words.of(pa.array(["Again and again", "AGAIN and"] * 50)))
    assert len(set(found)) == 2 and sorted(asked) == ["again", "and"]


def test_words_in_use_are_not_forgotten(bpe, monkeypatch):
    """A full table used to be emptied, and its usual words were merged anew."""
    monkeypatch.setattr(bpe_stream, "KEPT_WORDS", 20)
    monkeypatch.setattr(bpe_stream, "KEPT_PIECES", 20)
    words, asked, pieces = bpe_stream.PackedWords(bpe), [], bpe.pieces
    monkeypatch.setattr(bpe, "pieces", lambda new: asked.extend(new) or pieces(new))
    letters = "bcdfghklmn"
    for i in range(100):
        text = f"usual word, new{letters[i // 10]}{letters[i % 10]}"
        (found,) = words.of(pa.array([text]))
        assert found == bpe_stream.packed(bpe_stream.encode_long(bpe, text)) and len(words) <= 60
    assert asked.count("usual") == asked.count("word") == 1 and len(asked) == 103
