"""BPE encoding as a streaming transducer with bounded lookahead, and incremental decoding.

The encoder reads tokenizer files of the ``tokenizers`` library of one kind: NFC, white
space folded, lower case, a fixed split into pieces, byte-level BPE with an end-of-word suffix.

*Lookahead.* Merges are applied in the order of their list. Suppose the text up to some place
is known. Whatever follows, boundaries ahead of it only change by a merge ``(u, v)`` whose ``v``
starts at the first place in doubt, which moves that place left by the length of ``u``. The next
merge that can move it is later in the list, and its ``v`` begins with that ``u``. The longest
such chain bounds how far doubt ever reaches back; tokens further ahead than that are emitted at
once and forgotten, so memory is constant however long a piece gets. The argument needs every
token to be made by one merge only, after the merges that make its parts; this is checked.

*Decoding* is a state machine fed with ids: with a byte-level decoder, bytes gather until they
complete a character; a file without a decoder joins its tokens with spaces.

* NULL is an empty text: no tokens, the digests of nothing.
* Repeated rows each get their result; an empty table gives an empty result.
* Columns other than id and text are not read; none can clash.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import struct
import sys
import types
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.llm import ships

ships(__name__)

#: Words kept with their tokens in a Python worker; beyond it the memory starts anew.
KEPT_WORDS = 500_000
#: Pieces of words kept with their tokens; several words share one.
KEPT_PIECES = 250_000
#: Characters of a word that is kept; longer ones go through the transducer.
LONG_WORD = 256
#: Texts whose new words are encoded together.
TEXTS = 500
#: Symbols of a piece that is encoded together with others.
SHORT_PIECE = 32
#: Symbols that gather behind the lookahead before tokens are emitted.
STEP = 2048

_SPACE = regex.compile(r"\s+")
_ASCII_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
# The split into pieces and the normalisation that such files name.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_PIECE = regex.compile(_SPLIT)
_LETTERS = regex.compile(r"\p{L}+")
_OTHERS = regex.compile(r"[^\s\p{L}\p{N}]+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_NONE = 1 << 30


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte: itself if it prints, else the next free one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: chr(b) if b in prints else chr(next(free)) for b in range(256)}


def lower(text: str) -> str:
    """Lower case character by character: no final form of sigma."""
    return text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()


def normal(text: str) -> str:
    """The text as the file's normaliser leaves it, but for its white space."""
    return lower(text if text.isascii() else unicodedata.normalize("NFC", text))


def cut(word: str) -> list[str]:
    """The pieces of a normalised word."""
    # Most are letters and marks; a quote may begin a piece, digits and control characters are not marks.
    body = word.rstrip(_MARKS)
    return [body, word[len(body) :]] if body.isalpha() else _PIECE.findall(word)


def packed(ids: Sequence[int]) -> bytes:
    """Ids as unsigned little-endian numbers of 32 bits."""
    return struct.pack(f"<{len(ids)}I", *ids)


def unpacked(raw: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(raw) // 4}I", raw)


class Bpe:
    """Vocabulary, merge ranks and the lookahead that follows from the merges."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        normalizers = spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if model["type"] != "BPE" or normalizers != _NORMALIZERS or split != _SPLIT:
            raise ValueError("this kind of tokenizer file is not supported")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.digits = {i: str(i) for i in self.tokens}
        self.decoder = spec["decoder"]
        letters = byte_letters()
        self.bytes_of = {letter: b for b, letter in letters.items()}
        self.plain = [self.vocab[letters[b]] for b in range(256)]
        self.final = [self.vocab[letters[b] + self.suffix] for b in range(256)]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for u, v in pairs:
            self.rank[self.vocab[u] << 20 | self.vocab[v]] = len(self.merged)
            self.merged.append(self.vocab[u + v])
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], order.astype(np.int32)
        self._merged = np.array(self.merged, np.int64)
        self.length = {i: len(t.removesuffix(self.suffix)) for t, i in self.vocab.items()}
        self.lookahead = self._sufficient(pairs)
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")

    def _sufficient(self, pairs: list[tuple[str, str]]) -> int:
        """Symbols by which doubt can reach back from the end of the known text."""
        made: dict[str, int] = {}
        reach: dict[str, int] = {}
        most = 0
        for rank, (u, v) in enumerate(pairs):
            if u + v in made or any(len(s.removesuffix(self.suffix)) > 1 and s not in made for s in (u, v)):
                raise ValueError("a token has several merges, or one ahead of its parts: no lookahead suffices")
            made[u + v] = rank
            start = v.removesuffix(self.suffix)
            chain = len(u) + max((reach.get(start[:n], 0) for n in range(1, len(start) + 1)), default=0)
            reach[u] = max(reach.get(u, 0), chain)
            most = max(most, chain)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """The tokens of a run of symbols."""
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.rank.get
        while len(ids) > 1:
            ranks = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
            best = min(ranks)
            if best == _NONE:
                break
            new, out, at = self.merged[best], [], 0
            while at < len(ids):
                if at < len(ranks) and ranks[at] == best:
                    out.append(new)
                    at += 2
                else:
                    out.append(ids[at])
                    at += 1
            ids = out
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        ids, get = list(ids), self.rank.get
        right = [*range(1, len(ids)), -1]
        left = list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := get(ids[i] << 20 | ids[i + 1], _NONE)) < _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged[rank], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := get(ids[x] << 20 | ids[y], _NONE)) < _NONE:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NONE).astype(np.int32)

    def pieces(self, texts: list[str]) -> list[bytes]:
        """The tokens of many whole pieces, packed; short ones are merged side by side, one merge each per step."""
        out: list = [None] * len(texts)
        raws = [text.encode() for text in texts]
        size = np.array([len(raw) for raw in raws])
        for low, high in ((0, 6), (6, 9), (9, 13), (13, 20), (20, SHORT_PIECE)):
            rows = np.flatnonzero((size > low) & (size <= high))
            if len(rows):
                for row, ids in zip(rows.tolist(), self._side_by_side([raws[r] for r in rows.tolist()], size[rows], high)):
                    out[row] = ids
        for row in np.flatnonzero(size > SHORT_PIECE).tolist():
            out[row] = packed(self.piece(texts[row]))
        return out

    def _side_by_side(self, raws: list[bytes], size: np.ndarray, width: int) -> Iterator[bytes]:
        data = np.frombuffer(b"".join([raw.ljust(width, b" ") for raw in raws]), np.uint8).reshape(-1, width)
        ids = np.array(self.plain, np.int64)[data]
        row = np.arange(len(raws))
        ids[row, size - 1] = np.array(self.final, np.int64)[data[row, size - 1]]
        column = np.arange(width)
        ids[column >= size[:, None]] = -1
        left = size.copy()
        done = np.full((len(raws), width), -1, np.int64)
        ranks = np.full((len(raws), width), _NONE, np.int32)
        inner = column[:-1] < size[:, None] - 1
        ranks[:, :-1][inner] = self._rank_of(ids[:, :-1][inner], ids[:, 1:][inner])
        while len(row):
            at = ranks.argmin(1)
            own = np.arange(len(row))
            best = ranks[own, at]
            go = best < _NONE
            if not go.all():
                done[row[~go]] = ids[~go]
                row, ids, ranks, at, best = row[go], ids[go], ranks[go], at[go], best[go]
                own = np.arange(len(row))
            if not len(row):
                break
            left[row] -= 1
            after = np.minimum(column + (column > at[:, None]), width - 1)
            last = column >= left[row][:, None]
            ids = np.take_along_axis(ids, after, 1)
            ids[own, at] = self._merged[best]
            ids[last] = -1
            ranks = np.take_along_axis(ranks, after, 1)
            ranks[column >= (left[row] - 1)[:, None]] = _NONE
            for near in (at - 1, at):
                some = (near >= 0) & (near + 1 < left[row])
                r, c = own[some], near[some]
                ranks[r, c] = self._rank_of(ids[r, c], ids[r, c + 1])
        raw, line = done.astype("<u4").tobytes(), 4 * width
        return (raw[line * i : line * i + 4 * n] for i, n in enumerate(left.tolist()))

    def piece(self, text: str) -> list[int]:
        """The tokens of one whole piece."""
        raw = text.encode()
        ids = [self.plain[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        return self.merge(ids)


class PieceStream:
    """One piece of any length, symbol by symbol; holds the lookahead and :data:`STEP` symbols at most."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.raw = bpe, bytearray()

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        raw = text.encode()
        for at in range(0, len(raw), STEP):
            self.raw += raw[at : at + STEP]
            if len(self.raw) > self.bpe.lookahead + STEP:
                # The last byte may turn out to end the piece, and is a symbol of its own then.
                known = len(self.raw) - 1
                done = 0
                for token in self.bpe.merge([self.bpe.plain[b] for b in self.raw[:known]]):
                    size = self.bpe.length[token]
                    if done + size > known - self.bpe.lookahead:
                        break
                    out.append(token)
                    done += size
                del self.raw[:done]
        return out

    def finish(self) -> list[int]:
        ids = [self.bpe.plain[b] for b in self.raw]
        ids[-1] = self.bpe.final[self.raw[-1]]
        return self.bpe.merge(ids)


def _joins_nothing(c: str) -> bool:
    """Whether no character ahead of it can combine with ``c``."""
    return c < "\x80" or (unicodedata.category(c)[0] not in "MC" and not "ᄀ" <= c <= "ᇿ")


class Transducer:
    """Text in chunks to ids: ``feed`` gives the ids that no later text can change."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.raw = ""
        self.text = ""
        self.open: PieceStream | None = None
        self.kind = _LETTERS

    def feed(self, chunk: str) -> list[int]:
        self.raw += chunk
        at = len(self.raw) - 1
        while at > 0 and not _joins_nothing(self.raw[at]):
            at -= 1
        ready, self.raw = self.raw[:at], self.raw[at:]
        return self._take(ready, False)

    def finish(self) -> list[int]:
        out = self._take(self.raw, True)
        self.raw = ""
        return out

    def _take(self, raw: str, last: bool) -> list[int]:
        return self.take(lower(_SPACE.sub(" ", unicodedata.normalize("NFC", raw))), last)

    def take(self, text: str, last: bool) -> list[int]:
        """As ``feed`` and ``finish``, for text that is normalised already: doing so again may change it."""
        self.text += text
        out: list[int] = []
        at = 0
        if self.open:
            match = self.kind.match(self.text)
            at = match.end() if match else 0
            out += self.open.feed(self.text[:at])
            if at < len(self.text) or last:
                out += self.open.finish()
                self.open = None
        while not self.open and (match := _PIECE.search(self.text, at)):
            begin, end = match.span()
            if not last and end > len(self.text) - 4:
                # What follows may change this piece, unless it is long: then it can only grow.
                if end - begin <= STEP:
                    break
                if end == len(self.text):
                    self.kind = _LETTERS if _LETTERS.match(match[0]) else _OTHERS
                    self.open = PieceStream(self.bpe)
                    out += self.open.feed(match[0])
                    at = end
                    break
            out += self.bpe.piece(match[0]) if end - begin <= STEP else self._whole(match[0])
            at = end
        self.text = self.text[at:]
        return out

    def _whole(self, text: str) -> list[int]:
        stream = PieceStream(self.bpe)
        return stream.feed(text) + stream.finish()


class Decoder:
    """Ids to text, as far as each id completes it."""

    def __init__(self, bpe: Bpe, as_text: bool = False):
        self.bpe, self.as_text, self.first = bpe, as_text or bpe.decoder is not None, True
        self.bytes = codecs.getincrementaldecoder("utf-8")(errors="replace") if self.as_text else None

    def feed(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        for i in ids:
            token = self.bpe.tokens.get(i)
            if token is None:
                continue
            if not self.as_text:
                out.append(token if self.first else " " + token)
            elif token in self.bpe.special:
                out.append(self.bytes.decode(b"", True) + token)
                self.bytes.reset()
            else:
                body = token.removesuffix(self.bpe.suffix)
                out.append(self.bytes.decode(bytes(self.bpe.bytes_of[c] for c in body)))
                if body != token:
                    out.append(" ")
            self.first = False
        return "".join(out)

    def finish(self) -> str:
        return self.bytes.decode(b"", True) if self.as_text else ""


class Words(dict):
    """Words with a value made from their ids, or with their packed ids, about as many as :data:`KEPT_WORDS`.

    Ids are kept as bytes: the garbage collector would visit hundreds of thousands of lists again and again.
    """

    def __init__(self, bpe: Bpe, make=None):
        super().__init__()
        self.bpe, self.make = bpe, make
        self.tokens: dict[str, bytes] = {}

    def _value(self, raw: bytes):
        return raw if self.make is None else self.make(self.bpe, unpacked(raw))

    def __missing__(self, word: str):
        return self._value(packed(encode_long(self.bpe, word)))

    def _learn(self, words: set[str]) -> None:
        new = set(filterfalse(self.__contains__, words))
        if len(self) + len(new) > KEPT_WORDS:
            self.clear()
            new = words
        whole: dict[str, str] = {}
        split: dict[str, list[str]] = {}
        for word in new:
            # A long word goes through the transducer each time instead.
            if len(word) > LONG_WORD:
                continue
            text = normal(word)
            if text.isalpha():
                whole[word] = word if text == word else text
            else:
                split[word] = cut(text)
        tokens = self.tokens
        wanted = {*whole.values(), *chain.from_iterable(split.values())}
        texts = list(filterfalse(tokens.__contains__, wanted))
        if len(tokens) + len(texts) > KEPT_PIECES:
            tokens.clear()
            texts = list(wanted)
        tokens.update(zip(texts, self.bpe.pieces(texts)))
        value = self._value
        if self.make is None:
            self.update(zip(whole, map(tokens.__getitem__, whole.values())))
        else:
            self.update((word, value(tokens[text])) for word, text in whole.items())
        self.update((word, value(b"".join([tokens[piece] for piece in pieces]))) for word, pieces in split.items())

    def of(self, texts: list[str | None]) -> Iterator[list]:
        """For each text the values of its words, in order; together they hold its ids."""
        for at in range(0, len(texts), TEXTS):
            parts = [self._parts(text or "") for text in texts[at : at + TEXTS]]
            self._learn(set().union(*(words for text in parts for words, _ in text)))
            for text in parts:
                out: list = []
                for words, special in text:
                    out += map(self.__getitem__, words)
                    if special is not None:
                        out.append(self._value(packed([special])))
                yield out

    def _parts(self, text: str) -> list[tuple[list[str], int | None]]:
        """Runs of words, each with the special token that follows it."""
        if "<|" not in text:
            return [(self._split(text), None)]
        out, at = [], 0
        for match in self.bpe.specials.finditer(text):
            out.append((self._split(text[at : match.start()]), self.bpe.special[match[0]]))
            at = match.end()
        return [*out, (self._split(text[at:]), None)]

    def _split(self, text: str) -> list[str]:
        # str.split also splits at four control characters that are not white space here.
        return [w for w in _SPACE.split(text) if w] if _ASCII_SEPARATORS.search(text) else text.split()


class PackedWords:
    """Packed ids of whole columns: each word of a slice is looked up once, however often it occurs there.

    Texts are normalised and split as a whole; words that are one piece and pieces of others share a table. It
    has two generations of half as many entries as :class:`Words` keeps: what is used again moves to the younger.
    """

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # No normalised text has a capital letter: these words stand for special tokens.
        self.marker = {content: f"S{i}" for content, i in bpe.special.items()}
        self.marked = {self.marker[content]: packed([i]) for content, i in bpe.special.items()}

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def of(self, texts: pa.Array) -> Iterator[bytes]:
        """For each text its packed ids."""
        plain = pa.array([self._normal(text or "") for text in texts.to_pylist()], pa.large_string())
        # Other white space stays inside words; no piece holds any.
        words = pc.ascii_split_whitespace(plain)
        coded = words.flatten().dictionary_encode()
        values = pa.array(self._values(_strings(coded.dictionary)), pa.large_binary())
        found = values.take(coded.indices)
        ends = np.frombuffer(found.buffers()[1], np.int64)[words.offsets.to_numpy()].tolist()
        data = found.buffers()[2] or b""
        return (data[start:end].to_pybytes() if end > start else b"" for start, end in zip(ends, ends[1:]))

    def _normal(self, text: str) -> str:
        if "<|" not in text:
            return normal(text)
        out, at = [], 0
        for match in self.bpe.specials.finditer(text):
            out += normal(text[at : match.start()]), self.marker[match[0]]
            at = match.end()
        return " ".join([*out, normal(text[at:])])

    def _values(self, words: list[str]) -> list[bytes]:
        if len(self.young) > (KEPT_WORDS + KEPT_PIECES) // 2:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        split: dict[str, list[str]] = {}
        wanted: set[str] = set()
        for word in filterfalse(young.__contains__, words):
            if word in old:
                young[word] = old[word]
            elif len(word) > LONG_WORD:
                continue
            elif word.isalpha():
                wanted.add(word)
            elif word in self.marked:
                young[word] = self.marked[word]
            else:
                split[word] = cut(word)
        for piece in filterfalse(young.__contains__, chain.from_iterable(split.values())):
            if piece in old:
                young[piece] = old[piece]
            else:
                wanted.add(piece)
        texts = list(wanted)
        young.update(zip(texts, self.bpe.pieces(texts)))
        young.update([(word, b"".join([young[piece] for piece in pieces])) for word, pieces in split.items()])
        # A long word goes through the transducer each time instead.
        return [self._long(word) if raw is None else raw for word, raw in zip(words, map(young.get, words))]

    def _long(self, word: str, chunk: int = 4096) -> bytes:
        stream = Transducer(self.bpe)
        out = [packed(stream.take(word[at : at + chunk], False)) for at in range(0, len(word), chunk)]
        return b"".join([*out, packed(stream.take("", True))])


def _strings(words: pa.Array) -> list[str]:
    """Words without spaces as Python strings, several times as fast as one by one."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(" ", words.type))[0].as_py().split(" ")


def encode_long(bpe: Bpe, text: str, chunk: int = 4096) -> list[int]:
    stream = Transducer(bpe)
    out: list[int] = []
    for at in range(0, len(text), chunk):
        out += stream.feed(text[at : at + chunk])
    return out + stream.finish()


def kept(name: str, spec: str, build=Words):
    """The worker's own words for one use; they outlive the task."""
    state = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state")).__dict__
    key = name, hashlib.sha256(spec.encode()).digest()
    if key not in state:
        state[key] = build(Bpe(spec))
    return state[key]


def tokenizer_spec(spark: SparkSession, path: str):
    """The tokenizer file's text for all tasks; its size does not depend on the data."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _described(bpe: Bpe, ids: Sequence[int]) -> tuple[int, str, str]:
    return len(ids), " ".join([bpe.digits[i] for i in ids]), Decoder(bpe).feed(ids)


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and digests of the ids and of the text they decode to."""
    spec = tokenizer_spec(docs.sparkSession, tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept("described", spec.value, lambda bpe: Words(bpe, _described))
        for batch in batches:
            n_tokens, ids_sha, text_sha = [], [], []
            for found in words.of(batch.column(1).to_pylist()):
                found = [w for w in found if w[0]]
                n_tokens.append(sum(w[0] for w in found))
                ids_sha.append(hashlib.sha256(" ".join([w[1] for w in found]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(" ".join([w[2] for w in found]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
