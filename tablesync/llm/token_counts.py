"""How many tokens each text has, by heap-and-linked-list byte-pair merging.

A piece of text starts as a linked list of one symbol per byte. A heap holds the adjacent
pairs that have a merge, by rank and then by place. The lowest pair is popped again and
again: its right symbol leaves the list, its left one becomes the merged symbol, and the two
new neighbours enter the heap; entries whose pair has changed since are passed over. The
tokens of the piece are its first symbols less its merges: no token is looked up or emitted.

The tokenizer file is of the ``tokenizers`` library: NFC, white space folded, lower case, a
fixed split into pieces, byte-level BPE with an end-of-word suffix. Its special strings in a
text count as one token each, as the library has it by default.

Words recur, so each worker remembers the counts of up to :data:`KEPT_WORDS` short words and as
many pieces and then starts anew; what it forgets it counts again.

* NULL and empty texts have no bytes and no tokens. NULL ids are kept.
* Repeated rows each get their result; an empty table gives an empty result.
* Columns other than id and text are not read; none can clash.
* A very long text is read word by word. Its longest word without white space sets the memory:
  about 150 bytes for each of its bytes, and time that grows with n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import types
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm import ships
from tablesync.llm.bpe_stream import byte_letters, lower, tokenizer_spec

ships(__name__)

LIMIT = 2048
#: Words, and pieces of words, whose counts a worker remembers, and the longest of them.
KEPT_WORDS = 500_000
LONG_WORD = 64
#: Texts that are Python strings at one time.
TEXTS = 256
#: Characters of a text that are split into words at once.
SLICE = 1 << 20

_SPACE = regex.compile(r"\s+")
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
# The split into pieces and the normalisation that such files name.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_PIECE = regex.compile(_SPLIT)


class Merges:
    """The merges of a tokenizer file: which pairs join, in which order, into what."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if model["type"] != "BPE" or spec["normalizer"]["normalizers"] != _NORMALIZERS or split != _SPLIT:
            raise ValueError("this kind of tokenizer file is not supported")
        suffix, letters = model["end_of_word_suffix"] or "", byte_letters()
        number: dict[str, int] = {}
        for b in range(256):
            number.setdefault(letters[b], len(number))
            number.setdefault(letters[b] + suffix, len(number))
        self.inner = [number[letters[b]] for b in range(256)]
        self.last = [number[letters[b] + suffix] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.joined: list[int] = []
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[number[left] << 32 | number[right]] = len(self.joined)
            self.joined.append(number.setdefault(left + right, len(number)))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)")

    def piece(self, text: str) -> int:
        """Tokens of one piece."""
        raw = text.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return len(raw) - self.merge(symbols)

    def merge(self, symbols: list[int]) -> int:
        """The number of merges that the symbols go through; they are changed in place."""
        n, rank, joined = len(symbols), self.rank.get, self.joined
        # Rank of the pair that starts at each place now; -1 where none joins or the symbol is gone.
        now = [rank(a << 32 | b, -1) for a, b in zip(symbols, symbols[1:])]
        now.append(-1)
        heap = [r << 32 | at for at, r in enumerate(now) if r >= 0]
        if not heap:
            return 0
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            entry = heapq.heappop(heap)
            best, at = entry >> 32, entry & 0xFFFFFFFF
            if now[at] != best:
                continue
            merges += 1
            right = after[at]
            new = symbols[at] = joined[best]
            now[right] = now[at] = -1
            far = after[at] = after[right]
            if far < n:
                before[far] = at
                r = rank(new << 32 | symbols[far], -1)
                if r >= 0:
                    now[at] = r
                    heapq.heappush(heap, r << 32 | at)
            left = before[at]
            if left >= 0:
                r = now[left] = rank(symbols[left] << 32 | new, -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | left)
        return merges


class Remembered(dict):
    """Counts by text, made when a text is first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> int:
        n = self.make(text)
        if len(text) <= LONG_WORD:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[text] = n
        return n


class Counter:
    """Tokens of texts."""

    def __init__(self, merges: Merges):
        self.special = merges.special
        self.pieces = Remembered(merges.piece)
        self.words = Remembered(self._word)

    def _word(self, word: str) -> int:
        text = lower(word if word.isascii() else unicodedata.normalize("NFC", word))
        if text.isalpha():
            return self.pieces[text]
        return sum([self.pieces[match[0]] for match in _PIECE.finditer(text)])

    def text(self, text: str) -> int:
        """Tokens of a whole text."""
        if "<|" not in text:
            return self._plain(text)
        total = at = 0
        for match in self.special.finditer(text):
            total += 1 + self._plain(text[at : match.start()])
            at = match.end()
        return total + self._plain(text[at:])

    def _plain(self, text: str) -> int:
        if len(text) <= SLICE:
            return sum(map(self.words.__getitem__, _words(text)))
        total = at = 0
        while at < len(text):
            space = _SPACE.search(text, min(at + SLICE, len(text)))
            end = space.end() if space else len(text)
            total += sum(map(self.words.__getitem__, _words(text[at:end])))
            at = end
        return total


def _words(text: str) -> list[str]:
    # str.split also splits at four control characters that are not white space here.
    return [w for w in _SPACE.split(text) if w] if _SEPARATORS.search(text) else text.split()


def _counter(spec: str) -> Counter:
    """The worker's counter for a tokenizer file; it outlives the task."""
    state = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state")).__dict__
    key = "token_counts", hashlib.sha256(spec.encode()).digest()
    if key not in state:
        state[key] = Counter(Merges(spec))
    return state[key]


def counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more tokens than ``limit``) for every row."""
    spec = tokenizer_spec(docs.sparkSession, tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        for batch in batches:
            tokens: list[int] = []
            for at in range(0, batch.num_rows, TEXTS):
                tokens += [counter.text(t or "") for t in batch.column(1).slice(at, TEXTS).to_pylist()]
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    counted = own.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
