"""Rules and a hashed n-gram likelihood ratio that decide which documents stay.

Two multinomials over hashed uni- and bigrams are counted, one over every document
and one over trusted documents. A document's score is the mean over its n-grams of
``log p(trusted) - log p(corpus)``; documents below a fixed threshold, and those
failing the base rules, do not stay.

Tokens are runs of letters, digits and non-ASCII bytes, or runs of other
characters; hence symbols glued to words count by themselves. Counts are sums
of integers, so scores do not depend on the partitioning. Trusted documents are found by a
shuffled join with all labels. The number of buckets follows the number of different n-grams
up to :data:`MOST_BUCKETS`, from which on several n-grams share a bucket.

* NULL and empty texts have no words: all counts are 0 and ``base_failed`` is true.
* Repeated rows each get their own result and each count towards the corpus.
* Without trusted documents the ratio is 0 everywhere, and only the base rules decide.
* Columns of the input other than id and text are not read; none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm import ships
from tablesync.llm.textblocks import Block, blocks, grams, mix

ships(__name__)

#: Buckets of the hashed n-grams: a power of two of at least twice the different n-grams, within these bounds.
#: The upper one bounds memory: 32 MB of counts in a task, 16 MB of ratios that are broadcast.
LEAST_BUCKETS, MOST_BUCKETS = 1 << 14, 1 << 22
#: Neighbouring buckets that travel as one row.
RANGE = 1 << 12
#: N-grams added to the trusted count of each bucket and to the count that its share in the corpus lets expect.
PRIOR = 8
#: Mean log ratio that a document needs to stay.
THRESHOLD = -0.15

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8

_WORDISH = np.zeros(256, bool)
_WORDISH[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STARTS_CODE_POINT = (np.arange(256) & 0xC0) != 0x80


def gram_buckets(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every uni- and bigram."""
    wordish = _WORDISH[block.data]
    letters, others = block.runs(wordish), block.runs(~wordish & ~block.space)
    starts = np.concatenate([letters[0], others[0]])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.concatenate([letters[1], others[1]])[order]
    one = block.hashes(starts, ends)
    doc = np.searchsorted(block.offsets, starts, "right") - 1
    two = grams(one, 2)[:-1][doc[1:] == doc[:-1]]
    both = np.concatenate([one, two]) % np.uint64(buckets)
    return both.astype(np.int64), np.concatenate([doc, doc[:-1][doc[1:] == doc[:-1]]])


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """The counts of the base rules for each document."""
    word_chars = block.per_doc(_STARTS_CODE_POINT[block.data] & ~block.space)
    n_symbols = block.per_doc(_SYMBOL[block.data])

    line_starts, line_ends = block.runs(block.data != 10)
    has_word = np.searchsorted(block.words[0], line_ends) > np.searchsorted(block.words[0], line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    doc = np.searchsorted(block.offsets, line_starts, "right") - 1
    key = mix(block.hashes(line_starts, line_ends) + mix(doc.astype(np.uint64)))
    _, kept = np.unique(key, return_index=True)
    n_dup_lines = np.bincount(doc, minlength=block.n) - np.bincount(doc[kept], minlength=block.n)

    at = np.flatnonzero(block.full(WINDOW))
    doc = block.doc_of_word[at]
    key = mix(block.grams(WINDOW)[at] + mix(doc.astype(np.uint64)))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    repeated = at[times[inverse] > 1]
    edge = np.zeros(len(block.words[0]) + 1, np.int64)
    edge[repeated] += 1
    np.subtract.at(edge, repeated + WINDOW, 1)
    covered = np.cumsum(edge[:-1]) > 0
    n_repeat_words = np.bincount(block.doc_of_word[covered], minlength=block.n)
    return {
        "n_words": block.counts,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words,
    }


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for part in _parts(batches):
        texts = [pack.compress(text.encode()) for text in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], ["doc_id", "ztext"])


def _rows(ranges: dict[int, np.ndarray]) -> pa.RecordBatch:
    pack = zstandard.ZstdCompressor(level=1)
    counts = [pack.compress(found.tobytes()) for found in ranges.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(ranges), pa.int64()), pa.array(counts, pa.binary())], ["range", "counts"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of each bucket in the texts, or packed texts, of a task."""
    unpack = zstandard.ZstdDecompressor()
    total = np.zeros(MOST_BUCKETS, np.int64)
    for part in _parts(batches):
        texts = part.column(0)
        if pa.types.is_binary(texts.type):
            texts = pa.array([unpack.decompress(z).decode() for z in texts.to_pylist()], pa.large_string())
        for block in blocks(texts):
            np.add.at(total, gram_buckets(block, MOST_BUCKETS)[0], 1)
    split = total.reshape(-1, RANGE)
    yield _rows({at: split[at] for at in np.flatnonzero(split.any(axis=1)).tolist()})


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[at] = held.get(at, 0) + np.frombuffer(unpack.decompress(counts), np.int64)
    yield _rows(held)


def ngram_counts(texts: DataFrame) -> np.ndarray:
    """N-grams of each of MOST_BUCKETS buckets in the only column; one packed row per range of buckets comes to the driver."""
    schema = "range long, counts binary"
    rows = texts.mapInArrow(_count, schema).repartition("range").mapInArrow(_sum, schema).collect()
    total = np.zeros((MOST_BUCKETS // RANGE, RANGE), np.int64)
    for row in rows:
        total[row["range"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["counts"]), np.int64)
    return total.reshape(-1)


def buckets_for(counts: np.ndarray) -> int:
    """Buckets for the different n-grams that the share of empty buckets tells of."""
    empty = max(np.count_nonzero(counts == 0), 1) / len(counts)
    buckets = LEAST_BUCKETS
    while buckets < MOST_BUCKETS and buckets < -2 * len(counts) * np.log(empty):
        buckets *= 2
    return buckets


def log_ratios(trusted: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of each bucket."""
    buckets = buckets_for(corpus)
    # Bucket numbers are remainders by powers of two, so those of fewer buckets are sums.
    trusted, corpus = trusted.reshape(-1, buckets).sum(axis=0), corpus.reshape(-1, buckets).sum(axis=0)
    if not trusted.any():
        return np.zeros(buckets, np.float32)
    # Trusted counts shrink towards the corpus, so a bucket that few n-grams reach says little.
    expected = corpus * (trusted.sum() / corpus.sum())
    return np.log((trusted + PRIOR) / (expected + PRIOR)).astype(np.float32)


def trusted_ids(labels: DataFrame, doc_id: str, quality: str) -> DataFrame:
    """Ids of all trusted documents."""
    ids = labels.filter((F.col(quality) == 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("trusted_id"))
    return ids.distinct()


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def verdicts(block: Block, ratios: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """The counts, ``base_failed``, ``llr`` and ``kept`` for each document of a block."""
    found = base_counts(block)
    bucket, doc = gram_buckets(block, len(ratios))
    n = np.bincount(doc, minlength=block.n)
    llr = np.bincount(doc, ratios[bucket], minlength=block.n) / np.maximum(n, 1)
    failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEATED_PERCENT * found["n_words"])
    return {**found, "base_failed": failed, "kept": ~failed & (llr >= threshold), "llr": llr}


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> Broadcast:
    """Log ratios of the buckets, counted over all documents and over all trusted ones."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    known = own.filter("doc_id is not null and text is not null").mapInArrow(_packed, f"doc_id {kind}, ztext binary")
    ids = trusted_ids(labels, "doc_id", "quality")
    # A merge join at any size: both sides are shuffled, neither has to fit anywhere.
    trusted = known.join(ids.hint("merge"), known["doc_id"] == ids["trusted_id"], "left_semi")
    ratios = log_ratios(ngram_counts(trusted.select("ztext")), ngram_counts(own.select("text")))
    return docs.sparkSession.sparkContext.broadcast(ratios)


def judge(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Counts of the base rules, ``base_failed``, ``kept`` and ``llr`` for every row of ``docs``."""
    ratios = fit(docs, labels, doc_id, text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = verdicts(block, ratios.value, threshold)
                ids = batch.column(0).slice(block.rows.start, block.n)
                values = [pa.array(found[name].astype(np.int64)) for name in COUNTS]
                values += [pa.array(found[name]) for name in ("base_failed", "kept", "llr")]
                yield pa.RecordBatch.from_arrays([ids, *values], ["doc_id", *COUNTS, "base_failed", "kept", "llr"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{name} long" for name in COUNTS)
    return own.mapInArrow(score, f"doc_id {kind}, {columns}, base_failed boolean, kept boolean, llr double")


def keep(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; decided where the row is, without a join."""
    ratios = fit(docs, labels, doc_id, text)
    position = docs.columns.index(text)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(position)):
                kept = verdicts(block, ratios.value, threshold)["kept"]
                yield batch.slice(block.rows.start, block.n).filter(pa.array(kept))

    return docs.mapInArrow(chosen, docs.schema)
