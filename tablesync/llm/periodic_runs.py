"""Stretches of words that repeat with a period, by seed-and-extend on diagonals.

A run is a stretch of neighbouring words of one text in which words ``q`` apart are the same,
``q`` being its smallest period, that no neighbouring word extends, and of at least
``max(MIN_LENGTH, MIN_POWER * q)`` words.

*Seeds.* On the diagonal of lag ``q`` (words compared with those ``q`` later) a run of ``L``
words is a streak of ``L - q`` equal pairs. For lags from ``Q`` to below ``2 Q`` it has at least
``k = max(MIN_LENGTH - Q, 3 Q)`` of them (5 at lag 1), so some ``k``-gram occurs again ``q`` later.
The ``k``-grams of a document are put in order, and each occurrence is paired with the next
two: a ``k``-gram that lies in a run of period ``q`` and spans ``1.5 q`` words cannot return within
half of ``q`` (it would have two periods that add up to no more than its length, so their common
divisor would be a smaller one), hence at most one return lies between an occurrence and the
one ``q`` later. Only places whose shorter gram returned are looked at for the next, longer gram.

*Extension.* Along each lag the seeds are walked by place. A table holds how far each lag has
been covered; a seed inside is passed over, another is extended word by word to both sides,
within its document. Multiples of a period cover the same stretch and give way to the smallest.

So pairs are linear in the words for each of the log(words) gram lengths, also in a text of one
word repeated; words are compared by their exact number in the block, never by a hash alone.

* NULL, empty and blank texts have no words and no runs. NULL ids are kept.
* Repeated rows each get their result; an empty table gives an empty result.
* Columns other than id and text are not read; none can clash.
* A very long text is handled at once: about 100 bytes of memory per word and time that grows
  with n log n.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm import ships
from tablesync.llm.textblocks import Block, blocks, grams, mix

ships(__name__)

MIN_LENGTH = 6
#: Periods that a run has at least; the proof above needs 4.
MIN_POWER = 4
#: Words compared by the first step of an extension; steps then double.
STEP = 16
_SALT = np.uint64(0x9E3779B97F4A7C15)


def word_numbers(block: Block) -> np.ndarray:
    """A number for each word of the block; the same words have the same number."""
    starts, ends = block.words
    if not len(starts):
        return np.zeros(0, np.int64)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = np.ascontiguousarray(block.data[~block.space])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _seeds(words: np.ndarray, doc: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each class of lags: places and lags of the same gram in one document."""
    hashed = mix(words.astype(np.uint64) + _SALT)
    at, low = np.arange(len(words)), 1
    while len(at):
        k = max(MIN_LENGTH - low, 3 * low)
        at = at[at + k <= last[at]]
        if not len(at):
            return
        gram = grams(hashed, k)[at]
        # Stable, so that the occurrences in one document are neighbours, in order of their places.
        order = np.argsort(gram, kind="stable")
        gram, place = gram[order], at[order]
        found_at, found_lag = [], []
        returns = np.zeros(len(place), bool)
        for step in (1, 2):
            same = (gram[step:] == gram[:-step]) & (doc[place[step:]] == doc[place[:-step]])
            if step == 1:
                returns[1:] |= same
                returns[:-1] |= same
            lag = place[step:] - place[:-step]
            here = np.flatnonzero(same & (lag >= low) & (lag < 2 * low))
            found_at.append(place[here])
            found_lag.append(lag[here])
        yield np.concatenate(found_at), np.concatenate(found_lag)
        at = np.sort(place[returns])
        low *= 2


def _streak(words: np.ndarray, i: int, j: int, limit: int, step: int) -> int:
    """How many words from ``i`` and ``j`` on, or back where ``step`` is -1, are the same."""
    done, size = 0, STEP
    while done < limit:
        size = min(size, limit - done)
        if step > 0:
            unequal = words[i + done : i + done + size] != words[j + done : j + done + size]
        else:
            unequal = (words[i - done - size + 1 : i - done + 1] != words[j - done - size + 1 : j - done + 1])[::-1]
        first = int(unequal.argmax())
        if unequal[first]:
            return done + first
        done += size
        size *= 2
    return done


def runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start (in all words), length and period of every run, by document, start and period.

    ``words`` are the numbered words of documents end to end, ``first`` where each starts and, last, the end of all.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = first[1:][doc]
    begin = first[:-1][doc]
    found: dict[tuple[int, int], int] = {}
    for place, lag in _seeds(words, doc, last):
        if not len(place):
            continue
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        # Neighbouring seeds of a lag are one streak.
        new = np.ones(len(place), bool)
        new[1:] = (lag[1:] != lag[:-1]) | (place[1:] > place[:-1] + 1)
        covered: dict[int, int] = {}
        for at, q in zip(place[new].tolist(), lag[new].tolist()):
            if at < covered.get(q, 0):
                continue
            ahead = _streak(words, at, at + q, int(last[at]) - at - q, 1)
            back = _streak(words, at - 1, at + q - 1, at - int(begin[at]), -1)
            covered[q] = at + ahead
            start, length = at - back, back + ahead + q
            if length >= max(MIN_LENGTH, MIN_POWER * q):
                key = start, length
                found[key] = min(found.get(key, q), q)
    table = np.array([(start, length, q) for (start, length), q in found.items()], np.int64).reshape(-1, 3)
    start, length, period = table[np.lexsort((table[:, 2], table[:, 0]))].T
    return doc[start], start, length, period


def _best(runs_of: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period; then the smallest start and period."""
    best = None
    for run in runs_of:
        # Fractions are compared exactly, by cross products.
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: ``doc_id``; ``runs``, an array of ``start`` (word number from 0), ``length`` and
    ``period``, by start and period; ``best``, the run that repeats most often, NULL without runs;
    ``collapsed``, the text's words joined by a space, of each run only its first period."""

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        named = lambda r: {"start": r[0], "length": r[1], "period": r[2]}
        for batch in batches:
            for block in blocks(batch.column(1)):
                words = word_numbers(block)
                doc, start, length, period = runs(words, block.first)
                kept = np.ones(len(words), bool)
                per_doc: dict[int, list[tuple[int, int, int]]] = {}
                for d, s, n, q in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
                    kept[s + q : s + n] = False
                    per_doc.setdefault(d, []).append((s - int(block.first[d]), n, q))
                listed = [per_doc.get(d, []) for d in range(block.n)]
                best = [_best(r) for r in listed]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.rows.start, block.n),
                        pa.array([[named(r) for r in rs] for rs in listed], pa.list_(run)),
                        pa.array([r and named(r) for r in best], run),
                        _joined(block, kept),
                    ],
                    ["doc_id", "runs", "best", "collapsed"],
                )

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    run = "struct<start: long, length: long, period: long>"
    return own.mapInArrow(detect, f"doc_id {kind}, runs array<{run}>, best {run}, collapsed string")


def _joined(block: Block, kept: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    starts, ends = block.words
    starts, ends, doc = starts[kept], ends[kept], block.doc_of_word[kept]
    # Each kept word is copied with one byte ahead of it, which becomes the space.
    size = ends - starts + 1
    offset = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offset[1:])
    source = np.repeat(starts - 1 - offset[:-1], size) + np.arange(offset[-1])
    out = block.data[np.maximum(source, 0)] if len(source) else np.zeros(0, np.uint8)
    out[offset[:-1]] = 32
    first = np.searchsorted(doc, np.arange(block.n + 1))
    # The space ahead of a document's first word is left out of its text.
    drop = offset[:-1][first[:-1][first[:-1] < first[1:]]]
    used = np.ones(len(out), bool)
    used[drop] = False
    end = offset[first] - np.searchsorted(drop, offset[first])
    text = pa.py_buffer(np.ascontiguousarray(out[used]))
    return pa.LargeStringArray.from_buffers(block.n, pa.py_buffer(end), text).cast(pa.string())


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the number of runs, the run that repeats most often, and hashes of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = F.col("best.length"), F.col("best.period")
    return find(docs, doc_id, text).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
